"""A causal self-attention model over words given by their subword ids, in numpy.

A word's input is the mean of the embeddings of its subword ids.  One head of
masked attention with learned weights for relative places looks at the words
before a place; a feed-forward layer over the last word and what attention found
gives the probabilities of the next word's class.  Query and key are one matrix,
and the value projection is part of the feed-forward layer: the same functions
as with separate ones, at fewer products.

Texts are numbers into a list of words; long ones are cut into windows that
overlap, and each place is scored in one window only.
"""

from __future__ import annotations

import numpy as np

CLASSES = 128
DIM = 16
HIDDEN = 32
WINDOW = 32
STRIDE = 28
BATCH = 64
#: Places worked on together: bounds memory, and how long embeddings wait for their step.
GROUP = 15_000
N_IDS = 50_257
F32 = np.float32


def grid(lengths: np.ndarray, stride: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, real, scored) by window and place in it, for texts of these lengths laid end to end.

    Windows of a text begin every ``stride`` places; a window scores the places
    that the one before it does not have, so each place is scored once and sees
    at least WINDOW - stride places before it, or all there are.
    """
    lengths = np.asarray(lengths, np.int64)
    many = 1 + np.maximum(0, -(-(lengths - WINDOW) // stride))
    text = np.repeat(np.arange(len(lengths)), many)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
    base = np.cumsum(lengths) - lengths
    at = (nth * stride)[:, None] + np.arange(WINDOW)
    real = at < lengths[text][:, None]
    scored = real & ((nth == 0)[:, None] | (np.arange(WINDOW) >= WINDOW - stride))
    return np.where(real, base[text][:, None] + at, base[text][:, None]), real, scored


def inputs_of(words: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The word before each place: 0, the start, at the first place of a text (words count from 1)."""
    out = np.empty_like(words)
    out[1:] = words[:-1]
    out[np.cumsum(lengths) - lengths] = 0
    return out


def _sums(values: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Rows of values added up by their places at (all of 0..n-1 occur)."""
    at = at.astype(np.uint16) if n <= 1 << 16 else at  # sorted by radix
    order = np.argsort(at, kind="stable")
    return np.add.reduceat(values[order], np.searchsorted(at[order], np.arange(n, dtype=at.dtype)), 0)


def _renumbered(x: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct numbers in x, all under top, how often each occurs, and x by their places."""
    count = np.bincount(x, minlength=top)
    used = np.flatnonzero(count)
    place = np.empty(top, np.int32)
    place[used] = np.arange(len(used), dtype=np.int32)
    return used, count[used], place[x]


class Bags:
    """The subword ids of a list of words; word 0 is the start, and has none."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, classes: np.ndarray):
        self.ids, self.sizes = ids.astype(np.int64), sizes.astype(np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        #: class by word, 0 standing for the start
        self.classes = np.concatenate([[0], classes])

    def own(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Subword ids of some words, not the start, end to end: ids, where each word's begin, and how many it has."""
        n = self.sizes[words - 1]
        first = np.cumsum(n) - n
        return self.ids[np.repeat(self.starts[words - 1] - first, n) + np.arange(n.sum())], first, n

    def vectors(self, p: dict[str, np.ndarray], words: np.ndarray) -> np.ndarray:
        """Inputs of some distinct words in rising order; only the first may be the start."""
        out = np.empty((len(words), DIM), F32)
        begins = int(len(words) > 0 and words[0] == 0)
        out[:begins] = p["start"]
        if len(words) > begins:
            ids, first, n = self.own(words[begins:])
            out[begins:] = np.add.reduceat(p["emb"][ids], first, 0) / n[:, None].astype(F32)
        return out


class Attention:
    def __init__(self, seed: int = 5, n_ids: int = N_IDS):
        r = np.random.default_rng(seed)
        n = lambda *s, k=1.0: (r.standard_normal(s) * k).astype(F32)
        self.p = {
            "emb": n(n_ids, DIM, k=0.1), "start": n(DIM, k=0.1), "place": np.zeros(WINDOW, F32), "qk": n(DIM, DIM, k=0.5 / DIM),
            "own": n(DIM, HIDDEN, k=DIM**-0.5), "seen": n(DIM, HIDDEN, k=DIM**-0.5), "b": np.zeros(HIDDEN, F32), "out": n(HIDDEN, CLASSES, k=0.05), "bo": np.zeros(CLASSES, F32),
        }
        lag = np.arange(WINDOW)[:, None] - np.arange(WINDOW)[None]
        self.lag, self.mask = np.maximum(lag, 0), np.where(lag < 0, F32(-1e9), F32(0))

    def look(self, x: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Attention weights of windows (windows, places, places), their sums by which to divide them, and what they find; x: inputs, q: x @ qk.

        Places that stand for nothing come after the real ones, where the mask hides them.
        """
        a = q @ x.transpose(0, 2, 1)
        a += self.p["place"][self.lag] + self.mask
        np.minimum(a, F32(60), out=a)
        np.exp(a, out=a)
        total = a.sum(-1, keepdims=True)
        c = a @ x
        c /= total
        return a, total, c

    def logits(self, h: np.ndarray) -> np.ndarray:
        """h has a last column of ones, for the biases."""
        z = h @ np.concatenate([self.p["out"], self.p["bo"][None]])
        return np.minimum(z, F32(60), out=z)

    def hidden(self, *parts: np.ndarray) -> np.ndarray:
        """The sum of the parts under the ramp, and a last column of ones."""
        h = np.empty((len(parts[0]), HIDDEN + 1), parts[0].dtype)
        h[:, HIDDEN] = 1
        own = h[:, :HIDDEN]
        np.add(parts[0], parts[1], out=own)
        for x in parts[2:]:
            own += x
        np.maximum(own, 0, out=own)
        return h

    def scores(self, bags: Bags, words: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """ln P(class of the word | words before it in its window) at each place of texts; words count from 1."""
        p = self.p
        out = np.empty(len(words), F32)
        ends = np.concatenate([[0], np.cumsum(lengths)])
        for a, z in groups(lengths):
            w = words[ends[a] : ends[z]]
            used, _, inputs = _renumbered(inputs_of(w, lengths[a:z]), len(bags.classes))
            target = bags.classes[w]
            vec = bags.vectors(p, used)
            asks, own = vec @ p["qk"], vec @ p["own"] + p["b"]  # once for each word, not for each place
            place, real, scored = grid(lengths[a:z], STRIDE)
            for k in range(0, len(place), BATCH):
                s, at = scored[k : k + BATCH], place[k : k + BATCH]
                num = inputs[at]
                c = self.look(vec[num], asks[num])[2]
                lg = self.logits(self.hidden(c[s] @ p["seen"], own[num[s]]))
                mine = at[s]
                chosen = lg[np.arange(len(lg)), target[mine]]
                np.exp(lg, out=lg)
                out[ends[a] + mine] = chosen - np.log(lg.sum(1))
        return out


def groups(lengths: np.ndarray) -> list[tuple[int, int]]:
    """Runs of texts of about GROUP places in all, at least one text each."""
    out, a, n = [], 0, 0
    for k, m in enumerate(lengths.tolist()):
        n += m
        if n >= GROUP:
            out.append((a, k + 1))
            a, n = k + 1, 0
    if a < len(lengths):
        out.append((a, len(lengths)))
    return out


class Trainer:
    """Learns from whole texts: Adam for the dense weights after each batch of windows, for embeddings after each group of texts."""

    def __init__(self, net: Attention, rate: float, squares: dict[str, np.ndarray] | None = None, step: int = 0):
        self.net, self.rate, self.step, self.begun, self.places, self.loss = net, rate, step, step, 0, 0.0
        self.s = squares or {k: np.zeros_like(v) for k, v in net.p.items()}
        self.uses = np.zeros(len(net.p["emb"]), np.int64)
        # the dense weights of a batch side by side, so that a step is a few products
        self.keys = [k for k in net.p if k not in ("emb", "start")]
        ends = np.cumsum([0, *(net.p[k].size for k in self.keys)])
        self.cut = {k: slice(a, z) for k, a, z in zip(self.keys, ends, ends[1:], strict=False)}
        flat = lambda d: np.concatenate([d[k].ravel() for k in self.keys])
        self.flat, self.squares = flat(net.p), flat(self.s)
        self.grad, self.moment = np.zeros_like(self.flat), np.zeros_like(self.flat)
        self.start_moment = np.zeros_like(net.p["start"])
        for k in self.keys:
            net.p[k] = self.flat[self.cut[k]].reshape(net.p[k].shape)
            self.s[k] = self.squares[self.cut[k]].reshape(net.p[k].shape)

    def _adam(self, value: np.ndarray, grad: np.ndarray, m: np.ndarray, s: np.ndarray) -> None:
        m *= F32(0.9)
        m += F32(0.1) * grad
        s *= F32(0.98)
        s += F32(0.02) * grad * grad
        value -= F32(self.rate / (1 - 0.9 ** (self.step - self.begun))) * m / (np.sqrt(s * F32(1 / (1 - 0.98**self.step))) + F32(1e-7))

    def _embeddings(self, rows: np.ndarray, grad: np.ndarray) -> None:
        """A step by the root of the summed squares (Adagrad), for the rows in use."""
        s = self.s["emb"][rows] + grad * grad
        self.s["emb"][rows] = s
        self.net.p["emb"][rows] -= F32(8 * self.rate) * grad / (np.sqrt(s) + F32(1e-6))

    def batch(self, x: np.ndarray, real: np.ndarray, target: np.ndarray) -> np.ndarray:
        """One step on windows whose real places all count (target: by window and place); the gradient by input."""
        net, p = self.net, self.net.p
        self.step += 1
        flat = lambda t: t.reshape(-1, t.shape[-1])
        q = x @ p["qk"]
        a, seen, c = net.look(x, q)
        a /= seen
        xf, cf, real, target = flat(x), flat(c), real.ravel(), target.ravel()
        h = net.hidden(xf @ p["own"], cf @ p["seen"], p["b"])
        pr = net.logits(h)
        rows, n = np.arange(len(pr)), int(real.sum())
        chosen = pr[rows, target]
        np.exp(pr, out=pr)
        total = pr.sum(1)
        self.loss += float((np.log(total) - chosen)[real].sum())
        self.places += n
        share = real * F32(1 / max(1, n))  # places that stand for nothing count for nothing
        pr *= (share / total)[:, None]
        pr[rows, target] -= share
        outer = h.T @ pr
        by = {"out": outer[:HIDDEN], "bo": outer[HIDDEN]}
        gh = pr @ p["out"].T
        gh *= h[:, :HIDDEN] > 0
        by |= {"own": xf.T @ gh, "seen": cf.T @ gh, "b": gh.sum(0)}
        gx, gc = (gh @ p["own"].T).reshape(x.shape), (gh @ p["seen"].T).reshape(x.shape)
        ga = gc @ x.transpose(0, 2, 1)
        gx += a.transpose(0, 2, 1) @ gc
        ga *= a
        ga -= a * ga.sum(-1, keepdims=True)
        by["place"] = np.bincount(net.lag.ravel(), weights=(ga.sum(0) * (net.mask == 0)).ravel(), minlength=WINDOW).astype(F32)
        gq = ga @ x
        gx += ga.transpose(0, 2, 1) @ q
        gx += gq @ p["qk"].T
        by["qk"] = xf.T @ flat(gq)
        for key, grad in by.items():
            self.grad[self.cut[key]] = grad.ravel()
        self._adam(self.flat, self.grad, self.moment, self.squares)
        return gx

    def texts(self, bags: Bags, words: np.ndarray, lengths: np.ndarray, rng: np.random.Generator) -> None:
        """One pass over whole texts; every place is learnt from once, in windows that do not overlap."""
        ends = np.concatenate([[0], np.cumsum(lengths)])
        for a, z in groups(lengths):
            w = words[ends[a] : ends[z]]
            used, _, inputs = _renumbered(inputs_of(w, lengths[a:z]), len(bags.classes))
            place, real, _ = grid(lengths[a:z], WINDOW)
            target = bags.classes[w]
            vec = bags.vectors(self.net.p, used)
            grads = np.zeros((len(w), DIM), F32)
            order = rng.permutation(len(place))
            for k in range(0, len(order), BATCH):
                b = np.sort(order[k : k + BATCH])
                r, at = real[b], place[b]
                gx = self.batch(vec[inputs[at]], r, target[at])
                grads[at[r]] = gx[r]
            by_word = _sums(grads, inputs, len(used))
            begins = int(len(used) > 0 and used[0] == 0)
            if begins:
                self._adam(self.net.p["start"], by_word[0], self.start_moment, self.s["start"])
            if len(used) > begins:
                ids, _, n = bags.own(used[begins:])
                rows, count, at = _renumbered(ids, len(self.uses))
                self._embeddings(rows, _sums(np.repeat(by_word[begins:] / n[:, None].astype(F32), n, axis=0), at, len(rows)))
                self.uses[rows] += count
