"""Operator 8, toxicity: a convolutional text classifier trained in numpy.

Words (white space cut, lower-cased, trimmed of punctuation) are hashed to
embeddings; filters of several widths slide over the whole text; the maximum of
each filter over all places feeds a logistic output.  Embeddings begin with a
smoothed log odds per hash bucket in their first component, so rare words begin
as neutral.  Scores are calibrated on rows held back from training, and a
threshold per language is found there too (``flagged``); the language selects a
threshold only and is no input of the score.

Training uses a bounded sample of labelled rows (``sample``); scoring is a map
over partitions with whole texts.

Defined results: null and empty texts get the score of a text without words and
stay as they are; rows are kept one for one; other columns are returned unread; labels of absent documents and null labels are
ignored; without labels of both kinds every score is the base rate (0 if there
are no labels).
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import release
from .common import fold, table

BUCKETS = 1 << 17
DIM = 8
WIDTHS = (1, 2, 3)
FILTERS = 8
#: Most labelled rows that training and calibration use.
SAMPLE = 6000
#: As how many documents the base rate counts in a bucket's log odds.  This, the rate and the epochs were chosen by five-fold cross-validation within the training rows (README).
PRIOR = 128.0
#: Most words a task remembers the buckets of.
REMEMBERED = 200_000
#: Places scored at once.
PLACES = 60_000
PAD = BUCKETS  # a row of zeros
_TRIM = b".,;:!?\"'()[]{}*#%&$|<>=+-_/\\"


class Buckets(dict):
    """Hash bucket of each word; beyond REMEMBERED words it starts anew."""

    def __missing__(self, word):
        if len(self) > REMEMBERED:
            self.clear()
        low = word.decode("utf-8", "replace").lower().encode("utf-8", "replace").strip(_TRIM)
        self[word] = b = zlib.crc32(low or word) % BUCKETS
        return b


def word_ids(text: str | None, seen: Buckets) -> np.ndarray:
    words = (text or "").encode("utf-8", "replace").split()
    return np.fromiter(map(seen.__getitem__, words), np.int32, len(words)) if words else np.full(1, PAD, np.int32)


def _top(act: np.ndarray, starts: np.ndarray, docs: list[np.ndarray]) -> np.ndarray:
    """Maximum over the places of each document; places that begin in the padding would see the next one."""
    ends = starts + [len(d) for d in docs]
    cuts = np.stack([starts, ends], 1).ravel()
    return np.maximum.reduceat(act, cuts[cuts < len(act)], axis=0)[::2]


def _sigmoid(u):
    return 1 / (1 + np.exp(-np.clip(u, -40, 40)))


def _join(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all documents in a row, each followed by padding, and their starts."""
    gap = np.full(max(WIDTHS) - 1, PAD, np.int32)
    starts = np.cumsum([0, *(len(d) + len(gap) for d in docs)])[:-1]
    return np.concatenate([x for d in docs for x in (d, gap)]), starts


class TextCNN:
    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.emb = (rng.standard_normal((BUCKETS + 1, DIM)) * 0.05).astype(np.float32)
        self.emb[PAD] = 0
        self.conv = [(rng.standard_normal((w, DIM, FILTERS)) * 0.3).astype(np.float32) for w in WIDTHS]
        for w in self.conv:
            w[:, 0, :4] += 1.0 / len(w)
        self.cb = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = (rng.standard_normal(FILTERS * len(WIDTHS)) * 0.1).astype(np.float32)
        self.ob = np.float32(-1.0)
        self.scale = (1.0, 0.0)
        self.thresholds: dict[str, float] = {}

    def prepare(self) -> None:
        """Filters applied to every embedding once: a place's output is then a sum of rows."""
        self.table = [[np.ascontiguousarray(self.emb @ w[j]) for j in range(len(w))] for w in self.conv]

    def pooled(self, docs: list[np.ndarray], places: bool = False, table=None):
        """Maximum of each filter over each document, and where it stands."""
        ids, starts = _join(docs)
        best, at = [], []
        for w, (width, b) in enumerate(zip(WIDTHS, self.cb, strict=True)):
            n = len(ids) - width + 1
            parts = (table or self.table)[w]
            act = parts[0].take(ids[:n], 0, mode="clip")
            for j in range(1, width):
                act += parts[j].take(ids[j : n + j], 0, mode="clip")
            top = _top(act, starts, docs)
            best.append(np.maximum(top + b, 0))
            if places:
                # the first place in each document that has the maximum
                at.append(np.stack([_first_max(act[:, f], starts, top[:, f]) for f in range(FILTERS)], 1))
        return np.concatenate(best, 1), at, ids

    def logit(self, docs: list[np.ndarray]) -> np.ndarray:
        a, b = self.scale
        return a * (self.pooled(docs)[0] @ self.out + self.ob) + b

    def score(self, docs: list[np.ndarray]) -> np.ndarray:
        out = np.empty(len(docs))
        at = 0
        while at < len(docs):  # bounded memory: about PLACES places at a time
            z, n = at + 1, len(docs[at])
            while z < len(docs) and n + len(docs[z]) < PLACES:
                n += len(docs[z])
                z += 1
            out[at:z] = _sigmoid(self.logit(docs[at:z]))
            at = z
        return out

    def fit(self, docs: list[np.ndarray], y: np.ndarray, epochs: int = 5, rate: float = 0.02, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        base = (y.sum() + 0.5) / (len(y) + 1)
        pos, tot = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
        for d, t in zip(docs, y, strict=True):
            u = np.unique(d)
            tot[u] += 1
            pos[u] += t
        odds = np.log((pos + PRIOR * base) / (tot - pos + PRIOR * (1 - base))) - np.log(base / (1 - base))
        self.emb[:, 0] = np.clip(odds, -1, 5)
        self.emb[PAD] = 0
        moment: dict = {}

        def adam(key, value, grad, step, rows=None):
            m, v = moment.setdefault(key, (np.zeros_like(value), np.zeros_like(value)))
            if rows is None:
                m[...] = 0.9 * m + 0.1 * grad
                v[...] = 0.99 * v + 0.01 * grad * grad
                value -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)).astype(value.dtype)
            else:  # embeddings: only the rows in use
                v[rows] = 0.99 * v[rows] + 0.01 * grad * grad
                value[rows] -= 0.05 * rate * grad / (np.sqrt(v[rows] / (1 - 0.99**step)) + 1e-4)

        step = 0
        ob = np.array([self.ob])
        for _ in range(epochs):
            order = rng.permutation(len(docs))
            for at in range(0, len(order), 64):
                step += 1
                own = order[at : at + 64]
                batch = [docs[k] for k in own]
                used = np.unique(np.concatenate([*batch, [PAD]]))
                where = np.zeros(BUCKETS + 1, np.int32)
                where[used] = np.arange(len(used))
                local = [where[d] for d in batch]
                small = [[self.emb[used] @ w[j] for j in range(len(w))] for w in self.conv]
                # padding maps to the zero row's place
                h, places, ids = self._pooled_local(local, small, where[PAD])
                keep = rng.random(h.shape) > 0.25
                hd = h * keep / 0.75
                p = _sigmoid(hd @ self.out + ob[0])
                g = (p - y[own]) / len(own)
                gh = np.outer(g, self.out) * keep / 0.75 * (h > 0)
                ge = np.zeros((len(used), DIM), np.float32)
                grads = []
                for w, width in enumerate(WIDTHS):
                    gw = gh[:, w * FILTERS : (w + 1) * FILTERS].astype(np.float32)
                    gc = np.zeros_like(self.conv[w])
                    for j in range(width):
                        e = ids[places[w] + j]  # documents x filters
                        gc[j] = np.einsum("df,dfk->kf", gw, self.emb[used][e])
                        np.add.at(ge, e.ravel(), (gw[:, :, None] * self.conv[w][j].T[None]).reshape(-1, DIM))
                    grads.append((gc, gw.sum(0)))
                adam("out", self.out, hd.T @ g + 1e-3 * self.out, step)
                adam("ob", ob, np.array([g.sum()]), step)
                for w, (gc, gb) in enumerate(grads):
                    adam(("c", w), self.conv[w], gc + 1e-3 * self.conv[w], step)
                    adam(("b", w), self.cb[w], gb, step)
                hit = np.flatnonzero(np.abs(ge).sum(1))
                hit = hit[used[hit] != PAD]
                adam("emb", self.emb, ge[hit], step, used[hit])
        self.ob = np.float32(ob[0])
        self.prepare()

    def _pooled_local(self, docs, small, pad):
        gap = np.full(max(WIDTHS) - 1, pad, np.int32)
        starts = np.cumsum([0, *(len(d) + len(gap) for d in docs)])[:-1]
        ids = np.concatenate([x for d in docs for x in (d, gap)])
        best, at = [], []
        for w, (width, b) in enumerate(zip(WIDTHS, self.cb, strict=True)):
            n = len(ids) - width + 1
            act = small[w][0][ids[:n]]
            for j in range(1, width):
                act = act + small[w][j][ids[j : n + j]]
            top = _top(act, starts, docs)
            best.append(np.maximum(top + b, 0))
            at.append(np.stack([_first_max(act[:, f], starts, top[:, f]) for f in range(FILTERS)], 1))
        return np.concatenate(best, 1), at, ids

    def calibrate(self, docs, y, langs: list, cut: float) -> None:
        """Platt scaling, then per language the threshold with the best F1 among held-back rows, drawn to the common one where they are few."""
        z = np.concatenate([self.logit(docs[k : k + 64]) for k in range(0, len(docs), 64)])
        target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
        z = np.clip(z, -30, 30)

        def loss(a, b):
            u = a * z + b
            return (np.logaddexp(0, u) - target * u).sum() + 2.0 * (a - 1) ** 2 + 0.1 * b * b

        a, b = 1.0, 0.0
        for _ in range(40):  # Newton steps, halved until they help
            p = _sigmoid(a * z + b)
            w = p * (1 - p)
            ga, gb = ((p - target) * z).sum() + 4.0 * (a - 1), (p - target).sum() + 0.2 * b
            haa, hab, hbb = (w * z * z).sum() + 4.0, (w * z).sum(), w.sum() + 0.2
            det = haa * hbb - hab * hab
            da, db, t = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det, 1.0
            while t > 1e-6 and loss(a - t * da, b - t * db) > loss(a, b):
                t /= 2
            a, b = a - t * da, b - t * db
        self.scale = (float(np.clip(a, 0.1, 5)), float(b))
        s = _sigmoid(self.scale[0] * z + self.scale[1])
        grid = np.arange(0.3, 0.91, 0.05)

        def f1(own):
            return [2 * (y[own] * (s[own] >= t)).sum() / max(1, y[own].sum() + (s[own] >= t).sum()) for t in grid]

        for lang in sorted({x for x in langs if x is not None}):
            own = np.array([x == lang for x in langs])
            n = y[own].sum()
            self.thresholds[lang] = float((grid[int(np.argmax(f1(own)))] * n + cut * 20) / (n + 20))


def _first_max(act: np.ndarray, starts: np.ndarray, top: np.ndarray) -> np.ndarray:
    ends = np.append(starts[1:], len(act))
    hits = np.flatnonzero(act == np.repeat(top, np.maximum(np.append(np.diff(starts), len(act) - starts[-1]), 0)))
    at = np.searchsorted(hits, starts)
    return np.minimum(hits[np.minimum(at, len(hits) - 1)], ends - 1)


def train(texts: list, labels: list, langs: list, cut: float = 0.7, seed: int = 7) -> TextCNN:
    """Fits on four fifths of the rows, calibrates on the rest, then fits on all with that calibration."""
    y = np.array(labels, float)
    seen = Buckets()
    docs = [word_ids(t, seen) for t in texts]
    model = TextCNN(seed)
    if len(y) < 10 or y.sum() in (0, len(y)):
        model.out[:] = 0
        rate = np.clip(y.mean() if len(y) else 0.0, 1e-6, 1 - 1e-6)
        model.ob = np.float32(np.log(rate / (1 - rate)))
        model.prepare()
        return model
    back = np.arange(len(y)) % 5 == 0
    if not 0 < y[back].sum() < back.sum() or not 0 < y[~back].sum():
        back = np.zeros(len(y), bool)
    model.fit([d for d, b in zip(docs, back, strict=True) if not b], y[~back])
    held = back if back.any() else ~back
    model.calibrate([d for d, b in zip(docs, held, strict=True) if b], y[held], [x for x, b in zip(langs, held, strict=True) if b], cut)
    final = TextCNN(seed)
    final.fit(docs, y)
    final.scale, final.thresholds = model.scale, model.thresholds
    del docs, seen, model
    release()  # the driver goes on to other stages
    return final


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[list, list, list]:
    """A bounded, repeatable sample of labelled rows: those with the least hashes of their ids."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # the ids of the sample are chosen before any text is joined
    chosen = known.orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(sample)
    got = docs.select("doc_id", "text", "lang").join(F.broadcast(chosen), "doc_id")
    # of an id that repeats one row is taken: the least text
    got = got.groupBy("doc_id").agg(F.min_by(F.struct("text", "lang", "toxic"), F.struct("text", "lang")).alias("r")).select("doc_id", "r.*")
    rows = got.collect()
    rows.sort(key=lambda r: (zlib.crc32(str(r[0]).encode()), r[0], r[1] or ""))
    return [r[1] for r in rows], [int(r[3] > 0) for r in rows], [r[2] for r in rows]


def score_of(model: TextCNN, text: Column) -> Column:
    """The score of a text; only the text goes to Python, and only its score comes back."""
    shared = SparkSession.getActiveSession().sparkContext.broadcast(pickle.dumps(model.__dict__ | {"table": None}))  # of fixed size

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = TextCNN.__new__(TextCNN)
        m.__dict__ = pickle.loads(shared.value)
        m.prepare()
        seen = Buckets()
        for b in batches:
            out, held, size = [], [], 0
            for k in range(0, len(b), 64):
                for t in b.slice(k, 64).to_pylist():
                    held.append(word_ids(t, seen))
                    size += len(held[-1])
                if size >= PLACES:
                    out.append(m.score(held))
                    held, size = [], 0
            if held:
                out.append(m.score(held))
            yield pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())
        release()

    return scored(text)


def flag_of(model: TextCNN, score: Column, lang: Column, cut: float = 0.7) -> Column:
    """True where the score reaches the threshold of its language (``cut`` for others)."""
    known = F.create_map(*[F.lit(x) for p in sorted(model.thresholds.items()) for x in p]) if model.thresholds else None  # languages of the labelled sample only
    limit = F.coalesce(F.element_at(known, lang), F.lit(cut)) if known is not None else F.lit(cut)
    return score >= limit


def toxicity(df: DataFrame, model: TextCNN, cut: float = 0.7, text_col: str = "text") -> DataFrame:
    """Adds score, predicted (1 if score >= cut) and flagged (1 if score >= its language's threshold) to the rows.

    Columns of the input with these names give way to the result; a filter that
    must keep them uses ``score_of`` and ``flag_of``.
    """
    old = [c for c in df.columns if c not in ("score", "predicted", "flagged")]
    lang = F.col("lang") if "lang" in old else F.lit(None).cast("string")
    out = df.select(*[F.col(f"`{c}`") for c in old], score_of(model, F.col(f"`{text_col}`")).alias("score"))
    s = F.col("score")
    return out.withColumns({"predicted": (s >= cut).cast("int"), "flagged": flag_of(model, s, lang, cut).cast("int")})


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; labels of the held-out third are never read for training."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(fold(F.col("doc_id"), 3) != 1)
    model = train(*training_rows(docs, labels))
    out = toxicity(docs.select("doc_id", "lang", "text"), model)
    return out.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted", "flagged")
