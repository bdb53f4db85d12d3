"""Operator 10, LM scoring: a causal self-attention model over subword ids.

Texts are cut into words once.  A block of texts becomes numbers into the list of
its distinct words; the words go to hash buckets, where all uses of a word meet:
its count in the training texts and its subword ids (byte-level BPE, a public
vocabulary) are worked out there, once, and sent back to the blocks.  Blocks with
all they need (``gathered``) are written as a table; training and scoring are
maps over it.

A word is a chain of subword ids.  The class of its first id is predicted by
masked self-attention over the subword embeddings of the words before it
(``attention``); the first id given its class, and each further id given those
before it in the word, have the shares that exact counts over all training texts
give them.  The product of these shares is the word's count over its class's, so
the whole is a distribution over known words and one unknown word of each class.
Predicting an end id and the further ids by attention too would take a softmax
for each of some 2.5 ids a word, at several times the cost.

The network learns from every training text once and whole: in each of ``ROUNDS``
rounds partitions learn from that round's blocks side by side, and their weights
are averaged.  Long texts are scored in overlapping windows, each token in one.

Defined results: null and empty texts consist of the end token alone; rows are
kept one for one, null and repeated ids too (equal texts get equal scores, up to
the order of sums); other columns, whatever their names, are ignored; with no
training texts every count is 0 and every class as likely as its share; an empty
table gives an empty result.
"""

from __future__ import annotations

import functools
import json
import pickle
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .attention import CLASSES, DIM, N_IDS, Attention, Bags, Trainer
from .blocks import PACKED, Numbers, blocks, compact, pack, packed_batches, planes, release, unpack, unplanes
from .common import fan_out, fold, materialise, steady, table

#: Passes over disjoint parts of the blocks, and by which remainders of their hashes modulo 4 they are dealt.
ROUNDS = ((0,), (1, 2, 3))
RATE = 0.008
#: Rows of the embedding that are averaged together.
ROWS = 512
#: Bytes of text of a block.
BLOCK = 6 << 20
END = b" "  # the end token; no word holds a space
LOG10 = float(np.log(10))


def words(text: str | None) -> list[bytes]:
    """Words of the text with A-Z in lower case, then the end token."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    w.append(END)
    return w


@functools.lru_cache(1)
def _encoder(path: str):
    """A function from texts to subword ids.

    Where each merge of a byte-level vocabulary makes the next id, ids are ranks,
    and a rank encoder gives the same ids with less work for each short text.
    """
    from .token_counts import PRETOKEN, _tokenizer

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab, merges = model["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ", 1)) for m in model["merges"]]
    if all(vocab.get(a + b) == 256 + k for k, (a, b) in enumerate(merges)):
        import tiktoken

        # the usual printable stand-ins of bytes
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(x for x in range(256) if x not in plain)}
        ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items() if i < 256 + len(merges)}
        whole = tiktoken.Encoding("ranks", pat_str=PRETOKEN, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [whole.encode_ordinary(t) for t in texts]
    return lambda texts: [e.ids for e in _tokenizer(path)[0].encode_batch_fast(texts, add_special_tokens=False)]


def subwords(path: str, some: list[bytes]) -> list[list[int]]:
    """Subword ids of words, each as it stands after a space; special strings in them are ordinary text."""
    return _encoder(path)([" " + w.decode("utf-8", "replace") for w in some])


def class_table(uses: np.ndarray) -> np.ndarray:
    """Class by first subword id: the commonest ids of training words have one each, the rest are dealt by number; class 0 is the end token's."""
    own = CLASSES - 1 - CLASSES // 8
    top = [i for i in np.lexsort((np.arange(len(uses)), -uses))[:own].tolist() if uses[i]]
    out = 1 + len(top) + np.arange(len(uses)) % (CLASSES - 1 - len(top))
    out[top] = 1 + np.arange(len(top))
    return out


# blocks ----------------------------------------------------------------------


def numbered(texts: list[str], train: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words, commonest first; their uses in training texts; the words of all texts by number; words by text."""
    cut = [words(t) for t in texts]
    lengths = np.fromiter(map(len, cut), np.int64, len(cut))
    ids = Numbers()
    flat = np.fromiter(map(ids.__getitem__, chain.from_iterable(cut)), np.int32, int(lengths.sum()))
    uses = np.bincount(flat, minlength=len(ids))
    order = np.argsort(-uses, kind="stable")
    rank = np.empty(len(ids), np.int32)
    rank[order] = np.arange(len(ids), dtype=np.int32)
    terms = list(ids)
    flat = rank[flat]
    return [terms[k] for k in order.tolist()], np.bincount(flat[np.repeat(train, lengths)], minlength=len(ids)), flat, lengths


def _bag_rows(batches, n_buckets: int):
    """Rows by bucket: (block, 0, distinct words with their numbers and uses) and (block, 1, the texts in numbers)."""
    for name, others, texts in blocks(batches, BLOCK):
        held = np.array([r["held_out"] for r in others], bool)
        terms, uses, flat, lengths = numbered(texts, ~held)
        bucket = np.fromiter(map(zlib.crc32, terms), np.int64, len(terms)) % n_buckets
        order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
        for a, z in zip(cuts, [*cuts[1:], len(order)], strict=True):
            own = order[a:z]
            yield int(bucket[own[0]]), name, 0, pack(([terms[k] for k in own.tolist()], compact(own), compact(uses[own])))
        yield zlib.crc32(name.encode()) % n_buckets, name, 1, pack(([r["doc_id"] for r in others], np.packbits(held), compact(lengths), planes(flat), len(terms), terms.index(END), len(cuts)))


def _counted(path: str):
    def run(t: pa.Table) -> pa.Table:
        rows = list(zip(*(t.column(i).to_pylist() for i in range(4)), strict=True))
        here = rows[0][0]
        bags = [(block, *unpack(payload)) for _, block, kind, payload in rows if not kind]
        numbers = Numbers()
        n_terms = [len(b[1]) for b in bags]
        every_use = np.fromiter(map(numbers.__getitem__, chain.from_iterable(b[1] for b in bags)), np.int64, sum(n_terms))
        every = list(numbers)
        total = np.zeros(len(every), np.int64)
        np.add.at(total, every_use, np.concatenate([b[3].astype(np.int64) for b in bags]) if bags else np.zeros(0, np.int64))
        sizes, ids = [], []
        for a in range(0, len(every), 20_000):
            got = subwords(path, every[a : a + 20_000])
            sizes.append(np.fromiter(map(len, got), np.int64, len(got)))
            ids.append(np.fromiter(chain.from_iterable(got), np.uint16, int(sizes[-1].sum())))
        sizes, ids = np.concatenate([np.zeros(0, np.int64), *sizes]), np.concatenate([np.zeros(0, np.uint16), *ids])
        starts = np.cumsum(sizes) - sizes
        out = [(here, block, kind, payload) for _, block, kind, payload in rows if kind]
        cuts = np.cumsum([0, *n_terms])
        for (block, _, own, _), a, z in zip(bags, cuts, cuts[1:], strict=False):
            k = every_use[a:z]
            n = sizes[k]
            flat = ids[np.repeat(starts[k] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            out.append((here, block, 0, pack((own, compact(total[k]), compact(n), flat))))
        # training uses and kinds of words by first subword id; the end token stands after the ids
        first = ids[starts].astype(np.int64) if len(every) else np.zeros(0, np.int64)
        if END in numbers:
            first[numbers[END]] = N_IDS
        known = total > 0
        at, inv = np.unique(first[known], return_inverse=True)
        out.append((here, f"#{here}", 2, pack((at, np.bincount(inv, total[known], len(at)).astype(np.int64), np.bincount(inv, minlength=len(at))))))
        release()
        return pa.Table.from_batches(list(packed_batches(out)))

    return run


def _gathered(t: pa.Table) -> pa.Table:
    """One row of a block with all that training and scoring need of it."""
    block, meta, answers = t.column("block")[0].as_py(), None, []
    for kind, payload in zip(t.column("kind").to_pylist(), t.column("payload").to_pylist(), strict=True):
        if kind == 2:
            return pa.table({"block": pa.array([block]), "kind": pa.array([2], pa.int32()), "payload": pa.array([payload], pa.binary())})
        if kind:
            meta = unpack(payload)
        else:
            answers.append(unpack(payload))
    if meta is None or len(answers) != meta[6]:
        raise RuntimeError("the input came in another order when a task was run again")
    doc_ids, held, lengths, flat, n_terms, end, _ = meta
    own = np.concatenate([a[0] for a in answers]).astype(np.int64)
    count, sizes, ids = np.zeros(n_terms, np.int64), np.zeros(n_terms, np.int64), np.concatenate([a[3] for a in answers])
    count[own], sizes[own] = np.concatenate([a[1] for a in answers]), np.concatenate([a[2] for a in answers])
    n = np.concatenate([a[2] for a in answers]).astype(np.int64)
    starts = np.empty(n_terms, np.int64)
    starts[own] = np.cumsum(n) - n
    ids = ids[np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]
    whole = pack((doc_ids, held, lengths, flat, compact(count), compact(sizes), ids, end))
    release()
    return pa.table({"block": pa.array([block]), "kind": pa.array([1], pa.int32()), "payload": pa.array([whole], pa.binary())})


class Block:
    """A gathered block: texts as numbers of words from 1, and what is known of these."""

    def __init__(self, payload: bytes, classes: np.ndarray):
        self.doc_ids, held, lengths, flat, count, sizes, ids, end = unpack(payload)
        self.lengths, self.words = lengths.astype(np.int64), unplanes(flat).astype(np.int64) + 1
        self.held = np.unpackbits(held, count=len(self.lengths)).astype(bool)
        self.count, sizes, ids = count.astype(np.int64), sizes.astype(np.int64), ids.astype(np.int64)
        own = classes[ids[np.cumsum(sizes) - sizes]]
        own[end] = 0
        self.bags = Bags(ids, sizes, own)


def _payloads(batches):
    for b in batches:
        for x in b.column("payload"):
            yield x.as_py()


# training --------------------------------------------------------------------


def learn_all(gathered: DataFrame, classes: np.ndarray, seed: int = 5, rate: float = RATE) -> dict:
    """Weights after one pass over all training texts, each whole and in one of the rounds.

    Partitions begin a round with the same weights.  What they end it with is
    averaged in chunks, dense weights by places and rows of the embedding by uses,
    so rows that few partitions met are theirs.  Batches follow the partitions,
    so the last digits of the weights depend on how the input is cut.
    """
    spark = gathered.sparkSession
    net = Attention(seed)
    state = {"p": net.p, "s": {k: np.zeros_like(v) for k, v in net.p.items()}, "step": 0, "learnt": 0}
    dense = [k for k in net.p if k != "emb"]
    for r, parts in enumerate(ROUNDS):
        shared = spark.sparkContext.broadcast(pickle.dumps((state, classes)))  # of fixed size
        now = rate * (1 - 0.6 * r)

        def learn(batches, shared=shared, now=now):
            own, classes = pickle.loads(shared.value)
            net = Attention()
            net.p = own["p"]
            trainer = Trainer(net, now, own["s"], own["step"])
            for payload in _payloads(batches):
                b = Block(payload, classes)
                train = ~b.held
                trainer.texts(b.bags, b.words[np.repeat(train, b.lengths)], b.lengths[train], np.random.default_rng(zlib.crc32(payload[:4096])))
            release()
            if not trainer.places:
                return
            part, rows = TaskContext.get().partitionId(), [(-1, ({k: (net.p[k], trainer.s[k]) for k in dense}, trainer.places, trainer.step))]
            for at in range(0, N_IDS, ROWS):
                met = at + np.flatnonzero(trainer.uses[at : at + ROWS])
                if len(met):
                    rows.append((at // ROWS, (met, np.concatenate([net.p["emb"][met], trainer.s["emb"][met]], 1), trainer.uses[met])))
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([x[0] for x in rows], pa.int32()), "part": pa.array([part] * len(rows), pa.int32()), "payload": pa.array([pickle.dumps(x[1], protocol=5) for x in rows], pa.binary())})

        def averaged(t: pa.Table) -> pa.Table:
            chunk = t.column("chunk")[0].as_py()
            total, weight, step = None, 0, 0
            for _, payload in sorted(zip(t.column("part").to_pylist(), t.column("payload").to_pylist(), strict=True)):
                if chunk < 0:
                    value, n, at = pickle.loads(payload)
                    total = {k: [n * x.astype(float) + (total[k][i] if total else 0) for i, x in enumerate(v)] for k, v in value.items()}
                    weight, step = weight + n, max(step, at)
                else:
                    met, value, n = pickle.loads(payload)
                    if total is None:
                        total, weight = np.zeros((ROWS, 2 * DIM)), np.zeros(ROWS)
                    total[met - chunk * ROWS] += n[:, None] * value
                    weight[met - chunk * ROWS] += n
            if chunk < 0:
                out = {k: [(x / weight).astype(np.float32) for x in v] for k, v in total.items()}, weight, step
            else:
                at = np.flatnonzero(weight)
                out = chunk * ROWS + at, (total[at] / weight[at, None]).astype(np.float32)
            return pa.table({"chunk": pa.array([chunk], pa.int32()), "payload": pa.array([pickle.dumps(out, protocol=5)], pa.binary())})

        some = gathered.where(F.col("kind") == 1).where(F.pmod(F.xxhash64("block"), F.lit(4)).isin(*parts)).select("payload")
        met = some.mapInArrow(learn, "chunk int, part int, payload binary").groupBy("chunk").applyInArrow(averaged, "chunk int, payload binary")
        p, s = ({k: v.copy() for k, v in state[x].items()} for x in "ps")
        for chunk, payload in met.collect():  # of fixed size: the weights
            got = pickle.loads(bytes(payload))
            if chunk < 0:
                p |= {k: v[0] for k, v in got[0].items()}
                s |= {k: v[1] for k, v in got[0].items()}
                state |= {"step": got[2], "learnt": state["learnt"] + got[1]}
            else:
                p["emb"][got[0]], s["emb"][got[0]] = got[1][:, :DIM], got[1][:, DIM:]
        state |= {"p": p, "s": s}
        shared.unpersist()
    return state


# the operator ----------------------------------------------------------------


def gather(df: DataFrame, tokenizer: str, held_out) -> DataFrame:
    """(block, kind, payload): blocks of texts in numbers (kind 1) and counts by first subword id (kind 2), written as a table."""
    docs = steady(df.select("doc_id", "text", held_out.alias("held_out")))
    n_buckets = fan_out(df, bytes_each=32 << 20, factor=1)

    def bags(batches):
        yield from packed_batches(_bag_rows(batches, n_buckets), 64)
        release()

    met = docs.mapInArrow(bags, PACKED).groupBy("bucket").applyInArrow(_counted(tokenizer), PACKED)
    return materialise(met.groupBy("block").applyInArrow(_gathered, "block string, kind int, payload binary"))


def counts(gathered: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Training uses and distinct words by first subword id, the end token after the ids; added up partition by partition."""

    def added(batches):
        uses, kinds = np.zeros(N_IDS + 1, np.int64), np.zeros(N_IDS + 1, np.int64)
        for x in _payloads(batches):
            at, u, k = unpack(x)
            uses[at] += u
            kinds[at] += k
        yield pa.RecordBatch.from_pydict({"payload": pa.array([pack((uses, kinds))], pa.binary())})

    uses, kinds = np.zeros(N_IDS + 1, np.int64), np.zeros(N_IDS + 1, np.int64)
    for (x,) in gathered.where("kind = 2").select("payload").mapInArrow(added, "payload binary").toLocalIterator():
        u, k = unpack(bytes(x))
        uses, kinds = uses + u, kinds + k
    return uses, kinds


def lm_scores(df: DataFrame, tokenizer: str, held_out) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row; rows where ``held_out`` is false are learnt from."""
    from pyspark.sql.pandas.types import to_arrow_type

    id_type = df.schema["doc_id"].dataType
    kind_of_id = to_arrow_type(id_type)
    gathered = gather(df, tokenizer, held_out)
    uses, kinds = counts(gathered)
    total, distinct = int(uses.sum()), int(kinds.sum())
    classes = class_table(uses[:N_IDS])
    state = learn_all(gathered, classes)
    mass = np.bincount(classes, weights=uses[:N_IDS] + 0.5 * kinds[:N_IDS], minlength=CLASSES)
    mass[0] += uses[N_IDS] + 0.5 * kinds[N_IDS]
    bottom = total + 0.5 * (distinct + 1)
    # each class has an unknown word of its own, with the weight of half a use
    log_share = np.log((mass + 0.5) / bottom)
    whole = df.sparkSession.sparkContext.broadcast(pickle.dumps((state["p"], classes, log_share)))  # of fixed size

    def scored(batches):
        p, classes, log_share = pickle.loads(whole.value)
        net = Attention()
        net.p = p
        for payload in _payloads(batches):
            b = Block(payload, classes)
            starts = np.cumsum(b.lengths) - b.lengths
            own = b.words - 1
            gain = net.scores(b.bags, b.words, b.lengths) - log_share[b.bags.classes[b.words]] if total else np.zeros(len(own))
            base = np.add.reduceat(np.log10(b.count + 0.5)[own], starts) - b.lengths * np.log10(bottom)
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array(b.doc_ids, kind_of_id), "held_out": pa.array(b.held), "n_tokens": pa.array(b.lengths), "n_known": pa.array(np.add.reduceat((b.count > 0)[own].astype(np.int64), starts)),
                "train_tokens": pa.array(np.full(len(b.lengths), total, np.int64)), "base_score": pa.array(base), "score": pa.array(base + np.add.reduceat(gain, starts) / LOG10),
            })
        release()

    schema = f"doc_id {id_type.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return gathered.where("kind = 1").select("payload").mapInArrow(scored, schema)


def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model log10 probabilities of all documents; one document in five is held out."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lm_scores(docs, public_tokenizers.path("byte_bpe_50k.json"), fold(F.col("doc_id"), 5) == 1)
