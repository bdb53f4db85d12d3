"""Prose fingerprints, candidate pairs and their regions on packed rows.

The same results as ``lex_prose``, ``fingerprint`` and ``matching`` give, for ids
that are whole numbers, but neither tokens nor position pairs become rows: a
document is hashed where it is read, its fingerprints travel in compressed columns
to the buckets of their hashes, and the shared ones from there to the tasks that
compare documents.  Documents that are compared with each other meet in few tasks.
"""

from __future__ import annotations

import functools
import hashlib
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..params import BASES, MODULI, Params

#: Fingerprints that a task gathers before it packs them, and position pairs looked at together.
BLOCK, CHUNK = 1 << 20, 1 << 20
#: Documents of a cluster whose regions are found in one place.
HOME = 32
#: Columns of a packed fingerprint: both hashes as one number, document, place in tokens, first and end byte of its k-gram.
FP = ("h", "doc", "pos", "start", "end")
#: Both moduli lie under 2^30.
HALF = 30


def pack(*columns: np.ndarray) -> bytes:
    """Whole numbers as differences (the first column as it is), byte by byte, compressed."""
    n = len(columns[0])
    planes = [np.ascontiguousarray((c if i == 0 else np.diff(c, prepend=0)).astype("<i8").view("u1").reshape(n, 8).T).tobytes() for i, c in enumerate(columns)]
    return n.to_bytes(4, "little") + pa.compress(b"".join(planes), "zstd", asbytes=True)


def unpack(blob: bytes, columns: int) -> list[np.ndarray]:
    n = int.from_bytes(blob[:4], "little")
    planes = np.frombuffer(pa.decompress(blob[4:], n * 8 * columns, "zstd", asbytes=True), "u1").reshape(columns, 8, n)
    out = [np.ascontiguousarray(p.T).view("<i8").reshape(n) for p in planes]
    return [c if i == 0 else np.cumsum(c) for i, c in enumerate(out)]


def merged(blobs, columns: int) -> list[np.ndarray]:
    parts = [unpack(b, columns) for b in blobs]
    return [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0, "i8")] * columns


@functools.lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Of each code point: whether it is a letter or number, and its bytes in UTF-8."""
    cp = np.arange(0x110000)
    word = np.fromiter((unicodedata.category(chr(i))[0] in "LN" for i in range(0x110000)), "?", 0x110000)
    word[0x2EBF0:0x2EE5E] = False  # younger than the Unicode version of the SQL's patterns
    return word, (1 + (cp > 0x7F) + (cp > 0x7FF) + (cp > 0xFFFF)).astype("i8")


class _Ids(dict):
    """Numbers of words, as ``word_id`` gives them."""

    def __missing__(self, word: str) -> int:
        if len(self) > 1 << 20:
            self.clear()
        self[word] = got = int(hashlib.md5(word.encode()).hexdigest()[:6], 16)
        return got


_IDS = _Ids()


def words(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the words of a text, in lower case, with their first and end bytes.

    Case is changed code point by code point, so the words of the text and of its
    lower case are the same.
    """
    table, width = _tables()
    points = lambda s: np.frombuffer(s.encode("utf-32-le"), "<u4")
    cp = points(text)
    inside = table[cp]
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    at = np.concatenate(([0], np.cumsum(width[cp])))
    low = points(text.replace("İ", "i").replace("Σ", "σ").lower())
    spaced = np.where(inside, low, 32).astype("<u4").tobytes().decode("utf-32-le")
    get = _IDS.__getitem__
    return np.array([get(w) for w in spaced.split()], "i8"), at[edge[::2]], at[edge[1::2]]


def fingerprint(text: str, k: int, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, pos, start, end) of the winnowed k-grams of a text, by place."""
    ids, start, end = words(text)
    n = len(ids) - k + 1
    if n < 1:
        return (np.zeros(0, "i8"),) * 4
    h1, h2 = (sum(ids[j : j + n] * pow(base, k - 1 - j, mod) for j in range(k)) % mod for base, mod in zip(BASES, MODULI, strict=True))
    g = (h1 << HALF) | h2
    wide = min(n, w)
    best, at = g[wide - 1 :], np.arange(wide - 1, n)
    for j in range(1, wide):  # the rightmost of equals stays
        less = g[wide - 1 - j : n - j] < best
        best, at = np.where(less, g[wide - 1 - j : n - j], best), np.where(less, np.arange(wide - 1 - j, n - j), at)
    pos = np.unique(at)
    return g[pos], pos, start[pos], end[pos + k - 1]


def runs(*keys: np.ndarray) -> np.ndarray:
    """Where a run of equal sorted keys begins, and the end of all."""
    n = len(keys[0])
    new = np.ones(n, "?")
    if n:
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.append(np.flatnonzero(new), n)


def even(spark: SparkSession, n: int) -> np.ndarray:
    """n numbers whose hashes Spark deals evenly over its shuffle partitions."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    at = spark.range(16 * n, numPartitions=1).select(F.pmod(F.hash("id"), F.lit(parts)).alias("at")).toPandas()["at"].to_numpy()
    order = np.argsort(at, kind="stable")
    size = np.bincount(at, minlength=parts)
    nth = np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)
    return np.sort(order[np.argsort(nth, kind="stable")][:n])  # the first of each partition, then the second


def dealt(x: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """One of the numbers for each x."""
    y = x.astype("u8") * np.uint64(0x9E3779B97F4A7C15)
    return numbers[((y >> np.uint64(32)) % np.uint64(len(numbers))).astype("i8")]


def _split(key: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(key, kind="stable")
    cut = runs(key[order])
    for lo, hi in zip(cut[:-1], cut[1:], strict=True):
        yield int(key[order[lo]]), order[lo:hi]


def _few(cols: list[np.ndarray], most: int) -> list[np.ndarray]:
    """Without what hashes of over most + 1 documents have beyond so many: they are excluded whatever follows."""
    order = np.argsort(cols[0], kind="stable")
    h, doc = cols[0][order], cols[1][order]
    cut = runs(h)
    if len(h) == 0 or np.diff(cut).max() <= most:
        return cols
    new = np.ones(len(h), "?")
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    nth = np.cumsum(new)
    nth -= np.repeat(nth[cut[:-1]], np.diff(cut)) - 1
    keep = np.sort(order[nth <= most + 1])
    return [c[keep] for c in cols]


def packed(submissions: DataFrame, p: Params, buckets: np.ndarray, starter: bool = False) -> DataFrame:
    """(bucket, grp, blob): fingerprints of whole texts by hash; of starter texts (no group) the hashes only."""

    def run(batches):
        held: dict = {}
        count = 0

        def flush():
            for grp, parts in held.items():
                cols = [np.concatenate(c) for c in zip(*parts, strict=True)]
                if starter:
                    h = np.unique(cols[0])
                    cols = [h, *[np.zeros_like(h)] * 4]
                cols = _few(cols, p.corpus_cap)
                out = [(b, pack(*[c[at] for c in cols])) for b, at in _split(dealt(cols[0], buckets))]
                yield pa.RecordBatch.from_pydict({"bucket": pa.array([b for b, _ in out], pa.int64()), "grp": pa.array([grp] * len(out), pa.string()), "blob": pa.array([x for _, x in out], pa.binary())})
            held.clear()

        for batch in batches:
            for grp, doc, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                h, *places = fingerprint(text or "", p.k, p.w)
                if len(h):
                    held.setdefault(None if starter else grp, []).append((h, np.full(len(h), doc, "i8"), *places))
                    count += len(h)
                if count >= BLOCK:
                    yield from flush()
                    count = 0
        yield from flush()

    s = submissions.where("grp is not null and sub_id is not null").select("grp", F.col("sub_id").cast("long"), "source")
    return s.mapInArrow(run, "bucket long, grp string, blob binary")


def _pairs_of(doc: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (a, b), a before b, within each run."""
    size = np.diff(cut)
    a, b = [np.zeros(0, "i8")], [np.zeros(0, "i8")]
    for n in np.unique(size):
        table = doc[cut[:-1][size == n][:, None] + np.arange(n)]
        i, j = np.triu_indices(n, 1)
        a.append(table[:, i].ravel())
        b.append(table[:, j].ravel())
    return np.concatenate(a), np.concatenate(b)


def shared(blobs: DataFrame, sizes: dict[str, int], p: Params, parts: np.ndarray) -> DataFrame:
    """(kind, part, grp, blob) from each bucket: 'pair' (shared hashes of a and b, by a's part) and 'list' (fingerprints that are not excluded and in two documents at least, by document's part)."""

    def run(key, table):
        by = _by_group(table)
        gone = np.unique(merged(by.pop(None, []), 5)[0])
        out = []
        for grp, mine in by.items():
            cols = merged(mine, 5)
            order = np.argsort(cols[0], kind="stable")
            many = np.diff(cut := runs(cols[0][order]))
            cols = [c[order[np.repeat(many > 1, many)]] for c in cols]
            cols = [c[~np.isin(cols[0], gone)] for c in cols] if len(gone) else cols
            order = np.lexsort((cols[2], cols[1], cols[0]))
            cols = [c[order] for c in cols]
            h, doc = cols[:2]
            one = runs(h, doc)[:-1]  # a document once a hash
            cut = runs(h[one])
            df = np.diff(cut)
            ok = (df > 1) & (df <= p.corpus_cap) & (df / sizes.get(grp, 1 << 60) <= p.max_freq)
            kept = np.repeat(ok, np.diff(np.append(one, len(h))[cut])) if len(h) else np.zeros(0, "?")
            docs = doc[one][np.repeat(ok, df)]
            names, code = np.unique(docs, return_inverse=True)
            a, b = _pairs_of(code, np.append(0, np.cumsum(df[ok])))
            pair, n = np.unique(a * max(1, len(names)) + b, return_counts=True)
            a, b = names[pair // max(1, len(names))], names[pair % max(1, len(names))]
            out += [("pair", q, grp, pack(n[at], a[at], b[at])) for q, at in _split(dealt(a, parts))]
            cols = [c[kept] for c in cols]
            order = np.lexsort((cols[2], cols[1]))
            cols = [c[order] for c in cols]
            out += [("list", q, grp, pack(*[c[at] for c in cols])) for q, at in _split(dealt(cols[1], parts))]
        return pa.table({n: pa.array([r[i] for r in out], t) for i, (n, t) in enumerate((("kind", pa.string()), ("part", pa.int64()), ("grp", pa.string()), ("blob", pa.binary())))})

    return blobs.groupBy("bucket").applyInArrow(run, "kind string, part long, grp string, blob binary")


def _by_group(table: pa.Table) -> dict:
    by: dict = {}
    for grp, blob in zip(table["grp"].to_pylist(), table["blob"].to_pylist(), strict=True):
        by.setdefault(grp, []).append(blob)
    return by


def candidates(found: DataFrame, p: Params) -> DataFrame:
    """(grp, a, b, shared) of pairs with enough hashes in common."""

    def run(key, table):
        out = []
        for grp, blobs in _by_group(table).items():
            n, a, b = merged(blobs, 3)
            order = np.lexsort((b, a))
            a, b = a[order], b[order]
            cut = runs(a, b)
            total = np.add.reduceat(n[order], cut[:-1])
            first = cut[:-1][total >= p.min_shared]
            out.append(pa.table({"grp": pa.array([grp] * len(first), pa.string()), "a": a[first], "b": b[first], "shared": total[total >= p.min_shared]}))
        return pa.concat_tables(out)

    return found.where("kind = 'pair'").groupBy("part").applyInArrow(run, "grp string, a long, b long, shared long")


def lists(found: DataFrame) -> DataFrame:
    """(grp, doc, blob): the shared fingerprints of each document, by place."""

    def run(key, table):
        out = []
        for grp, blobs in _by_group(table).items():
            cols = merged(blobs, 5)
            order = np.lexsort((cols[2], cols[1]))
            cols = [c[order] for c in cols]
            cut = runs(cols[1])
            own = [pack(*[cols[i][lo:hi] for i in (0, 2, 3, 4)]) for lo, hi in zip(cut[:-1], cut[1:], strict=True)]
            out.append(pa.table({"grp": pa.array([grp] * len(own), pa.string()), "doc": cols[1][cut[:-1]], "blob": pa.array(own, pa.binary())}))
        return pa.concat_tables(out)

    return found.where("kind = 'list'").groupBy("part").applyInArrow(run, "grp string, doc long, blob binary")


def regions(a, b, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """First and end bytes in a of the regions of two documents, longest first, at most max_regions.

    a: (hash, pos, start, end) by place; b: (hash, pos) by hash, then place.
    Position pairs come in order of both places, a chunk at a time.
    """
    lo, hi = np.searchsorted(b[0], a[0]), np.searchsorted(b[0], a[0], "right")
    has = np.flatnonzero(hi > lo)
    lo, n = lo[has], (hi - lo)[has]
    done = np.cumsum(n)
    firsts, lasts, last = [], [], None
    at = 0
    while at < len(has):
        to = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + CHUNK, "right")))
        m = n[at:to]
        ia = np.repeat(has[at:to], m)
        pa_, pb = a[1][ia], b[1][np.repeat(lo[at:to] - (np.cumsum(m) - m), m) + np.arange(len(ia))]
        new = np.ones(len(ia), "?")
        da, db = np.diff(pa_), np.diff(pb)
        new[1:] = ~((da <= p.w) & (db >= 1) & (db <= p.w))
        if last is not None:
            new[0] = not (pa_[0] - last[0] <= p.w and 1 <= pb[0] - last[1] <= p.w)
            if new[0]:
                lasts.append(np.array([last[2]]))
        begin = np.flatnonzero(new)
        firsts.append(ia[begin])
        lasts.append(ia[begin[begin > 0] - 1])
        last = (pa_[-1], pb[-1], ia[-1])
        at = to
    if last is None:
        return np.zeros(0, "i8"), np.zeros(0, "i8")
    first, end = np.concatenate(firsts), np.concatenate([*lasts, [last[2]]])
    # islands come in order of their first places
    best = np.argsort(a[1][first] - a[1][end], kind="stable")[: p.max_regions]
    return a[2][first[best]], a[3][end[best]]


def spans(lengths, start: np.ndarray, end: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, regions over it, the least of their ids or -1) of [0, length) cut at region borders inside it."""
    border = np.concatenate((start, end))
    cut = np.unique(np.concatenate(([0], lengths, border[(border > 0) & (border < max(lengths))])).astype("i8"))
    lo, hi = cut[:-1], cut[1:]
    n = np.searchsorted(np.sort(start), lo, "right") - np.searchsorted(np.sort(end), lo, "right")
    first = np.full(len(lo), -1, "i8")
    order = np.argsort(-ids, kind="stable")
    for i, j, least in zip(np.searchsorted(lo, start[order]).tolist(), np.searchsorted(hi, end[order], "right").tolist(), ids[order].tolist(), strict=True):
        first[i:j] = least
    return lo, hi, n, first


def document_spans(submissions: DataFrame, p: Params, starter: DataFrame | None = None, wide: int = 1 << 32) -> DataFrame:
    """(doc, start, end, n_regions, first_region): the texts cut at the borders of their regions as side a; a region's id is b * wide + its rank."""
    spark = submissions.sparkSession
    parts = even(spark, max(int(spark.conf.get("spark.sql.shuffle.partitions")), _bytes(submissions) >> 23))
    blobs = packed(submissions, p, parts)
    if starter is not None:
        blobs = blobs.union(packed(starter, p, parts, True))
    # a share of a larger group is over the cap anyway
    sizes = submissions.groupBy("grp").agg(F.countDistinct("sub_id").alias("n")).where((F.col("n") * p.max_freq <= p.corpus_cap) & F.col("grp").isNotNull())
    found = shared(blobs, {r.grp: r.n for r in sizes.collect()}, p, parts).persist()
    pairs = candidates(found, p).select("grp", "a", "b").persist()

    # documents of a cluster of copies have one home, so each is sent there once; a large cluster has several
    ends = pairs.select(F.col("a").alias("doc"), F.col("a").alias("near")).union(pairs.select("b", "a"))
    near = ends.groupBy("doc").agg(F.min("near").alias("near"))
    split = F.pmod(F.xxhash64("doc"), F.ceil(F.col("n") / HOME))
    index = F.pmod(F.xxhash64("near", split), F.lit(len(parts))).cast("int")
    home = near.join(near.groupBy("near").agg(F.count("*").alias("n")), "near").select("doc", F.get(F.lit(parts.tolist()), index).cast("long").alias("home"))
    placed = pairs.join(home.withColumnRenamed("doc", "a"), "a")
    need = placed.select("grp", F.col("a").alias("doc"), "home").union(placed.select("grp", "b", "home")).distinct()
    length = submissions.select(F.col("sub_id").cast("long").alias("doc"), F.octet_length("source").cast("long").alias("length")).where("length > 0")
    of = length.join(pairs.select(F.col("a").alias("doc")).distinct(), "doc", "left_semi").groupBy("doc").agg(F.collect_set("length").alias("lengths"))
    sent = need.join(lists(found), ["grp", "doc"]).select("home", "grp", "doc", F.lit(None).cast("long").alias("b"), "blob", F.lit(None).cast("array<long>").alias("lengths"))
    told = placed.select("home", "grp", F.col("a").alias("doc"), "b", F.lit(None).cast("binary").alias("blob"), F.lit(None).cast("array<long>").alias("lengths"))
    sized = of.join(home, "doc").select("home", F.lit(None).cast("string").alias("grp"), "doc", F.lit(None).cast("long").alias("b"), F.lit(None).cast("binary").alias("blob"), "lengths")

    def run(key, table):
        sides, partners, lengths = {}, {}, {}
        for _, grp, doc, b, blob, length in zip(*[c.to_pylist() for c in table.columns], strict=True):
            if blob is not None:
                sides[grp, doc] = blob
            elif b is not None:
                partners.setdefault(doc, []).append((grp, b))
            else:
                lengths[doc] = length

        @functools.lru_cache(256)
        def side(grp, doc):
            return unpack(sides[grp, doc], 4)

        @functools.lru_cache(256)
        def by_hash(grp, doc):
            h, pos = side(grp, doc)[:2]
            order = np.argsort(h, kind="stable")
            return h[order], pos[order]

        rows = []
        for doc, own in partners.items():
            start, end, ids = [], [], []
            for grp, b in own:
                s, e = regions(side(grp, doc), by_hash(grp, b), p)
                start.append(s)
                end.append(e)
                ids.append(b * wide + 1 + np.arange(len(s)))
            got = spans(lengths[doc], *map(np.concatenate, (start, end, ids)))
            rows.append((np.full(len(got[0]), doc, "i8"), *got))
        cols = [np.concatenate(c) for c in zip(*rows, strict=True)] if rows else [np.zeros(0, "i8")] * 5
        return pa.table(dict(zip(("doc", "start", "end", "n_regions", "first_region"), cols, strict=True)))

    schema = "doc long, start long, end long, n_regions long, first_region long"
    cut = sent.union(told).union(sized).groupBy("home").applyInArrow(run, schema)
    rest = length.join(pairs.select(F.col("a").alias("doc")).distinct(), "doc", "left_anti")
    return cut.union(_whole(rest))


def _whole(length: DataFrame) -> DataFrame:
    """Spans of texts without regions."""
    from pyspark.sql import Window as W

    least = F.lag("length", 1, 0).over(W.partitionBy("doc").orderBy("length"))  # an id may stand in two groups
    return length.distinct().select("doc", least.cast("long").alias("start"), F.col("length").alias("end"), F.lit(0).cast("long").alias("n_regions"), F.lit(-1).cast("long").alias("first_region"))


def _bytes(df: DataFrame) -> int:
    """The optimizer's estimate of the bytes behind a frame (files: their size)."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 50 else 0
