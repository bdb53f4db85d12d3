"""Operator 3, n-gram Jaccard join with PartEnum signatures.

Sets of word shingles are dealt to overlapping size bands, so that any two sets
that are similar enough share a band.  Within a band such sets differ in at most
k elements.  The domain is cut by hash in n1 > k / 2 parts of ``SUBPARTS``
subparts: some part then has at most one difference, so all but one of its
subparts are equal in both sets.  A set's signatures are the (part, all subparts
but one) projections; similar sets share one.

Projections of few elements say little, and empty ones are shared by chance, so
a set leaves out what it need not have: to spoil all projections of at least m
elements of one part takes 2 differences if all its projections are so large, 1
if some are.  The set keeps projections from the largest m at which spoiling all
parts takes more differences than it may have from any partner of the band.  Of
two similar sets the one with the larger m thus shares a projection that both
keep.  ``SLACK`` more parts than the least number leave room for a large m.

1. Equal sets are one node (64-bit hash of the set).
2. Blocks of documents make signatures; nodes that share one are tied to the
   first of them, inside the block at once, then across blocks in hash buckets:
   each signature costs as many rows as blocks have it, and ties are linear in
   them, never pairs.
3. Components of the ties are candidate clusters.  Only nodes in clusters are
   looked at again: their sets meet, once each, and a cluster's links are worked
   out exactly, from exact intersections.
4. A cluster beyond ``CLUSTER_SETS`` sets or ``CLUSTER_ELEMENTS`` elements is
   never gathered: rounds of pivots are compared with all its members, chunk by
   chunk, until every pair has been compared or is connected.

Defined results: null and blank texts have no shingle and link with nothing;
fewer words than a shingle has are one shingle; rows with equal ids are kept one
for one; null ids never name a component (all-null components have null); an empty
table gives an empty result; other columns, whatever their names, are returned by
``one_per_group`` as they are and ignored otherwise.  Words, shingles and sets go
by 64-bit hashes: among n different sets some n^2 / 2^65 pairs are taken for equal
by chance (3 among 10^10); rows go by 128 bits.
"""

from __future__ import annotations

import pickle
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import PACKED, blocks, pack, packed_batches, release, unpack
from .common import discard, fan_out, free, materialise, settle, table
from .components import components

#: Clusters of more sets or elements are worked on in chunks of so many sets, in rounds of at first PIVOTS pivots, four times as many each time up to MOST_PIVOTS.
CLUSTER_SETS = 400
CLUSTER_ELEMENTS = 1_000_000
CHUNK_SETS = 200
PIVOTS = 256
MOST_PIVOTS = 2_048
BLOOM_BITS = 29
SUBPARTS = 4
SALTS = 16
SLACK = 1.2
REMEMBERED = 200_000
#: Bytes of text whose sets and signatures are held at once.
BLOCK = 2 << 20
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (xor-shifts and multiplications)."""
    x = x ^ (x >> U(31))
    x = x * U(0x7FB5D329728EA185)
    x = x ^ (x >> U(27))
    x = x * U(0x81DADEF4BC2DD44D)
    return x ^ (x >> U(33))


class WordHashes(dict):
    def __missing__(self, word):
        import xxhash

        if len(self) > REMEMBERED:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str | None, n: int, seen: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's n-word shingles (A-Z in lower case)."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, U)
    h = np.fromiter(map(seen.__getitem__, words), U, len(words))
    width = min(n, len(h))
    out = np.full(len(h) - width + 1, width, U)
    for k in range(width):
        out = mix(out * U(0x9E3779B97F4A7C15) + h[k : len(h) - width + 1 + k])
    return np.unique(out)


def node_of(s: np.ndarray) -> int:
    """The 64-bit name of a set (signed)."""
    import xxhash

    return int(np.array([xxhash.xxh3_64_intdigest(s.tobytes())], U).view(np.int64)[0])


class Bands:
    """Size bands for a threshold in percent; see the module's text."""

    def __init__(self, percent: int):
        self.t, self.low, self.top, self.high, self.parts = percent, [], [], [], []
        self.next = 1

    def differences(self, a: int, b: int) -> int:
        """The most elements that similar sets of sizes a and b differ in."""
        return (100 - self.t) * (a + b) // (100 + self.t)

    def upto(self, size: int) -> None:
        while self.next <= size:
            low = self.next
            self.next = max(low + 1, low * 10_000 // (self.t * self.t))
            top = self.next - 1
            high = top * 100 // self.t
            self.low.append(low)
            self.top.append(top)
            self.high.append(high)
            k = self.differences(top, high)
            self.parts.append(max(k // 2, int(k * SLACK / 2)) + 1)

    def of(self, size: int) -> list[int]:
        self.upto(size)
        last = int(np.searchsorted(self.low, size, side="right")) - 1
        return [i for i in range(last, -1, -1) if self.high[i] >= size]

    def most(self, i: int, size: int) -> int:
        """The most differences a set has from a similar one, the smaller of both being in the band's own sizes."""
        return self.differences(size, min(size * 100 // self.t, self.high[i]) if size <= self.top[i] else self.top[i])


def signatures(s: np.ndarray, bands: Bands) -> np.ndarray:
    out = []
    for i in bands.of(len(s)):
        n1 = bands.parts[i]
        cells = n1 * SUBPARTS
        e = mix(s + U((i * 2 + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        cell = (((e >> U(32)) * U(cells)) >> U(32)).astype(np.int64)
        count = np.bincount(cell, minlength=cells).reshape(n1, SUBPARTS)
        count = count.sum(1, keepdims=True) - count
        worth = np.concatenate([count.min(1), count.max(1)])  # elements at which a part takes 2 differences, or 1, to spoil
        at = len(worth) - 1 - bands.most(i, len(s))
        kept = (count >= np.partition(worth, at)[at]).ravel()
        sums = np.zeros(cells, U)
        np.add.at(sums, cell, mix(e))
        sums = sums.reshape(n1, SUBPARTS)
        rest = sums.sum(1, keepdims=True, dtype=U) - sums  # all subparts but one
        name = np.arange(cells, dtype=U) + (U(i) << U(40))
        out.append(mix(rest.ravel() + mix(name))[kept])
    return np.concatenate(out)


def _tie(sig: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by (signature, node): first row of each signature, and ties (first node, other node)."""
    order = np.lexsort((node, sig))
    sig, node = sig[order], node[order]
    new = np.concatenate([[True], sig[1:] != sig[:-1]]) if len(sig) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    head = node[first[np.cumsum(new) - 1]] if len(sig) else node
    ties = np.stack([head, node], 1)[~new & (head != node)]
    return order[first], sig[first], np.unique(ties, axis=0) if len(ties) else ties


def row_key(id_col: str = "doc_id", text_col: str = "text"):
    """Names a row by its id and text in 128 bits: equal rows share it."""
    told = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x00")) for c in (id_col, text_col)]
    return F.unhex(F.md5(F.concat(told[0], F.lit("\x01"), told[1])))


def sets_of(df: DataFrame, n: int) -> DataFrame:
    """(doc_id, n_shingles, node, row_key) of every row; node is null for empty sets."""
    id_type = df.schema["doc_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(id_type)

    def run(batches):
        seen = WordHashes()
        for _, rows, texts in blocks(batches, BLOCK):
            sets = [shingles(t, n, seen) for t in texts]
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array([r["doc_id"] for r in rows], kind), "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                "node": pa.array([node_of(s) if len(s) else None for s in sets], pa.int64()), "row_key": pa.array([r["row_key"] for r in rows], pa.binary()),
            })
        release()

    return df.select("doc_id", "text", row_key().alias("row_key")).mapInArrow(run, f"doc_id {id_type.simpleString()}, n_shingles long, node long, row_key binary")


def ties(df: DataFrame, n: int, percent: int) -> DataFrame:
    """(a, b): nodes that share a signature, tied in stars."""
    n_buckets = fan_out(df, factor=2)

    def make(batches):
        def rows():
            seen, bands = WordHashes(), Bands(percent)
            for name, _, texts in blocks(batches, BLOCK):
                own = {}
                for t in texts:
                    s = shingles(t, n, seen)
                    if len(s):
                        own[node_of(s)] = s
                if not own:
                    continue
                nodes = np.array(list(own), np.int64)
                sigs = [signatures(s, bands) for s in own.values()]
                idx = np.repeat(np.arange(len(nodes)), [len(x) for x in sigs])
                at, sig, tied = _tie(np.concatenate(sigs), nodes[idx])
                if len(tied):
                    yield zlib.crc32(name.encode()) % n_buckets, name, 1, pack(tied)
                idx = idx[at]
                bucket = (sig % U(n_buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
                for a, z in zip(cuts, [*cuts[1:], len(order)], strict=True):
                    o = order[a:z]
                    used, local = np.unique(idx[o], return_inverse=True)
                    yield int(bucket[o[0]]), name, 0, pickle.dumps((sig[o], local.astype(np.uint16 if len(used) < 65_000 else np.int32), nodes[used]), protocol=5)

        yield from packed_batches(rows(), 64)
        release()

    def meet(t: pa.Table) -> pa.Table:
        sig, node, found = [], [], []
        for kind, payload in zip(t.column("kind").to_pylist(), t.column("payload").to_pylist(), strict=True):
            if kind:
                found.append(unpack(payload))
            else:
                s, i, nodes = pickle.loads(payload)
                sig.append(s)
                node.append(nodes[i])
        if sig:
            found.append(_tie(np.concatenate(sig), np.concatenate(node))[2])
        pairs = np.unique(np.concatenate(found).reshape(-1, 2), axis=0) if found else np.zeros((0, 2), np.int64)
        return pa.table({"a": pa.array(pairs[:, 0], pa.int64()), "b": pa.array(pairs[:, 1], pa.int64())})

    return df.select("text").mapInArrow(make, PACKED).groupBy("bucket").applyInArrow(meet, "a long, b long").distinct()


def linked_labels(sets: list[np.ndarray], percent: int, pivots: int | None = None, label: np.ndarray | None = None) -> np.ndarray:
    """Component labels (least index) of sets under 100 * intersection >= percent * union.

    With ``pivots`` only the first so many sets are compared with the others.
    """
    m = len(sets)
    size = np.array([len(s) for s in sets])
    label = np.arange(m) if label is None else label
    starts = np.concatenate([[0], np.cumsum(size)[:-1]])
    _, local = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(local.max() + 1, np.int64)
    for i in range(m if pivots is None else pivots):
        if not (label[i + 1 :] != label[i]).any():
            continue
        own = local[starts[i] : starts[i] + size[i]]
        mark[own] = 1
        inter = np.add.reduceat(mark[local], starts)
        mark[own] = 0
        near = 100 * inter >= percent * (size + size[i] - inter)
        for x in np.unique(label[near]):
            if x != label[i]:
                low, high = min(x, label[i]), max(x, label[i])
                label[label == high] = low
    return label


def _bitmap(nodes: DataFrame) -> np.ndarray:
    """A Bloom filter of nodes, two bits each among some 16 a node, 2^BLOOM_BITS at most, gathered as or-ed words.

    Beyond that bound it lets more sets pass than it need, which the join after it drops.
    """
    size = min(BLOOM_BITS, max(20, (16 * nodes.count()).bit_length()))
    mask = (1 << size) - 1
    bits = nodes.select(F.explode(F.array(F.col("node").bitwiseAND(mask), F.shiftrightunsigned("node", 32).bitwiseAND(mask))).alias("x"))
    words = bits.groupBy(F.shiftright("x", 6).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(x & 63 as int))")).alias("m"))
    out = np.zeros(1 << (size - 6), np.int64)
    got = words.toArrow()
    out[got.column("w").to_numpy()] = got.column("m").to_numpy()
    return out


def _maybe(bitmap: np.ndarray, node: int) -> bool:
    mask = 64 * len(bitmap) - 1
    return all(int(bitmap[x >> 6]) >> (x & 63) & 1 for x in (node & mask, (node >> 32) & mask))


def cluster_sets(df: DataFrame, clusters: DataFrame, n: int) -> DataFrame:
    """(node, comp, elements): the set of every node in a cluster, at least once."""
    shared = df.sparkSession.sparkContext.broadcast(_bitmap(clusters))  # of fixed size

    def run(batches):
        seen = WordHashes()
        for _, _, texts in blocks(batches, BLOCK):
            own = {}
            for t in texts:
                s = shingles(t, n, seen)
                if len(s) and _maybe(shared.value, k := node_of(s)):
                    own[k] = s
            yield pa.RecordBatch.from_pydict({"node": pa.array(list(own), pa.int64()), "elements": pa.array([s.tobytes() for s in own.values()], pa.binary())})
        release()

    got = df.select("text").mapInArrow(run, "node long, elements binary")
    return got.join(clusters.select(F.col("node").alias("n"), "comp"), F.col("node") == F.col("n")).select("node", "comp", "elements")


def _resolve(percent: int):
    def run(t: pa.Table) -> pa.Table:
        by: dict[int, dict[int, bytes]] = {}
        for node, comp, e in zip(t.column("node").to_pylist(), t.column("comp").to_pylist(), t.column("elements").to_pylist(), strict=True):
            by.setdefault(comp, {})[node] = e
        out_n, out_l = [], []
        for members in by.values():
            nodes = sorted(members)
            sets = [np.frombuffer(members[k], U) for k in nodes]
            label = linked_labels(sets, percent)
            out_n += nodes
            out_l += [nodes[i] for i in label]
        return pa.table({"node": pa.array(out_n, pa.int64()), "comp": pa.array(out_l, pa.int64())})

    return run


def resolve_large(sets: DataFrame, percent: int, chunk_sets: int = CHUNK_SETS, pivots: int = PIVOTS) -> DataFrame:
    """(node, comp) by links inside clusters too large for one task; sets: (node, comp, elements).

    Pivots of each round come in equal numbers from the largest part known to be
    connected, which soon draws in what links to it, and from the rest.  Their
    number grows fourfold from round to round up to MOST_PIVOTS.
    """
    sets = sets.groupBy("node").agg(F.first("comp").alias("comp"), F.first("elements").alias("elements"))
    sizes = sets.groupBy("comp").agg(F.count("*").alias("members")).select(F.col("comp").alias("c"), F.ceil(F.col("members") / chunk_sets).cast("int").alias("chunks"))
    sets = materialise(sets.join(sizes, F.col("comp") == F.col("c")).select("node", "comp", "elements", "chunks", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int").alias("chunk")))
    state = materialise(sets.select("node", "comp", F.col("node").alias("label"), F.lit(False).alias("done")))
    turn, spark = 0, sets.sparkSession

    def compare(t: pa.Table) -> pa.Table:
        order = np.argsort(~np.array(t.column("pivot").to_pylist(), bool), kind="stable")
        node = np.array(t.column("node").to_pylist(), np.int64)[order]
        start = np.array(t.column("label").to_pylist(), np.int64)[order]
        elements = t.column("elements").to_pylist()
        n = int(sum(t.column("pivot").to_pylist()))
        first = np.unique(start, return_index=True, return_inverse=True)
        label = linked_labels([np.frombuffer(elements[i], U) for i in order], percent, n, first[1][first[2]].copy())
        a, b = start[label], start
        pairs = np.unique(np.stack([a, b], 1)[a != b], axis=0) if len(node) else np.zeros((0, 2), np.int64)
        return pa.table({"a": pa.array(pairs[:, 0], pa.int64()), "b": pa.array(pairs[:, 1], pa.int64())})

    while True:
        turn += 1
        open_ = state.where("not done")
        parts = open_.groupBy("comp", "label").agg(F.count("*").alias("n"))
        most = parts.groupBy("comp").agg(F.max(F.struct("n", "label")).alias("m"), F.sum("n").alias("all"), F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("labels")).where("lo <> hi")
        most = materialise(most.select(F.col("comp").alias("c"), F.col("m.label").alias("top"), F.col("m.n").alias("n_top"), (F.col("all") - F.col("m.n")).alias("n_rest")))
        if most.isEmpty():
            break
        draw = F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(1 << 20)) / float(1 << 20)
        share = min(pivots << min(20, 2 * (turn - 1)), max(pivots, MOST_PIVOTS)) / 2 / F.when(F.col("label") == F.col("top"), F.col("n_top")).otherwise(F.col("n_rest"))
        chosen = open_.join(most, F.col("comp") == F.col("c")).where(draw < share).select(F.col("node").alias("p"))
        least = open_.join(most, F.col("comp") == F.col("c")).where(F.col("label") != F.col("top")).groupBy("comp").agg(F.min("node").alias("p")).select("p")
        chosen = materialise(chosen.union(least).distinct())
        s = state.select(F.col("node").alias("k"), "label")
        live = sets.join(most.select("c"), F.col("comp") == F.col("c"), "left_semi").join(s, F.col("node") == F.col("k"))
        members = live.select("comp", "chunk", "node", "label", "elements", F.lit(False).alias("pivot"))
        pivot = live.join(chosen, F.col("node") == F.col("p"), "left_semi").select("comp", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "node", "label", "elements", F.lit(True).alias("pivot"))
        links = members.unionByName(pivot).groupBy("comp", "chunk").applyInArrow(compare, "a long, b long")
        to = components(links).select(F.col("node").alias("k"), F.col("comp").alias("to"))
        before = state
        state = state.join(to, F.col("label") == F.col("k"), "left").join(chosen, F.col("node") == F.col("p"), "left")
        state = materialise(state.select("node", "comp", F.coalesce("to", "label").alias("label"), (F.col("done") | F.col("p").isNotNull()).alias("done")))
        discard(before)
        settle(spark)
    return state.select("node", F.col("label").alias("comp"))


def jaccard_components(df: DataFrame, n: int = 5, percent: int = 80, cluster_sets_: int = CLUSTER_SETS, cluster_elements: int = CLUSTER_ELEMENTS) -> DataFrame:
    """(doc_id, n_shingles, node, row_key, component_id) of every row of df (doc_id, text)."""
    docs = df.select("doc_id", "text")
    rows = materialise(sets_of(docs, n))
    clusters = components(ties(docs, n, percent))
    nodes = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"), F.min("n_shingles").alias("n"))
    comp_of = None
    if not clusters.isEmpty():
        sized = clusters.join(nodes.select(F.col("node").alias("k"), "n"), F.col("node") == F.col("k"))
        large = sized.groupBy("comp").agg(F.count("*").alias("sets"), F.sum("n").alias("elements")).where((F.col("sets") > cluster_sets_) | (F.col("elements") > cluster_elements)).select(F.col("comp").alias("c"))
        large = materialise(large)
        sets = cluster_sets(docs, clusters, n)
        cells = fan_out(docs)
        some = not large.isEmpty()
        if some:
            sets = materialise(sets)
        usual = sets.join(large, F.col("comp") == F.col("c"), "left_anti") if some else sets
        cell = F.pmod(F.xxhash64("comp"), F.lit(cells)).cast("int")
        comp_of = usual.withColumn("cell", cell).groupBy("cell").applyInArrow(_resolve(percent), "node long, comp long")
        if some:
            comp_of = comp_of.unionByName(resolve_large(sets.join(large, F.col("comp") == F.col("c"), "left_semi"), percent))
        comp_of = materialise(comp_of).select(F.col("node").alias("k"), "comp")
        nodes = nodes.join(comp_of, F.col("node") == F.col("k"), "left").select("node", "least", F.coalesce("comp", "node").alias("root"))
    else:
        nodes = nodes.select("node", "least", F.col("node").alias("root"))
    nodes = materialise(nodes)
    settle(df.sparkSession)
    # a cluster may hold a large part of all nodes, so its name goes to its members by SALTS keys; nodes by themselves need none
    salt = F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")
    roots = nodes.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members")).where("members > 1")
    roots = roots.select(F.col("root").alias("r"), "component_id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("s"))
    named = nodes.withColumn("salt", salt).join(roots, (F.col("root") == F.col("r")) & (F.col("salt") == F.col("s")), "left")
    named = named.select(F.col("node").alias("k"), F.when(F.col("r").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"))
    out = rows.join(named, F.col("node") == F.col("k"), "left")
    return out.select("doc_id", "n_shingles", "node", "row_key", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


#: Rows to drop that may be broadcast (16 bytes each); beyond it both sides are shuffled.
BROADCAST_ROWS = 500_000


def one_per_group(df: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of df (doc_id, text and any others) without those that are in the group of another row.

    Of each group the row with the least id stays (with null ids only: the least
    row key).  Rows without a shingle are in no group and all stay.
    """
    named = materialise(jaccard_components(df, n, percent).where("node is not null").select("doc_id", "row_key", "component_id", F.coalesce(F.col("component_id").cast("string"), F.concat(F.lit("node "), F.col("node"))).alias("grp")))
    best = named.groupBy("grp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")).alias("m")).select(F.col("m.row_key").alias("k"))
    keys = named.groupBy("row_key").agg(F.count("*").alias("rows"))
    flagged = keys.join(best, F.col("row_key") == F.col("k"), "left").select("row_key", "rows", F.col("k").isNotNull().alias("stays"))
    gone = materialise(flagged.where("not stays or rows > 1"))
    key, k = free(df, "key"), free(df, "gone")
    drop = gone.select(F.col("row_key").alias(k))
    if gone.count() <= BROADCAST_ROWS:
        drop = F.broadcast(drop)
    keyed = df.withColumn(key, row_key())
    out = keyed.join(drop, F.col(key) == F.col(k), "left_anti")
    again = gone.where("stays").select(F.col("row_key").alias(k))
    if not again.isEmpty():  # rows that are repeated as a whole: one of each
        out = out.unionByName(keyed.join(again, F.col(key) == F.col(k), "left_semi").dropDuplicates([key]))
    return out.drop(key)


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents by 3-word shingles and a Jaccard similarity of 0.9 or more."""
    return jaccard_components(table(spark, sf_dir, "documents"), 3, 90).select("doc_id", "n_shingles", "component_id")
