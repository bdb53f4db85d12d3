"""Operator 7, document fingerprints: bottom-k sketches of word shingles.

The k least distinct 64-bit hashes of a text's 5-word shingles stand for the
set of all of them.  Sketches of parts merge into the sketch of the whole; two
sketches estimate resemblance, containment and the number of distinct shingles.
With at most k shingles the estimates are exact.

Native: DataFrame functions only.

Defined results: a text with 1 to 4 words has its whole word sequence as one
shingle; null, empty and blank texts have the empty sketch, alike (1.0) to each
other and unlike (0.0) all else; equal texts have equal fingerprints.  In the order
of ids null ones come first, and rows of equal ids follow by their texts; a single
row is followed by itself; rows are kept one for one, repeated ones too; other
columns, whatever their names, are left alone; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from .common import SPACES, fan_out, free, table

K = 128
SHINGLE = 5


def let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def sketch(text: Column, k: int = K, n: int = SHINGLE) -> Column:
    """array<bigint>: the k least distinct shingle hashes, ascending."""
    words = F.filter(F.split(F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES)), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    hashes = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(n)]))
    return let(words, lambda w: F.when(F.size(w) == 0, F.array().cast("array<bigint>")).when(F.size(w) < n, F.array(F.xxhash64(w))).otherwise(F.slice(F.sort_array(F.array_distinct(hashes(w))), 1, k)))


def merge(sketches: Column, k: int = K) -> Column:
    """The sketch of a whole from an array of the sketches of its parts."""
    return F.slice(F.sort_array(F.array_distinct(F.flatten(sketches))), 1, k)


def merged(df: DataFrame, keys: list[str], sketch_col: str, k: int = K, parts: int = 64) -> DataFrame:
    """Sketches of groups of rows.  Groups are merged in two steps, so that one of any size is no task of its own."""
    some = df.groupBy(*keys, F.pmod(F.xxhash64(sketch_col), F.lit(parts)).alias("_p")).agg(F.collect_set(sketch_col).alias("_s")).select(*keys, merge(F.col("_s"), k).alias("_s"))
    return some.groupBy(*keys).agg(F.collect_set("_s").alias("_s")).select(*keys, merge(F.col("_s"), k).alias(sketch_col))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity: the share of the union's k least hashes that both have."""
    union = F.slice(F.sort_array(F.array_union(a, b)), 1, k)
    both = F.size(F.array_intersect(union, F.array_intersect(a, b)))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / F.size(union))


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact under k, else (k - 1) over the part of the hash range that k hashes fill."""
    filled = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / filled)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has: J (|A| + |B|) / ((1 + J) |A|), at most 1."""
    j = resemblance(a, b, k)
    na, nb = distinct_count(a, k), distinct_count(b, k)
    return F.when(na == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), j * (na + nb) / ((1 + j) * na)))


def encoded(a: Column) -> Column:
    """A fingerprint as text: 16 hex digits for each hash."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def decoded(text: Column) -> Column:
    hex_ = F.transform(F.sequence(F.lit(0), (F.length(text) / 16).cast("int") - 1), lambda i: F.substring(text, i * 16 + 1, F.lit(16)))
    return F.when(F.length(text) == 0, F.array().cast("array<bigint>")).otherwise(F.transform(hex_, lambda h: F.conv(h, 16, -10).cast("bigint")))


def _place(key: Column, kind) -> Column:
    """A number that never falls when the key rises: the key itself, or the first 7 bytes of other kinds as text."""
    if isinstance(kind, T.NumericType):
        return key.cast("double") if isinstance(kind, (T.DecimalType, T.FractionalType)) else key.cast("long")
    return F.conv(F.rpad(F.hex(F.substring(key.cast("string").cast("binary"), 1, 7)), 14, "0"), 16, 10).cast("long")


#: Most key ranges; each bound is some 10 bytes of the plan.
RANGES = 100_000


def with_next(df: DataFrame, key: str, cols: list[str], n_parts: int, made: dict[str, Column] | None = None) -> DataFrame:
    """Adds next_<col> from the following row in ascending order of ``key`` (the last is followed by the first), without sorting all rows in one task.

    Rows are dealt to key ranges; within one a window looks ahead, and its last
    row takes the first row of the next range that has any.  ``made``: columns
    worked out once a row and looked ahead for too.  Columns of the input named
    next_<col> give way.
    """
    made = made or {}
    n_parts = min(n_parts, RANGES)
    at, place = F.lit(0), _place(F.col(key), df.schema[key].dataType)
    shares = [i / n_parts for i in range(1, n_parts)]
    cuts = sorted(set(df.agg(F.percentile_approx(place, shares, min(100 * n_parts, 1_000_000))).first()[0] or [])) if shares else []  # as many numbers as ranges
    if cuts:
        listed = F.transform(F.split(F.lit(",".join(map(str, cuts))), ","), lambda x: x.cast("double" if isinstance(cuts[0], float) else "long"))  # one literal
        # the number of cuts under the key, by halving
        at = F.aggregate(
            F.sequence(F.lit(1), F.lit(max(1, len(cuts).bit_length()))),
            F.struct(F.lit(0).alias("a"), F.lit(len(cuts)).alias("z")),
            lambda acc, _: let(F.floor((acc["a"] + acc["z"]) / 2).cast("int"), lambda m: F.when(acc["a"] >= acc["z"], acc).when(F.get(listed, m) < place, F.struct((m + 1).alias("a"), acc["z"].alias("z"))).otherwise(F.struct(acc["a"].alias("a"), m.alias("z")))),
            lambda acc: acc["a"],
        )
        at = F.when(place.isNull(), F.lit(0)).otherwise(at)
    r, nxt, follow, of = (free(df, x) for x in ("range", "following", "follow", "of_range"))
    ranged = df.withColumn(r, at)
    seen = F.struct(*[F.col(f"`{c}`") for c in cols], *[F.col(f"`{c}`") for c in made])
    order = [F.col(f"`{key}`").asc_nulls_first(), *[F.col(f"`{c}`") for c in cols]]
    inner = ranged.withColumns(made).withColumn(nxt, F.lead(seen).over(W.partitionBy(r).orderBy(*order)))
    # the first row of each range: least keys first (RANGES rows at most, so they are broadcast), then whole rows of these only
    mark = F.struct(F.col(f"`{key}`").isNotNull().alias("k"), F.col(f"`{key}`").alias("v"))
    least = ranged.groupBy(F.col(r).alias(of)).agg(F.min(mark).alias(follow))
    edge = ranged.join(F.broadcast(least), (F.col(r) == F.col(of)) & F.col(f"`{key}`").eqNullSafe(F.col(follow)["v"]), "left_semi").withColumns(made)
    edge = edge.groupBy(F.col(r).alias(of)).agg(F.min(seen).alias("first"))
    ranges = W.orderBy(of)
    edge = edge.select(of, F.coalesce(F.lead("first").over(ranges), F.first("first").over(ranges.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).alias(follow))
    out = inner.join(edge, F.col(r) == F.col(of))
    found = F.coalesce(F.col(nxt), F.col(follow))
    ahead = {f"next_{c}" for c in (*cols, *made)}
    return out.select(*[F.col(f"`{c}`") for c in (*df.columns, *made) if c not in ahead], *[found[c].alias(f"next_{c}") for c in (*cols, *made)])


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, and how alike these are."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(docs, "doc_id", ["text"], fan_out(docs, 16 << 20, factor=1), {"sk": sketch(F.col("text"))})
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    rows = rows.withColumn("edited", edited).withColumn("esk", sketch(F.col("edited")))
    return rows.select(
        "doc_id", n.cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), encoded(F.col("sk")).alias("fingerprint"), encoded(F.col("esk")).alias("edited_fingerprint"),
        resemblance(F.col("sk"), F.col("esk")).alias("near_edited"), resemblance(F.col("sk"), F.col("next_sk")).alias("near_next"),
    )
