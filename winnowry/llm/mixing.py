"""Operator 2, mixing sources to target weights by hash-threshold histograms.

Sources get shares of a budget by weight, none beyond ``most`` times its size
(water filling in closed form).  A source whose target is r times its size gives
each document floor(r) times, and once more where the document's hash lies under
a threshold.  Thresholds come from histograms: words are summed by source and
hash bucket, the bucket in which the running sum passes the budget is found, and
only the documents of that bucket are summed again by finer buckets.  Nothing is
sorted; thresholds of larger budgets contain those of smaller ones.

Native: DataFrame functions only.

Defined results: a null text has size 0; documents with equal ids and texts
have equal hashes and go in or stay out together; null sources are a source of
their own; a source of size 0 has target 0; repeated rows are rows of their own;
an empty table gives an empty result; other columns, whatever their names, are
returned by ``mixed`` as they are and ignored by ``mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import WORD, free, materialise, table

#: Bits of the hash that each level of histograms resolves.
LEVELS = (10, 10, 10)
BITS = sum(LEVELS)
#: Most sources (rows of a few dozen bytes) that are broadcast; beyond it the join shuffles.
BROADCAST_SOURCES = 100_000


def sized(df: DataFrame, text_col: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size) -> adds weight and target.

    With the sources in the order of most*size/weight, the first ones are full;
    the rest share what is left by weight.  One row of a few numbers per source is
    sorted in one task, which is meant for up to some millions of sources.
    """
    everything = W.orderBy(F.col("source").asc_nulls_last())
    nth = F.row_number().over(everything) - 1
    w = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (nth % len(weights) + 1).cast("int")))
    cap = most * F.col("source_size")
    order = W.orderBy((cap / F.col("weight")), F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    rest = order.rowsBetween(0, W.unboundedFollowing)
    whole = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    left = F.least(share * F.sum("source_size").over(whole), F.sum(cap).over(whole)) - F.coalesce(F.sum(cap).over(before), F.lit(0.0))
    w = w.withColumn("level", left / F.sum("weight").over(rest)).withColumn("full", cap <= F.col("level") * F.col("weight"))
    # once a source is not full, all later ones have its level
    first = F.min(F.when(~F.col("full"), F.struct(cap / F.col("weight"), F.col("level")))).over(whole)["level"]
    return w.withColumn("target", F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(F.least(cap, F.coalesce(first * F.col("weight"), cap)))).drop("level", "full")


def thresholds(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(source, cut): documents with hash < cut hold, as closely as whole documents can, ``wanted`` words.

    rows: (source, hash of BITS bits, size); wanted: (source, goal).
    """
    found = wanted.select("source", "goal", F.lit(0).cast("long").alias("low"), F.lit(0.0).alias("have"))
    shift = BITS
    for bits in LEVELS:
        width = 1 << (shift - bits)
        inside = rows.join(found, rows["source"].eqNullSafe(found["source"])).where((F.col("hash") >= F.col("low")) & (F.col("hash") < F.col("low") + F.lit(1 << shift)))
        hist = inside.groupBy(rows["source"], F.floor((F.col("hash") - F.col("low")) / F.lit(width)).cast("long").alias("bucket")).agg(F.sum("size").alias("words"), F.first("low").alias("low"), F.first("have").alias("have"), F.first("goal").alias("goal"))
        run = W.partitionBy("source").orderBy("bucket")
        upto = F.col("have") + F.sum("words").over(run)
        # the last bucket that starts under the goal is the boundary
        hist = hist.withColumn("start", upto - F.col("words")).where((F.col("start") < F.col("goal")))
        at = hist.groupBy("source").agg(F.max(F.struct("bucket", "start", "words", "low", "goal")).alias("m"))
        found = materialise(at.select("source", F.col("m.goal").alias("goal"), (F.col("m.low") + F.col("m.bucket") * width).alias("low"), F.col("m.start").alias("have"), F.col("m.words").alias("words")))
        shift -= bits
    # the last bucket goes in if that comes nearer to the goal
    taken = F.abs(F.col("have") + F.col("words") - F.col("goal")) <= F.abs(F.col("have") - F.col("goal"))
    return found.select("source", F.when(taken, F.col("low") + 1).otherwise(F.col("low")).alias("cut"))


def hashed(id_col: str, text_col: str, seed: int) -> Column:
    """BITS bits of a row's md5; nulls count as a character that stands for them."""
    told = F.concat_ws("\x01", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in (id_col, text_col)])
    return F.shiftright(F.conv(F.substring(F.md5(told), 1, 8), 16, 10).cast("long"), 32 - BITS)


def plan(rows: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target, whole, cut), one row per source: a document is taken ``whole`` times, and once more if its hash < cut.

    rows: (source, hash, size).
    """
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = targets(sizes, weights, share, most)
    goal = goal.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)).withColumn("goal", F.col("target") - F.col("whole") * F.col("source_size"))
    goal = materialise(goal)
    cuts = thresholds(rows, goal.where("goal > 0"))
    return goal.join(cuts.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").select("source", "source_size", "target", "whole", F.coalesce("cut", F.lit(0)).alias("cut"))


def with_copies(df: DataFrame, planned: DataFrame, hash_: Column, source_col: str = "source") -> tuple[DataFrame, str]:
    """df with one more column, and its name: a struct of the source's size, its target and how often the row is taken."""
    s, name = free(df, "planned_source"), free(df, "mix")
    p = planned.select(F.col("source").alias(s), F.struct("source_size", "target", "whole", "cut").alias(name))
    out = df.join(F.broadcast(p) if planned.count() <= BROADCAST_SOURCES else p, F.col(f"`{source_col}`").eqNullSafe(F.col(s)))
    m = F.col(name)
    copies = (m["whole"] + F.when(hash_ < m["cut"], 1).otherwise(0)).cast("long")
    return out.drop(s).withColumn(name, F.struct(m["source_size"].alias("source_size"), m["target"].alias("target"), copies.alias("copies"))), name


def _slim(df: DataFrame, seed: int, source_col: str, text_col: str, id_col: str) -> DataFrame:
    return df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("source"), sized(df, f"`{text_col}`").alias("size"), hashed(f"`{id_col}`", f"`{text_col}`", seed).alias("hash"))


def mix(df: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 17, source_col: str = "source", text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, source, size, source_size, target, copies, taken) of every row; ``copies`` is how often the mix takes it."""
    rows = materialise(_slim(df, seed, source_col, text_col, id_col))
    out, m = with_copies(rows, materialise(plan(rows, weights, share, most)), F.col("hash"))
    m = F.col(m)
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", m["source_size"].alias("source_size"), m["target"].alias("target"), m["copies"].alias("copies"), (F.col("size") * m["copies"]).cast("long").alias("taken"))


def mixed(df: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 17, source_col: str = "source", text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The mix itself: the rows of df, each as often as it is taken, with df's columns."""
    rows = materialise(_slim(df, seed, source_col, text_col, id_col).drop("id"))
    out, m = with_copies(df, materialise(plan(rows, weights, share, most)), hashed(f"`{id_col}`", f"`{text_col}`", seed), source_col)
    out = out.where(F.col(m)["copies"] > 0)
    again = F.explode(F.sequence(F.lit(1), F.col(m)["copies"].cast("int"))).alias(free(df, "copy"))
    return out.select(*[F.col(f"`{c}`") for c in df.columns], again).drop(free(df, "copy"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents: sources by code point weigh 5, 2, 1 and share 150 % of all words."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
