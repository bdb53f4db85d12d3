"""Document frequency, exclusion, candidate pairs, containment and regions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..params import Params

HASH = ["grp", "h1", "h2"]


def doc_freq(fp: DataFrame) -> DataFrame:
    """(grp, h1, h2, df): number of submissions that have a hash."""
    return fp.select(*HASH, "sub_id").distinct().groupBy(*HASH).agg(F.count("*").alias("df"))


def group_sizes(submissions: DataFrame) -> DataFrame:
    """(grp, n_subs), submissions without fingerprints included."""
    return submissions.groupBy("grp").agg(F.countDistinct("sub_id").alias("n_subs"))


def excluded(fp: DataFrame, submissions: DataFrame, p: Params) -> DataFrame:
    """Hashes too frequent: df / N > max_freq or df > corpus_cap, both strict."""
    d = doc_freq(fp).join(group_sizes(submissions), "grp")
    return d.where((F.col("df") / F.col("n_subs") > p.max_freq) | (F.col("df") > p.corpus_cap)).select(*HASH)


def filtered(fp: DataFrame, submissions: DataFrame, p: Params, starter: DataFrame | None = None) -> DataFrame:
    """Fingerprints without excluded and starter hashes.

    Frequencies come from partial counts, so the rows of a very common hash never
    meet in one task; what is left out then is a small set of hashes.
    """
    d = fp.join(excluded(fp, submissions, p), HASH, "left_anti")
    if starter is not None:
        d = d.join(starter.select("h1", "h2").distinct(), ["h1", "h2"], "left_anti")
    return d.select("grp", "sub_id", "h1", "h2", "pos")


def inverted_index(fp: DataFrame) -> DataFrame:
    """(grp, h1, h2, postings): lists are bounded by the corpus cap after filtering."""
    return fp.groupBy(*HASH).agg(F.sort_array(F.collect_list(F.struct("sub_id", "pos"))).alias("postings"))


def candidates(fp: DataFrame, min_shared: int) -> DataFrame:
    """(grp, a, b, shared) with a < b: an equi self-join on hashes; the cap bounds each hash's pairs."""
    d = fp.select(*HASH, "sub_id").distinct()
    a, b = d.withColumnRenamed("sub_id", "a"), d.withColumnRenamed("sub_id", "b")
    return a.join(b, HASH).where("a < b").groupBy("grp", "a", "b").agg(F.count("*").alias("shared")).where(F.col("shared") >= min_shared)


def fingerprint_counts(fp: DataFrame) -> DataFrame:
    return fp.select("grp", "sub_id", "h1", "h2").distinct().groupBy("grp", "sub_id").agg(F.count("*").alias("n_fp"))


def score(cand: DataFrame, fp: DataFrame, flag_threshold: float) -> DataFrame:
    """Adds sim_a_to_b, sim_b_to_a (shared over each side's distinct fingerprints) and flagged."""
    n = fingerprint_counts(fp)
    out = cand.join(n.select("grp", F.col("sub_id").alias("a"), F.col("n_fp").alias("na")), ["grp", "a"], "left").join(n.select("grp", F.col("sub_id").alias("b"), F.col("n_fp").alias("nb")), ["grp", "b"], "left")
    sim = lambda c: F.coalesce(F.col("shared") / F.nullif(F.col(c), F.lit(0)), F.lit(0.0))
    out = out.withColumn("sim_a_to_b", sim("na")).withColumn("sim_b_to_a", sim("nb"))
    return out.withColumn("flagged", F.greatest("sim_a_to_b", "sim_b_to_a") >= flag_threshold).select("grp", "a", "b", "shared", "sim_a_to_b", "sim_b_to_a", "flagged")


def position_pairs(cand: DataFrame, fp: DataFrame) -> DataFrame:
    """(grp, a, b, pa, pb): equal hashes of the two sides of candidate pairs."""
    fa = fp.select(*HASH, F.col("sub_id").alias("a"), F.col("pos").alias("pa"))
    fb = fp.select(*HASH, F.col("sub_id").alias("b"), F.col("pos").alias("pb"))
    return cand.select("grp", "a", "b").join(fa, ["grp", "a"]).join(fb, ["grp", "b", "h1", "h2"]).select("grp", "a", "b", "pa", "pb")


def regions(pairs: DataFrame, k: int, w: int) -> DataFrame:
    """(grp, a, b, a_first, a_last, b_first, b_last, tokens, nth) in tokens: runs in which both places go on by at most w, b's by at least 1."""
    run = W.partitionBy("grp", "a", "b").orderBy("pa", "pb")
    da, db = F.col("pa") - F.lag("pa").over(run), F.col("pb") - F.lag("pb").over(run)
    d = pairs.withColumn("new", F.when((da <= w) & (db > 0) & (db <= w), 0).otherwise(1)).withColumn("island", F.sum("new").over(run.rowsBetween(W.unboundedPreceding, 0)))
    r = d.groupBy("grp", "a", "b", "island").agg(F.min("pa").alias("a_first"), (F.max("pa") + k - 1).alias("a_last"), F.min("pb").alias("b_first"), (F.max("pb") + k - 1).alias("b_last"))
    r = r.withColumn("tokens", F.col("a_last") - F.col("a_first") + 1)
    # in order of length; of equals that which begins earlier
    nth = F.row_number().over(W.partitionBy("grp", "a", "b").orderBy(F.desc("tokens"), "a_first", "island"))
    return r.withColumn("nth", nth.cast("long")).drop("island")


def region_ranges(r: DataFrame, tokens: DataFrame) -> DataFrame:
    """Adds byte and line ranges of both sides to regions: both ends are looked up with one join a side."""
    t = tokens.select("grp", "sub_id", "pos", "line", "start_byte", "end_byte")
    key = ["grp", "a", "b", "nth"]
    ends = r.select(*key, F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.lit(e).alias("end"), F.col(s).alias("sub_id"), F.col(f"{s}_{e}").alias("pos")) for s in "ab" for e in ("first", "last")])).alias("x")).select(*key, "x.*")
    got = ends.join(t, ["grp", "sub_id", "pos"]).groupBy(*key).agg(*[
        F.max(F.when((F.col("side") == s) & (F.col("end") == e), F.col(c))).alias(n)
        for s in "ab" for e, c, n in (("first", "start_byte", f"{s}_start"), ("last", "end_byte", f"{s}_end"), ("first", "line", f"{s}_line_start"), ("last", "line", f"{s}_line_end"))
    ])
    return r.join(got, key)
