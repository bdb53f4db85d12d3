"""k-gram hashes and winnowing as window functions over one partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..params import BASES, MODULI

DOC = ["grp", "sub_id"]


def kgram_hashes(tokens: DataFrame, k: int) -> DataFrame:
    """(grp, sub_id, pos, h1, h2, n_grams): both polynomial hashes of each window of k tokens.

    Every term is reduced by constants: k products under 2^24 * 10^9 add up within 64 bits.
    """
    if k < 1:
        raise ValueError("k must be positive")
    run = W.partitionBy(*DOC).orderBy("pos")
    ids = [F.col("tid") if j == 0 else F.coalesce(F.lead("tid", j).over(run), F.lit(0)) for j in range(k)]
    t = tokens.select(*DOC, "pos", *[x.alias(f"t{j}") for j, x in enumerate(ids)], F.count("*").over(W.partitionBy(*DOC)).alias("n"))
    t = t.where(F.col("pos") <= F.col("n") - k)

    def poly(base: int, mod: int):
        return sum((F.col(f"t{j}") * pow(base, k - 1 - j, mod) for j in range(k)), F.lit(0).cast("long")) % mod

    return t.select(*DOC, "pos", poly(BASES[0], MODULI[0]).alias("h1"), poly(BASES[1], MODULI[1]).alias("h2"), (F.col("n") - k + 1).alias("n_grams"))


def winnow(hashes: DataFrame, w: int) -> DataFrame:
    """(grp, sub_id, h1, h2, pos): the least hash of each window of w, the rightmost of equals, each place once.

    Fewer than w hashes are one window.
    """
    if w < 1:
        raise ValueError("w must be positive")
    frame = W.partitionBy(*DOC).orderBy("pos").rowsBetween(-(w - 1), 0)
    least = F.min(F.struct("h1", "h2", (-F.col("pos")).alias("p"))).over(frame)
    # that place never moves left, so the first of a run stands for all
    m = hashes.withColumn("m", least).where((F.col("pos") >= w - 1) | ((F.col("n_grams") < w) & (F.col("pos") == F.col("n_grams") - 1)))
    before = F.lag("m.p").over(W.partitionBy(*DOC).orderBy("pos"))
    m = m.withColumn("was", before).where("was is null or was <> m.p")
    return m.select(*DOC, "m.h1", "m.h2", (-F.col("m.p")).alias("pos"))


def fingerprints(tokens: DataFrame, k: int, w: int) -> DataFrame:
    return winnow(kgram_hashes(tokens, k), w)
