"""Connected components by randomised contraction, without collecting links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of edges (a, b): comp is one node of its component, the same for all of it.

    Each round points every node to that one of itself and its neighbours which
    comes first in an order drawn anew for the round (a hash), and contracts the
    edges.  Whatever the links, at most three quarters of the nodes are expected
    to be left (randomised contraction, Bogeholz, Brand and Todor 2020), so
    rounds grow with the logarithm of the nodes, on long chains too.  Null nodes
    and loops are left out.
    """
    ordered = lambda df: materialise(df.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    e = ordered(edges)
    found, turn = None, 0
    while not e.isEmpty():
        turn += 1
        drawn = lambda c, turn=turn: F.struct(F.xxhash64(c, F.lit(turn)).alias("h"), F.col(c).alias("v"))
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = both.groupBy(F.col("a").alias("node")).agg(F.min(drawn("b")).alias("m"))
        to = materialise(first.select("node", F.least(F.col("m"), drawn("node"))["v"].alias("comp")))
        t = to.select(F.col("node").alias("n"), F.col("comp").alias("c"))
        if found is None:
            found = to
        else:
            before, found = found, materialise(found.join(t, F.col("comp") == F.col("n"), "left").select("node", F.coalesce("c", "comp").alias("comp")))
            discard(before)
        left = e.join(t, F.col("a") == F.col("n")).select(F.col("c").alias("a"), "b")
        left = left.join(t, F.col("b") == F.col("n")).select("a", F.col("c").alias("b"))
        before, e = e, ordered(left)
        discard(before)
    if found is None:
        return e.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    return found
