"""The whole analysis over all groups at once."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import matching as M
from ..operators.fingerprint import fingerprints
from ..operators.lexers import lex, lex_ids
from ..params import Params


def beside(*single: DataFrame) -> DataFrame:
    """Frames of one row each as one row."""
    rows = single[0]
    for other in single[1:]:
        rows = rows.unionByName(other, allowMissingColumns=True)
    return rows.agg(*[F.max(c).alias(c) for c in rows.columns])


@dataclass
class Analysis:
    submissions: DataFrame
    lexer: Callable[[DataFrame], DataFrame]
    raw: DataFrame
    kept: DataFrame
    candidates: DataFrame
    scored: DataFrame
    params: Params

    @property
    def tokens(self) -> DataFrame:
        return self.lexer(self.submissions)

    def located(self, regions: DataFrame) -> DataFrame:
        """Regions with byte and line ranges; only submissions that are in candidate pairs are lexed with offsets."""
        seen = self.candidates.select("grp", F.explode(F.array("a", "b")).alias("sub_id")).distinct()
        return M.region_ranges(regions, self.lexer(self.submissions.join(seen, ["grp", "sub_id"], "left_semi")))

    def release(self) -> None:
        """Drop the frames kept for the plans of this analysis."""
        for kept in (self.raw, self.kept, self.candidates):
            kept.unpersist()

    def regions(self) -> DataFrame:
        return M.regions(M.position_pairs(self.candidates, self.kept), self.params.k, self.params.w)

    def pairs(self) -> DataFrame:
        """Scored pairs with their longest region and up to max_regions regions with byte and line ranges."""
        r = self.regions()
        longest = F.max("tokens").alias("longest_region_tokens")
        some = self.located(r.where(F.col("nth") <= self.params.max_regions))
        fields = ["a_start", "a_end", "b_start", "b_end", "a_line_start", "a_line_end", "b_line_start", "b_line_end", "tokens"]
        key = ["grp", "a", "b"]
        # the longest region is always among those kept
        listed = some.groupBy(*key).agg(longest, F.array_sort(F.collect_list(F.struct("nth", *fields))).alias("x"))
        listed = listed.withColumn("regions", F.transform("x", lambda y: F.struct(*[y[f].alias(f) for f in fields]))).drop("x")
        return self.scored.join(listed, key)

    def stats(self) -> DataFrame:
        """Submissions (rows), candidate pairs, all pairs, raw fingerprints, flagged pairs."""
        n = self.submissions.agg(F.count("*").alias("submissions"))
        s = self.scored.agg(F.count("*").alias("candidate_pairs"), F.count_if("flagged").alias("flagged_pairs"))
        full = self.submissions.groupBy("grp").count().agg(F.sum((F.col("count") * (F.col("count") - 1) / 2).cast("long")).alias("full_pairs"))
        return beside(n, s, full, self.raw.agg(F.count("*").alias("fingerprints")))

    def submission_counts(self) -> DataFrame:
        """Tokens and raw fingerprints of every submission, 0 included."""
        t = self.tokens.groupBy("grp", "sub_id").agg(F.count("*").alias("t"))
        f = self.raw.groupBy("grp", "sub_id").agg(F.count("*").alias("f"))
        out = self.submissions.select("grp", "sub_id").join(t, ["grp", "sub_id"], "left").join(f, ["grp", "sub_id"], "left")
        return out.select("grp", "sub_id", F.coalesce("t", F.lit(0)).alias("token_count"), F.coalesce("f", F.lit(0)).alias("fingerprint_count"))


def analyze(submissions: DataFrame, params: Params = Params(), starter: DataFrame | None = None, lexer=lex, ids=None) -> Analysis:  # noqa: B008
    """submissions: (grp, sub_id, language, source); starter: the same, its hashes are subtracted.

    ``ids``: a cheaper lexer for the hashing steps, where offsets are not needed.
    """
    light = ids or (lex_ids if lexer is lex else lexer)
    raw = fingerprints(light(submissions), params.k, params.w).persist()
    gone = fingerprints(light(starter), params.k, params.w) if starter is not None else None
    kept = M.filtered(raw, submissions, params, gone).persist()
    cand = M.candidates(kept, params.min_shared).persist()
    return Analysis(submissions, lexer, raw, kept, cand, M.score(cand, kept, params.flag_threshold), params)
