"""Operator 5, quality rules: base counts, then robust multivariate outliers.

Per language and source the minimum covariance determinant (MCD) of transformed
statistics is estimated: from two starts, concentration steps take the 75 % of
rows nearest by Mahalanobis distance and estimate mean and covariance anew,
until no group's determinant falls any more; the start that ends with the
smaller determinant counts.  Rows far from their group by that distance are
rejected.  As in the regularized MCD, covariances get a target, so that groups
of few rows and statistics that hardly vary have a determinant: a group's
moments are mixed with its language's, which count as ``PRIOR`` rows, and each
variance has a floor.  So every group has its own estimate, whatever its size.
Every step is one aggregate over all rows with partial sums or mergeable
quantile summaries, so a source with a third of all rows is no hot spot.

Native: DataFrame functions only.

Defined results: a null text counts as empty (all counts 0, base_failed, not
kept); null languages and sources are values of their own; rows are kept one for
one, repeated ones too; a row alone in its language lies at its centre; other
columns, whatever their names, are left alone; an empty table gives an empty
result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, WORD, free, materialise, settle, table

#: Share of rows that concentration steps keep.
CORE = 0.75
#: Most concentration steps; they end before where no determinant falls by more than TOLERANCE.
STEPS = 12
TOLERANCE = 0.01
#: As how many rows a language's moments count in those of its sources.
PRIOR = 12.0
#: Greatest squared distance of a kept row, in a scale in which the group's median is that of the chi-square law
#: (6 degrees: 30 is exceeded by 4 of 100,000 rows of a normal law).
CUT = 30.0
#: Least standard deviation of each statistic: differences under it are never odd by themselves.
FLOOR = {"x_length": 0.10, "x_symbols": 0.35, "x_lines": 0.60, "x_repeats": 0.60, "x_marks": 0.35, "x_doubled": 0.35}
STATS = list(FLOOR)
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
CHI2_MEDIAN = {1: 0.455, 2: 1.386, 3: 2.366, 4: 3.357, 5: 4.351, 6: 5.348}


def let(value: Column, body) -> Column:
    """body(value) with value worked out once; higher-order functions would otherwise repeat it for each element."""
    return F.transform(F.array(value), body)[0]


def repeat_words(words: Column, n: int = 5) -> Column:
    """Number of words that lie in an n-word window found twice or more."""

    def covered(marks: Column) -> Column:
        # marks: (window hash, place) in order; equal neighbours are repeats
        size = F.size(marks)
        places = F.transform(
            F.filter(
                F.sequence(F.lit(0), size - 1),
                lambda i: ((i > 0) & (F.get(marks, i - 1)["h"] == F.get(marks, i)["h"])) | (F.get(marks, i)["h"] == F.get(marks, i + 1)["h"]),
            ),
            lambda i: F.get(marks, i)["p"],
        )
        return let(F.sort_array(places), lambda at: F.aggregate(
            at, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).alias("end")),
            lambda acc, p: F.struct((acc["n"] + F.least(F.lit(n), p + n - 1 - acc["end"])).cast("long").alias("n"), (p + n - 1).alias("end")),
            lambda acc: acc["n"]))

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(n)]))

    def counted(w: Column) -> Column:
        return let(windows(w), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(
            let(F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p")))), covered)))

    return F.when(F.size(words) < n, F.lit(0).cast("long")).otherwise(counted(words))


def doubled_words(words: Column) -> Column:
    """Number of words equal to the one before them."""
    return F.size(F.filter(words, lambda w, i: (i > 0) & (F.get(words, i - 1) == w))).cast("long")


def measures(text: Column) -> Column:
    """A struct of the base counts (COUNTS), base_failed and the transformed statistics (STATS) of a text."""
    t = F.coalesce(text, F.lit(""))
    count = lambda chars: F.regexp_count(t, F.lit(chars)).cast("long")
    words = F.filter(F.split(F.btrim(t, F.lit(SPACES)), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD))
    raw = F.struct(
        let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), repeat_words(w).alias("rep"), doubled_words(w).alias("twice"))).alias("w"),
        let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("l"),
        (F.length(t) - count(r"[\x20\x09-\x0D]")).cast("long").alias("chars"),
        count(r"[#*$%&|<>]").alias("symbols"),
        count(r"[!?;:=+_~^@{}\[\]\\/]").alias("marks"),
    )

    def told(r: Column) -> Column:
        n_words, repeats = r["w"]["n"], r["w"]["rep"]
        n = F.greatest(n_words, F.lit(1)).cast("double")
        share = lambda x, of=n: F.log(1 + 20 * x / of)
        return F.struct(
            n_words.alias("n_words"), r["chars"].alias("word_chars"), r["symbols"].alias("n_symbols"), r["l"]["dup"].alias("n_dup_lines"), repeats.alias("n_repeat_words"),
            ((n_words < 10) | (100 * repeats > 20 * n_words)).alias("base_failed"),
            F.log(F.greatest(r["chars"] / n, F.lit(0.5))).alias("x_length"), share(r["symbols"]).alias("x_symbols"), share(r["l"]["dup"], F.greatest(r["l"]["n"], F.lit(1))).alias("x_lines"),
            share(repeats).alias("x_repeats"), share(r["marks"]).alias("x_marks"), share(r["w"]["twice"]).alias("x_doubled"),
        )

    return let(raw, told)


def _lower(p: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(p) for j in range(i + 1)]


def _moments(stats: list[str]) -> list[Column]:
    out = [F.avg(x).alias(f"m{i}") for i, x in enumerate(stats)]
    return [F.count("*").alias("n"), *out, *(F.covar_pop(stats[i], stats[j]).alias(f"c{i}_{j}") for i, j in _lower(len(stats)))]


def _regular(moments: DataFrame, prior: DataFrame | None, stats: list[str], few: bool) -> DataFrame:
    """Moments by grp (and start) mixed with those of the group's language, and floors added to the variances."""
    p = len(stats)
    if prior is not None:
        at = prior.select(F.col("grp").alias("_p"), F.struct(*[c for c in prior.columns if c[0] in "mc"]).alias("_o"))
        k, n = F.lit(PRIOR), F.col("n")
        mixed = lambda c: ((n * F.coalesce(F.col(c), F.lit(0.0)) + k * F.col("_o")[c]) / (n + k)).alias(c)
        rest = [c for c in moments.columns if c[0] not in "mc"]
        moments = moments.join(_small(at, few), F.col("up") == F.col("_p")).select(*rest, *[mixed(f"m{i}") for i in range(p)], *[mixed(f"c{i}_{j}") for i, j in _lower(p)])
    return moments.withColumns({f"c{i}_{i}": F.coalesce(F.col(f"c{i}_{i}"), F.lit(0.0)) + F.lit(FLOOR[s] ** 2) for i, s in enumerate(stats)})


def _whitener(df: DataFrame, p: int) -> DataFrame:
    """Adds i{i}_{j}, the inverse of the covariance's Cholesky factor (lower triangle), and the log determinant."""
    minus = lambda a, b: a - b
    for i in range(p):
        for j in range(i + 1):
            s = reduce(minus, [F.col(f"l{i}_{k}") * F.col(f"l{j}_{k}") for k in range(j)], F.coalesce(F.col(f"c{i}_{j}"), F.lit(0.0)))
            df = df.withColumn(f"l{i}_{j}", F.sqrt(F.greatest(s, F.lit(1e-9))) if i == j else s / F.col(f"l{j}_{j}"))
        df = df.withColumns({f"i{i}_{j}": (F.lit(1.0) if i == j else reduce(minus, [F.col(f"l{i}_{k}") * F.col(f"i{k}_{j}") for k in range(j, i)], F.lit(0.0))) / F.col(f"l{i}_{i}") for j in range(i + 1)})
    df = df.withColumn("logdet", reduce(lambda a, b: a + b, [2 * F.log(f"l{i}_{i}") for i in range(p)]))
    return df.drop(*[f"l{i}_{j}" for i, j in _lower(p)])


def _distance(stats: list[Column], at: Column) -> Column:
    """Squared Mahalanobis distance of the statistics from an estimate (a struct of m* and i*)."""
    plus = lambda a, b: a + b
    ys = [reduce(plus, [at[f"i{i}_{k}"] * (stats[k] - at[f"m{k}"]) for k in range(i + 1)]) for i in range(len(stats))]
    return reduce(plus, [y * y for y in ys])


#: Most groups (rows of a few hundred bytes) that are broadcast; beyond it joins shuffle.
BROADCAST_GROUPS = 20_000


def _small(df: DataFrame, few: bool) -> DataFrame:
    return F.broadcast(df) if few else df


def _near(x: DataFrame, at: DataFrame, few: bool) -> DataFrame:
    """x with the estimates of its group as the struct ``_at``, one row for each start."""
    e = at.select(F.col("grp").alias("_g"), *(["start"] if "start" in at.columns else []), F.struct(*[c for c in at.columns if c not in ("grp", "up", "start")]).alias("_at"))
    return x.join(_small(e, few), F.col("grp") == F.col("_g")).drop("_g")


def estimate(x: DataFrame, stats: list[str], few: bool, prior: DataFrame | None = None) -> DataFrame:
    """MCD by grp of x (grp, up: the group of the prior, statistics): mean m*, covariance c*, whitener i*, scale and n."""
    p, cols = len(stats), [F.col(s) for s in stats]
    by = ["grp", "up"]
    first = materialise(x.groupBy(*by).agg(*[F.percentile_approx(s, 0.5, 1000).alias(f"med{i}") for i, s in enumerate(stats)], *_moments(stats)))
    mad = _near(x, first.select("grp", *[f"med{i}" for i in range(p)]), few)
    mad = mad.groupBy(*by).agg(F.count("*").alias("n"), *[F.percentile_approx(F.abs(F.col(s) - F.col("_at")[f"med{i}"]), 0.5, 1000).alias(f"mad{i}") for i, s in enumerate(stats)], *[F.first(F.col("_at")[f"med{i}"]).alias(f"m{i}") for i in range(p)])
    shape = [*[f"m{i}" for i in range(p)], *[f"c{i}_{j}" for i, j in _lower(p)]]
    by_median = mad.select(*by, "n", F.lit(0).alias("start"), *shape[:p], *[(F.pow(1.4826 * F.col(f"mad{i}"), 2) if i == j else F.lit(0.0)).alias(f"c{i}_{j}") for i, j in _lower(p)])
    by_mean = first.select(*by, "n", F.lit(1).alias("start"), *shape)
    at = materialise(_whitener(_regular(by_median.unionByName(by_mean), prior, stats, few), p))
    for _ in range(STEPS):
        d = _near(x, at, few).withColumn("d2", _distance(cols, F.col("_at")))
        cut = d.groupBy("grp", "start").agg(F.percentile_approx("d2", CORE, 2000).alias("cut"), F.first("_at.logdet").alias("was"))
        cut = materialise(cut).select(F.col("grp").alias("_g"), F.col("start").alias("_s"), "cut", "was")
        core = d.join(_small(cut, few), (F.col("grp") == F.col("_g")) & (F.col("start") == F.col("_s"))).where("d2 <= cut")
        core = core.groupBy(*by, "start").agg(*_moments(stats), F.first("was").alias("was"))
        at = materialise(_whitener(_regular(core, prior, stats, few), p))
        settle(x.sparkSession)
        if at.where(F.col("logdet") < F.col("was") - TOLERANCE).isEmpty():
            break
    best = at.groupBy(*by).agg(F.min_by(F.struct(*[c for c in at.columns if c not in (*by, "was")]), F.struct("logdet", "start")).alias("b")).select(*by, "b.*").drop("start", "logdet")
    mid = _near(x, best, few).groupBy("grp").agg(F.percentile_approx(_distance(cols, F.col("_at")), 0.5, 2000).alias("mid"), F.count("*").alias("_n"))
    mid = mid.select(F.col("grp").alias("_g"), "_n", F.greatest(F.col("mid") / CHI2_MEDIAN[p], F.lit(1.0)).alias("own"))  # never under 1: floors already widen
    found = best.join(mid, F.col("grp") == F.col("_g"))
    if prior is None:
        return materialise(found.withColumn("scale", F.col("own")).drop("_g", "_n", "own"))
    above = prior.select(F.col("grp").alias("_p"), F.col("scale").alias("_s"))
    scale = F.exp((F.col("_n") * F.log("own") + PRIOR * F.log("_s")) / (F.col("_n") + PRIOR))
    return materialise(found.join(_small(above, few), F.col("up") == F.col("_p")).withColumn("scale", scale).drop("_g", "_n", "own", "_p", "_s"))


def fit(rows: DataFrame, stats: list[str] = STATS) -> DataFrame:
    """MCD estimates: one row per (lang, source) with mean, whitener and scale.

    rows: lang, source, base_failed and the statistics.  Rows that fail the base
    rules take no part, as they are rejected whatever the estimate.
    """
    named = lambda *cols: F.to_json(F.array(*[F.coalesce(F.col(c), F.lit("\x00")) for c in cols]))
    x = rows.where(~F.col("base_failed")).select(named("lang", "source").alias("grp"), named("lang").alias("up"), "lang", "source", *stats)
    keys = materialise(x.select("grp", "lang", "source").distinct())
    few = keys.count() <= BROADCAST_GROUPS
    x = x.drop("lang", "source")
    of_langs = estimate(x.select(F.col("up").alias("grp"), "up", *stats), stats, few)
    found = estimate(x, stats, few, of_langs).withColumnRenamed("grp", "_g").drop("up", "n", *[f"c{i}_{j}" for i, j in _lower(len(stats))])
    fitted = materialise(keys.join(found, F.col("grp") == F.col("_g")).drop("grp", "_g"))
    settle(rows.sparkSession)
    return fitted


def judge(rows: DataFrame, fitted: DataFrame, told: Column, lang_col: str = "lang", source_col: str = "source", cut: float = CUT, stats: list[str] = STATS) -> tuple[DataFrame, Column, Column]:
    """rows with one more column, and over them two expressions: outlyingness (scaled squared distance; 0 in groups without an estimate) and kept.

    told: the ``measures`` of a row, a column or expression over rows.
    """
    k, s, at = free(rows, "lang_of_fit"), free(rows, "source_of_fit"), free(rows, "fit")
    f = fitted.select(F.col("lang").alias(k), F.col("source").alias(s), F.struct(*[c for c in fitted.columns if c not in ("lang", "source")]).alias(at))
    few = fitted.count() <= BROADCAST_GROUPS
    out = rows.join(_small(f, few), F.col(f"`{lang_col}`").eqNullSafe(F.col(k)) & F.col(f"`{source_col}`").eqNullSafe(F.col(s)), "left").drop(k, s)
    far = F.coalesce(_distance([told[x] for x in stats], F.col(at)) / F.col(at)["scale"], F.lit(0.0))
    return out, far, ~told["base_failed"] & (far <= cut)


def measured(df: DataFrame, text_col: str = "text") -> tuple[DataFrame, str]:
    """The rows, written once with their ``measures`` in a further column, and that column's name."""
    name = free(df, "measures")
    return materialise(df.withColumn(name, measures(F.col(f"`{text_col}`")))), name


def _fitted(rows: DataFrame, name: str, lang_col: str, source_col: str) -> DataFrame:
    m = F.col(name)
    return fit(rows.select(F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{source_col}`").alias("source"), m["base_failed"].alias("base_failed"), *[m[x].alias(x) for x in STATS]))


def accepted(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", cut: float = CUT) -> DataFrame:
    """The rows of df that the base rules and the estimates of their language and source accept, with df's columns."""
    rows, name = measured(df, text_col)
    out, _, kept = judge(rows, _fitted(rows, name, lang_col, source_col), F.col(name), lang_col, source_col, cut)
    return out.where(kept).select(*[F.col(f"`{c}`") for c in df.columns])


def quality(df: DataFrame, id_cols: tuple[str, ...] = ("doc_id",), text_col: str = "text", lang_col: str = "lang", source_col: str = "source", cut: float = CUT) -> DataFrame:
    """(ids, the counts, base_failed, kept, outlyingness, the statistics) of every row of df."""
    slim = df.select(*[F.col(f"`{c}`").alias(f"id{k}") for k, c in enumerate(id_cols)], F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{source_col}`").alias("source"), measures(F.col(f"`{text_col}`")).alias("told"))
    rows = materialise(slim)  # counts and statistics only, no texts
    out, far, kept = judge(rows, _fitted(rows, "told", "lang", "source"), F.col("told"), cut=cut)
    m = F.col("told")
    return out.select(*[F.col(f"id{k}").alias(c) for k, c in enumerate(id_cols)], *[m[x].alias(x) for x in (*COUNTS, "base_failed")], kept.alias("kept"), far.alias("outlyingness"), *[m[x].alias(x) for x in STATS])


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict of all documents."""
    return quality(table(spark, sf_dir, "documents"))
