"""Sources and sinks: submissions, snapshots, paged remote scans, corpora, pairs."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.scalars import encoding_label, filename_id, fits, submission_errors
from ..params import MAX_SUBMISSIONS

SUBMISSION = "external_id string, user_ref string, problem_ref string, language string, source string"


def direct(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Submissions handed over at once: 1 to MAX_SUBMISSIONS valid rows with unique ids, or ValueError."""
    if not 1 <= len(rows) <= MAX_SUBMISSIONS:
        raise ValueError(f"between 1 and {MAX_SUBMISSIONS} submissions are needed")
    df = spark.createDataFrame(rows, SUBMISSION)
    bad = df.withColumn("errors", submission_errors()).where(F.size("errors") > 0).limit(5).collect()
    if bad:
        raise ValueError("; ".join(f"{r.external_id}: {', '.join(r.errors)}" for r in bad))
    if df.groupBy("external_id").count().where("count > 1").limit(1).count():
        raise ValueError("external_id is not unique")
    return df


def deferred(spark: SparkSession, fetch: Callable, contest_ref: str, keys: list[str], **options) -> Callable[[], DataFrame]:
    """A submit that names a contest only: its submissions are fetched when the job runs, as usable rows of that contest."""

    def fetched() -> DataFrame:
        return usable(paged_source(spark, fetch, [f"{contest_ref}/{k}" for k in keys], **options))

    return fetched


class PagedSource(DataSource):
    """Pages of a remote listing; one input partition per key, cursors followed inside it.

    Options: keys (comma-separated), page_size, attempts, backoff_ms.  The class
    attribute ``fetch(key, cursor, page_size) -> (rows, next_cursor)`` is set by
    ``paged_source``.  A page that keeps failing fails the task, and with it the read.
    """

    fetch: Callable | None = None

    @classmethod
    def name(cls):
        return "winnowry_pages"

    def schema(self):
        return SUBMISSION

    def reader(self, schema):
        return _PagedReader(self.options, type(self).fetch)


class _PagedReader(DataSourceReader):
    def __init__(self, options, fetch):
        self.keys = [k for k in options.get("keys", "").split(",") if k]
        self.size, self.attempts, self.backoff = int(options.get("page_size", 200)), int(options.get("attempts", 3)), int(options.get("backoff_ms", 500))
        self.fetch = fetch

    def partitions(self):
        return [InputPartition(k) for k in self.keys]

    def _page(self, key, cursor):
        for n in range(self.attempts):
            try:
                return self.fetch(key, cursor, self.size)
            except Exception:
                if n + 1 == self.attempts:
                    raise
                time.sleep(self.backoff * 2**n / 1000)

    def read(self, partition) -> Iterator[tuple]:
        cursor = None
        while True:
            rows, cursor = self._page(partition.value, cursor)
            yield from rows
            if cursor is None:
                return


def paged_source(spark: SparkSession, fetch: Callable, keys: list[str], **options) -> DataFrame:
    kind = type("Pages", (PagedSource,), {"fetch": staticmethod(fetch)})
    spark.dataSource.register(kind)
    return spark.read.format("winnowry_pages").options(keys=",".join(keys), **{k: str(v) for k, v in options.items()}).load()


def usable(df: DataFrame) -> DataFrame:
    """Submissions of at most the largest size; ValueError if none or too many are left."""
    kept = df.where(fits(F.col("source")))
    n = kept.count()
    if not 1 <= n <= MAX_SUBMISSIONS:
        raise ValueError(f"{n} usable submissions")
    return kept


def corpus(spark: SparkSession, path: str, language: str = "cpp", group: str = "corpus") -> DataFrame:
    """Whole files as submissions, named by their file names."""
    files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    d = files.select(F.lit(group).alias("grp"), filename_id(F.input_file_name()).alias("sub_id"), F.lit(language).alias("language"), F.col("value").alias("source"))
    return d.where("sub_id <> ''")


def write_snapshots(df: DataFrame, analysis_id: str, path: str) -> None:
    """Replaces the snapshots of one analysis in one atomic commit."""
    out = df.withColumn("analysis_id", F.lit(analysis_id)).withColumn("source_encoding", encoding_label(F.col("source")))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("analysis_id").parquet(path)


def snapshots(spark: SparkSession, path: str, analysis_id: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("analysis_id") == analysis_id)


def write_pairs(pairs: DataFrame, analysis_id: str, path: str) -> None:
    out = pairs.withColumn("analysis_id", F.lit(analysis_id))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("analysis_id").parquet(path)


OPERATORS = "+ - * / % & | ^".split()


def _statements(d: DataFrame, draw) -> DataFrame:
    """d (id, body, i) with the line of each number i: a form and two expressions; three of four expressions are a single term."""
    at, terms = F.col("i"), ("al", "ar", "bl", "br")
    d = d.withColumns({f"v_{t}": F.concat(F.lit("q"), draw(f"v{t}", at, 40).cast("string")) for t in (*terms, "to")} | {f"n_{t}": draw(f"n{t}", at, 900).cast("string") for t in terms} | {f"k_{t}": draw(f"t{t}", at, 4) for t in terms})

    def term(t):
        v = F.col(f"v_{t}")
        return F.when(F.col(f"k_{t}") == 0, v).when(F.col(f"k_{t}") == 1, F.col(f"n_{t}")).when(F.col(f"k_{t}") == 2, F.concat(F.lit("f("), v, F.lit(")"))).otherwise(F.concat(F.lit("w["), v, F.lit("]")))

    d = d.withColumns({f"t_{t}": term(t) for t in terms} | {f"o_{x}": draw(f"o{x}", at, len(OPERATORS)).cast("int") for x in "ab"} | {f"x_{x}": draw(f"x{x}", at, 4) for x in "ab"})
    operator = lambda x: F.element_at(F.array(*map(F.lit, OPERATORS)), F.col(f"o_{x}") + 1)
    d = d.withColumns({x: F.when(F.col(f"x_{x}") < 3, F.col(f"t_{x}l")).otherwise(F.concat_ws(" ", f"t_{x}l", operator(x), f"t_{x}r")) for x in "ab"} | {"form": draw("form", at, 8)})
    forms = ["{to} = {a};", "emit({a});", "w[{a}] = {b};", "{to} <<= {a};", "{to} ^= {a};", "long {to}{{{a}}};", "if ({a}) {to}++;", "{to} -= {a};"]
    filled = None
    for k, form in enumerate(forms):
        parts = form.format(to="\0v_to\0", a="\0a\0", b="\0b\0").split("\0")
        text = F.concat(*[F.col(p) if j % 2 else F.lit(p) for j, p in enumerate(parts)])
        filled = F.when(F.col("form") == k, text) if filled is None else filled.when(F.col("form") == k, text)
    return d.select("id", "i", filled.alias("line"))


def generated(spark: SparkSession, n: int, plagiarism_rate: float = 0.05, template_share: float = 0.3, lines: int = 200, seed: int = 1) -> DataFrame:
    """A synthetic corpus made by SQL expressions from ids and hashes alone, so it is the same on every run.

    A source begins with lines that all have in common and goes on with drawn
    statements; a copy has the drawn statements of an earlier source.
    """
    head = round(lines * template_share)
    below = lambda m, *x: F.pmod(F.xxhash64(F.lit(seed), *x), F.lit(m))
    copied = (F.col("id") > 0) & (below(1 << 30, F.lit("copy"), F.col("id")) < int(plagiarism_rate * (1 << 30)))
    body = F.when(copied, F.pmod(below(1 << 30, F.lit("from"), F.col("id")), F.col("id"))).otherwise(F.col("id"))
    draw = lambda tag, i, m: below(m, F.lit(tag), F.col("body"), i)
    common = F.lit("\n".join(f"static const long c{k}[] = {{{k}, {k * k}, c{max(0, k - 1)}[0]}};" for k in range(head)))
    d = spark.range(n).withColumn("body", body).select("id", "body", F.explode(F.sequence(F.lit(1), F.lit(lines - head))).alias("i"))
    d = _statements(d, draw).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("i", "line"))).alias("x"))
    source = F.concat_ws("\n", common, F.array_join(F.transform("x", lambda y: y["line"]), "\n"))
    return d.select(F.lit("bench").alias("grp"), F.concat(F.lit("s"), F.col("id")).alias("sub_id"), F.lit("cpp").alias("language"), source.alias("source"))
