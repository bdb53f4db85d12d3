"""Analyses as idempotent jobs: an append-only status log and micro-batches of requests.

A request is run at most once to completion: results replace the analysis's
partition in one commit, then its status row is appended.  A run that dies in
between is run again with the same outcome.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import callback_ok, signature
from ..params import Params
from ..plans.analysis import analyze
from ..sources.ingest import usable, write_pairs, write_snapshots

STATUS = "analysis_id string, status string, at timestamp, progress int, wall_ms long, error string"
ANALYSIS = "analysis_id string, params string, webhook string, created_at timestamp"
REQUEST = "analysis_id string, submitted_at timestamp"


def latest(log: DataFrame) -> DataFrame:
    """The present state of each analysis: of equal times the later stage."""
    stage = F.expr("array_position(array('queued', 'running', 'completed', 'failed'), status)")
    return log.groupBy("analysis_id").agg(F.max_by(F.struct("status", "at", "progress", "wall_ms", "error"), F.struct("at", stage)).alias("s")).select("analysis_id", "s.*")


def append_status(spark: SparkSession, path: str, analysis_id: str, status: str, progress: int = 0, wall_ms: int | None = None, error: str | None = None) -> None:
    one = spark.createDataFrame([(analysis_id, status, progress, wall_ms, error)], "analysis_id string, status string, progress int, wall_ms long, error string")
    one.select("analysis_id", "status", F.current_timestamp().alias("at"), "progress", "wall_ms", "error").write.mode("append").parquet(path)


def _rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows written under a path so far; a path that does not exist has none, any other failure is raised."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def _log(spark: SparkSession, path: str) -> DataFrame:
    return _rows(spark, path, STATUS)


def submit(spark: SparkSession, analysis_id: str, base: str, params: Params = Params(), webhook: str | None = None) -> None:  # noqa: B008
    """Freezes an analysis's parameters and marks it as queued; submitting it again changes nothing.

    A webhook that is no http or https address raises ValueError.
    """
    if webhook is not None and not spark.range(1).select(callback_ok(F.lit(webhook))).first()[0]:
        raise ValueError("webhook must be an http or https address")
    if not _rows(spark, f"{base}/analyses", ANALYSIS).where(F.col("analysis_id") == analysis_id).isEmpty():
        return
    one = spark.createDataFrame([(analysis_id, json.dumps(asdict(params), sort_keys=True), webhook)], "analysis_id string, params string, webhook string")
    one.withColumn("created_at", F.current_timestamp()).write.mode("append").parquet(f"{base}/analyses")
    append_status(spark, f"{base}/status", analysis_id, "queued")


def analyses(spark: SparkSession, base: str) -> DataFrame:
    """Every submitted analysis with its frozen parameters and present state."""
    made = _rows(spark, f"{base}/analyses", ANALYSIS).groupBy("analysis_id").agg(F.min_by(F.struct("params", "webhook", "created_at"), "created_at").alias("s")).select("analysis_id", "s.*")
    return made.join(latest(_log(spark, f"{base}/status")).select("analysis_id", "status", "progress", "wall_ms", "error", F.col("at").alias("changed_at")), "analysis_id", "left")


def frozen(spark: SparkSession, analysis_id: str, base: str) -> Params | None:
    """The parameters an analysis was submitted with."""
    row = analyses(spark, base).where(F.col("analysis_id") == analysis_id).first()
    return Params(**json.loads(row["params"])) if row else None


def run_analysis(spark: SparkSession, analysis_id: str, submissions: DataFrame | Callable[[], DataFrame], base: str, params: Params | None = None, notify: Callable[[str, str], None] | None = None, secret: str = "",
                 attempts: int = 3, pause_s: float = 1.0, fault: Callable[[str], None] = lambda step: None) -> str:
    """Runs one analysis unless it is completed; returns its status.

    submissions: a frame, or a function that fetches it at each attempt (deferred
    submits).  Parameters not given are the frozen ones, or the defaults.  A
    ValueError (no usable input, bad parameters) is final; anything else is tried
    again after pauses of ``pause_s`` that double, and at last put into
    ``dead``.  ``fault`` is called with the name of each step, for tests that break off there.
    """
    status = f"{base}/status"
    state = latest(_log(spark, status)).where(F.col("analysis_id") == analysis_id).first()
    if not (state and state["status"] == "completed"):
        params = params or frozen(spark, analysis_id, base) or Params()
        for n in range(attempts):
            began = time.time()
            try:
                append_status(spark, status, analysis_id, "running")
                fault("fetch")
                kept = usable(submissions() if callable(submissions) else submissions)
                write_snapshots(kept, analysis_id, f"{base}/snapshots")
                append_status(spark, status, analysis_id, "running", 10)
                fault("snapshots")
                subs = kept.select(F.col("problem_ref").alias("grp"), F.col("external_id").alias("sub_id"), "language", "source")
                done = analyze(subs, params)
                done.kept.count()
                append_status(spark, status, analysis_id, "running", 60)
                fault("fingerprints")
                write_pairs(done.pairs(), analysis_id, f"{base}/pairs")
                done.release()
                append_status(spark, status, analysis_id, "running", 95)
                fault("pairs")
                append_status(spark, status, analysis_id, "completed", 100, int((time.time() - began) * 1000))
                break
            except ValueError as e:
                append_status(spark, status, analysis_id, "failed", error=str(e))
                break
            except Exception as e:
                if n + 1 == attempts:
                    append_status(spark, status, analysis_id, "failed", error=str(e)[:500])
                    dead = spark.createDataFrame([(analysis_id, attempts, str(e)[:500])], "analysis_id string, attempts int, error string")
                    dead.withColumn("at", F.current_timestamp()).write.mode("append").parquet(f"{base}/dead")
                else:
                    time.sleep(pause_s * 2**n)
    state = latest(_log(spark, status)).where(F.col("analysis_id") == analysis_id).first()
    if notify:
        deliver(spark, analysis_id, webhook_body(spark, analysis_id, state, base), notify, secret, base)
    return state["status"]


def deliver(spark: SparkSession, analysis_id: str, body: str, notify: Callable[[str, str], None], secret: str, base: str, attempts: int = 3, pause_s: float = 2.0) -> bool:
    """Hands a signed body to ``notify`` at least once, with pauses that double; the outcome is logged, and failing does not undo the analysis."""
    error = None
    for n in range(attempts):
        try:
            notify(body, signature(body, secret))
            error = None
            break
        except Exception as e:
            error = str(e)[:500]
            if n + 1 < attempts:
                time.sleep(pause_s * 2**n)
    one = spark.createDataFrame([(analysis_id, error is None, n + 1, error)], "analysis_id string, delivered boolean, attempts int, error string")
    one.withColumn("at", F.current_timestamp()).write.mode("append").parquet(f"{base}/webhooks")
    return error is None


def webhook_body(spark: SparkSession, analysis_id: str, state, base: str) -> str:
    if state["status"] != "completed":
        return json.dumps({"analysisId": analysis_id, "status": state["status"], "error": state["error"]})
    p = spark.read.parquet(f"{base}/pairs").where(F.col("analysis_id") == analysis_id)
    from ..plans.report import top_similarity

    flagged = p.where("flagged").count()
    return json.dumps({"analysisId": analysis_id, "status": "completed", "flaggedPairs": flagged, "topSimilarity": top_similarity(p).first()["top_by_first"]})


def serve(spark: SparkSession, requests: str, submissions_of: Callable[[str], DataFrame], base: str, params: Params | None = None):
    """A stream over request files: each request is queued once and run; stops when all files are done."""
    stream = spark.readStream.schema(REQUEST).json(requests).withWatermark("submitted_at", "1 day").dropDuplicatesWithinWatermark(["analysis_id"])

    def batch(df: DataFrame, epoch: int) -> None:
        done = latest(_log(spark, f"{base}/status")).where("status = 'completed'").select("analysis_id")
        for r in df.join(done, "analysis_id", "left_anti").select("analysis_id").toLocalIterator():  # one row a job
            run_analysis(spark, r[0], submissions_of(r[0]), base, params)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()


def stop_gracefully(query, wait_s: float = 60.0) -> None:
    """Stops a stream of ``serve`` between micro-batches, so no analysis is cut off; after ``wait_s`` it is stopped anyway."""
    until = time.time() + wait_s
    while query.isActive and query.status["isTriggerActive"] and time.time() < until:
        time.sleep(0.1)
    query.stop()
