"""Shared helpers of the training-data operators: storage, hashing, sizing."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import release

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only where the setting is absent, as in tests on one machine, a temporary
    folder is used, and removed at exit.
    """
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    path = tempfile.mkdtemp(prefix="winnowry-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(f"file://{path}")
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def materialise(df: DataFrame, **renamed) -> DataFrame:
    """Cut the lineage: write to the shared folder as Parquet and read it again.

    The files outlive lost executors, unlike a cached or locally checkpointed
    frame, and are columnar, unlike a reliable RDD checkpoint.
    """
    spark = df.sparkSession
    name = uuid.uuid4().hex
    path = f"{shared_dir(spark)}/winnowry/{spark.sparkContext.applicationId}/{name}"
    df.write.option("parquet.block.size", 32 << 20).parquet(path)  # small row groups: less of the writers' memory
    _MADE.add(name)
    return spark.read.schema(df.schema).parquet(path)


_MADE: set[str] = set()


def discard(df: DataFrame) -> None:
    """Delete the files of a materialised frame nothing will read any more; files that ``materialise`` did not write stay."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for f in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if (name := f.rpartition("/")[2]) in _MADE:
            path = jvm.org.apache.hadoop.fs.Path(f)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
            _MADE.discard(name)


def settle(spark: SparkSession) -> None:
    """Let go of what spent frames still hold on the driver, for a job of many small plans: plans, broadcasts, and with them shuffle files."""
    gc.collect()
    release()
    spark.sparkContext._jvm.System.gc()


def free(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def steady(df: DataFrame) -> DataFrame:
    """df, or where its rows might come in another order when a task is run again (after a shuffle or a Python step), a written copy of it."""
    plan = str(df._jdf.queryExecution().optimizedPlan().toString())
    firm = ("Project", "Filter", "Relation", "LocalRelation", "SubqueryAlias", "View")
    names = [line.lstrip(" :+-").split(" ")[0].split("(")[0] for line in plan.splitlines() if line.strip()]
    return df if all(n.startswith(firm) for n in names) else materialise(df)


def input_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of the bytes behind a frame (files: their size)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def fan_out(df: DataFrame, bytes_each: int = 8 << 20, factor: int = 4) -> int:
    """Number of hash buckets: a multiple of the shuffle partitions, more when a
    bucket would otherwise stand for over ``bytes_each`` of input."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = input_bytes(df)
    return factor * max(parts, min(size // bytes_each, 1 << 20) if size < 1 << 60 else parts)


def fold(col, n: int):
    """crc32 of the id as text, modulo n (null ids count as '')."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % n
