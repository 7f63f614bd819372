"""Session defaults and lineage cuts."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tallyframe", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution (skew joins included), UTC and Arrow."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for k, v in {**defaults, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage.

    The cluster names it in ``spark.checkpoint.dir``; a temporary folder is
    made only where that setting is absent and everything runs in one process.
    Anywhere else executors could not read it, so there it is refused.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if named is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tallyframe-"))
    return named or sc.getCheckpointDir()


def _filesystem(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _remove(spark: SparkSession, path: str) -> None:
    try:
        fs, p = _filesystem(spark, path)
        fs.delete(p, True)
    except Exception:  # noqa: BLE001 - the session may be gone; the folder is temporary
        pass


_FOLDERS: set[str] = set()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and read it back.

    The table outlives executors, has known statistics (so joins with it are
    planned by its true size) and none of the plan that made it.  Tables go
    away with ``release`` or when the application ends.
    """
    spark = df.sparkSession
    folder = f"{checkpoint_dir(spark).rstrip('/')}/tallyframe-{spark.sparkContext.applicationId}"
    if folder not in _FOLDERS:
        _FOLDERS.add(folder)
        atexit.register(_remove, spark, folder)
    path = f"{folder}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tallyframe_path = path
    return out


def release(df: DataFrame) -> None:
    """Delete a table of ``cut`` that nothing will read again."""
    path = getattr(df, "_tallyframe_path", None)
    if path:
        _remove(df.sparkSession, path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many tasks as there are cores.  Work on texts in
    Python outweighs moving them, and a small input may come as one split; larger
    inputs have splits enough and stay where they are.  Nothing is run to tell:
    behind a shuffle, whose tasks are not known yet, the estimated size counts."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    run = df._jdf.queryExecution()
    if re.search(r"(?<!Broadcast)Exchange ", run.executedPlan().toString()):
        few = int(str(run.optimizedPlan().stats().sizeInBytes())) < cores * (64 << 20)
    else:
        few = df._jdf.rdd().getNumPartitions() < cores
    return df.repartition(cores) if few else df
