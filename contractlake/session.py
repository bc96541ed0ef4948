"""Session defaults and lineage cutting shared by every job."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

# Only planner switches; executors, memory and parallelism belong to the cluster.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # plans are built from many small expressions; recording a stack trace for each costs seconds
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}

# scratch paths of this program, with the configuration that reaches them
_SCRATCH: dict[str, object] = {}


def build_session(app: str, master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; a temporary one only on a local master."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        sc.setCheckpointDir(named)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="contractlake-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a shared folder before running iterative operators")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared checkpoint folder. What is still there when the program ends is deleted then."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    _SCRATCH[path] = spark.sparkContext._jsc.hadoopConfiguration()
    return path


def release(spark: SparkSession, path: str) -> None:
    """Delete a scratch path that nothing reads any more."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(_SCRATCH.pop(path)).delete(folder, True)


@atexit.register
def _release_all() -> None:
    jvm = SparkContext._jvm
    for path, conf in list(_SCRATCH.items()):
        with contextlib.suppress(Exception):  # the JVM may have gone first
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(conf).delete(folder, True)


def write_scratch(df: DataFrame) -> tuple[DataFrame, str]:
    """df written as a table in the shared checkpoint folder, and its path for `release`."""
    path = scratch_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write df once as a table in the shared checkpoint folder and go on from there.

    Later rounds survive lost executors, plans stay short, and the optimizer sees the real size
    of the table, so it broadcasts only what is small.
    """
    return write_scratch(df)[0]
