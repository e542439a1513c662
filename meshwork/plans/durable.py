"""Lineage cuts that survive the loss of executors.

Everything here writes to the folder named by ``spark.checkpoint.dir``, which a cluster shares between
the driver and all executors. Only a local session that names none (tests, a laptop) gets one of our own.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FALLBACK: dict[str, str] = {}
#: Shuffle files of a finished write are deleted; the written table is read instead of them.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder: that of the session, else that of its context. Only a local master without either gets one of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    app = context.applicationId
    if app not in _FALLBACK:
        given = context.getCheckpointDir()
        if given is None:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            given = "file://" + tempfile.mkdtemp(prefix="meshwork-")
            context.setCheckpointDir(given)
        _FALLBACK[app] = given.rstrip("/")
    return _FALLBACK[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A path for a new table or archive in the shared folder."""
    return f"{shared_dir(spark)}/meshwork/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back; the path is kept in ``.meshwork_path``."""
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.meshwork_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables made by :func:`written` that nothing will read again."""
    for df in tables:
        path = getattr(df, "meshwork_path", None)
        if path:
            remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path through Spark's file system layer."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable eager checkpoint, for the small state of iterative operators."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
