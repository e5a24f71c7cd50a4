"""Scratch tables: steps written to the shared folder and read back, so that what follows plans and runs from there."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Runtime setting by which Spark deletes the shuffle files of a job when the job ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Bytes of an Arrow batch between the JVM and a Python worker, and Spark's own default.
BATCH, BATCH_BYTES, BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "4m", "67108864b"


def settle(spark: SparkSession) -> SparkSession:
    """Small Arrow batches, unless the session has a size of its own: texts are long, and a worker, its JVM and both
    ends' buffers hold several batches."""
    if spark.conf.get(BATCH, BATCH_DEFAULT) == BATCH_DEFAULT:
        spark.conf.set(BATCH, BATCH_BYTES)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: spark.checkpoint.dir. Where that is unset, a folder of our own if driver and
    executors are one process (tests); an error on a cluster, whose executors wouldn't see it."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="veilspan-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


#: Bytes up to which a table is broadcast by the planner's estimate.
THRESHOLD = "spark.sql.autoBroadcastJoinThreshold"


def materialize(df: DataFrame, tag: str, broadcast: int | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors, and gives the
    planner the true size, so that a later join broadcasts only below the session's threshold. The job's shuffle
    files go when it ends. broadcast: a threshold for this job, where the session's is higher: the driver builds what is
    broadcast, and files that hold few distinct values unpack to many times their size."""
    spark = settle(df.sparkSession)
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    own = {CLEANUP: "true"}
    if broadcast is not None and spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold() > broadcast:
        own[THRESHOLD] = str(broadcast)
    before = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*dfs: DataFrame) -> None:
    """Delete scratch tables that no later step reads (Spark has no call of its own for that)."""
    for df in dfs:
        path = getattr(df, "_scratch", None)
        if path:
            jvm = df.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(p, True)
