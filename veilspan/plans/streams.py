"""Queries of the streaming offers, run to the end of their input with a trigger of availableNow."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import local
from ..operators.detectors import RULES
from ..streaming import detect as sd
from ..streaming.detect import counts_by_time, stream_detect
from .registry import query, table
from .sessions import KEY, TOKENS_SQL
from .spans import CORE_SQL


def folder(spark) -> str:
    """A folder of its own under the shared one, or under the warehouse."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{at.rstrip('/')}/stream-{uuid.uuid4().hex}"


def drain(stream, mode: str):
    """Run a stream over what is there now into files, a folder for each micro-batch; returns them (the last one alone where
    each is complete)."""
    spark, at = stream.sparkSession, folder(stream.sparkSession)
    keep = (lambda n: 0) if mode == "complete" else (lambda n: n)
    put = lambda df, n: df.write.mode("overwrite").parquet(f"{at}/out/batch={keep(n)}")
    stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out").select(*stream.columns)


def _files(spark, sf: str, name: str):
    """A stream of the table's files: of its own folder where it is one, else of the one file among its neighbours."""
    stream, path = spark.readStream.schema(table(spark, sf, name).schema), f"{sf}/{name}.parquet"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getFileStatus(p).isDirectory():
        return stream.parquet(path)
    return stream.option("pathGlobFilter", f"{name}.parquet").parquet(sf)


@query("x01_stream_detect", f"SELECT doc_id, start, \"end\", text FROM ({CORE_SQL}) WHERE type = 'EMAIL'")
def x01(spark, sf):
    found = stream_detect(_files(spark, sf, "documents").select("doc_id", "text"), [r for r in RULES if r.id == "D01"])
    return drain(found, "update").select("doc_id", "start", "end", "text")


@query("x04_counts_by_time", "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY ALL")
def x04(spark, sf):
    out = drain(counts_by_time(_files(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))), "complete")
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("hour"), "event_type", "n")


@query("x01_stream_spans")
def x01_spans(spark, sf):
    """All rules, merged, in a stream; tests hold it against the batch."""
    return drain(sd.stream_spans(_files(spark, sf, "documents").select("doc_id", "text")), "append")


@query("x02_session_mapping", TOKENS_SQL)
def x02(spark, sf):
    c = _files(spark, sf, "conversations")
    word = F.regexp_extract("text", "^[^ ]+", 0)
    spans = c.where(word != "").select("conv_id", F.expr(KEY).alias("doc_id"), F.col("turn").alias("doc_order"), F.lit(0).alias("start"), F.upper("role").alias("type"), word.alias("text"))
    return drain(sd.session_mapping(spans, "conv_id"), "append")


@query("x03_resumable_batch", "SELECT doc_id, text AS restored FROM documents")
def x03(spark, sf):
    """Run twice: the second run finds nothing left to do."""
    at = folder(spark)
    work = lambda df: local.restore(local.anonymize(df, [r for r in RULES if r.id == "D01"])).select("doc_id", "restored")
    for _ in range(2):
        sd.resume(_files(spark, sf, "documents").select("doc_id", "text"), work, f"{at}/out", f"{at}/state", "s1")
    return spark.read.parquet(f"{at}/out").select("doc_id", "restored")
