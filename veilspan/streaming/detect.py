"""Streaming offers: stateless detection per document, detection counts by event time, a mapping that grows as documents
arrive, and a batch that resumes."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import sanitize_type
from ..operators import local
from ..operators.detectors import Rule, detect


def stream_detect(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """The batch detector as it is: a narrow plan, so it needs no state and no watermark."""
    return detect(docs, rules)


def counts_by_time(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts by window and kind; rows later than the watermark are dropped by Spark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"))


def stream_spans(docs: DataFrame, rules: list[Rule] | None = None, key: str = "doc_id") -> DataFrame:
    """X01 with M01: merged spans of each document, row by row, so the stream keeps no state."""
    return local.anonymize(docs, rules).select(key, F.inline("spans"))


def session_mapping(spans: DataFrame, scope: str, order: tuple[str, ...] = ("doc_order", "start")) -> DataFrame:
    """(scope, token, surface, type) as surfaces first arrive in a stream of spans (scope, order..., type, text). The state
    of a scope is its surfaces and a counter for each type; in one micro-batch surfaces go in order."""
    kind = spans.schema[scope].dataType.simpleString()
    x = spans.where("text <> ''").select(scope, F.array(*[F.col(c).cast("bigint") for c in order]).alias("at"), sanitize_type(F.col("type")).alias("stype"), "type", F.col("text").alias("surface"))

    def grow(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        known = json.loads(state.get[0]) if state.exists else {"surfaces": {}, "top": {}}
        rows = pd.concat(list(batches))
        rows["at"] = rows["at"].map(tuple)
        out = []
        for r in rows.sort_values(["at", "surface"], kind="stable").itertuples():
            if r.surface not in known["surfaces"]:
                n = known["top"].get(r.stype, 0) + 1
                known["top"][r.stype] = n
                known["surfaces"][r.surface] = f"{{{r.stype}_{n}}}"
                out.append((key[0], known["surfaces"][r.surface], r.surface, r.type))
        state.update((json.dumps(known, ensure_ascii=False),))
        yield pd.DataFrame(out, columns=[scope, "token", "surface", "type"])

    return x.groupBy(scope).applyInPandasWithState(grow, f"{scope} {kind}, token string, surface string, type string", "known string", "append", "NoTimeout")


def resume(source: DataFrame, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, settings: str) -> None:
    """Run `work` over the documents of a stream that no finished batch of these settings holds, into out/settings=...;
    a batch that is run again writes the same folder."""

    def one(df: DataFrame, n: int) -> None:
        work(df).write.mode("overwrite").parquet(f"{out}/settings={settings}/batch={n}")

    source.writeStream.foreachBatch(one).option("checkpointLocation", f"{checkpoint}/{settings}").trigger(availableNow=True).start().awaitTermination()
