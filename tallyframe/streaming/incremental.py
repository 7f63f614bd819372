"""Structured Streaming forms: windows, duplicates, tallies, the sequential test."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallyframe.operators import detection, profiling


def _timed(events: DataFrame, ts: str) -> DataFrame:
    return events.withColumn("__ts", F.col(ts).cast("timestamp"))


def windowed(events: DataFrame, ts: str, keys: list[str], width: str, slide: str | None = None, late: str = "1 hour", value: str | None = None) -> DataFrame:
    """Tumbling (or sliding) windows by key: window_start, n, and the sum of
    ``value``.  The same plan serves tables and streams; only streams drop rows
    later than ``late``."""
    e = _timed(events, ts)
    if events.isStreaming:
        e = e.withWatermark("__ts", late)
    g = e.groupBy(F.window("__ts", width, slide or width).alias("w"), *keys).agg(F.count("*").alias("n"), *([F.sum(value).alias("total")] if value else []))
    return g.select(F.col("w.start").alias("window_start"), *keys, "n", *(["total"] if value else []))


def sessions(events: DataFrame, ts: str, keys: list[str], gap: str, late: str = "1 hour") -> DataFrame:
    """Session windows by key: session_start, session_end, n."""
    e = _timed(events, ts)
    if events.isStreaming:
        e = e.withWatermark("__ts", late)
    g = e.groupBy(F.session_window("__ts", gap).alias("w"), *keys).agg(F.count("*").alias("n"))
    return g.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *keys, "n")


def first_deliveries(events: DataFrame, ts: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Events without those delivered again (equal keys), within the watermark on a stream."""
    if not events.isStreaming:
        return events.dropDuplicates(keys)
    return _timed(events, ts).withWatermark("__ts", late).dropDuplicatesWithinWatermark(keys).drop("__ts")


def feedback_stream(spark: SparkSession, path: str) -> DataFrame:
    """Feedback records as they are appended to a folder of JSON lines; bad lines are skipped."""
    return spark.readStream.schema("feedback_id string, finding_id string, action string, notes string, timestamp string, rule_id string, finding_type string, account string").option("mode", "DROPMALFORMED").json(path)


def running_tallies(feedback: DataFrame) -> DataFrame:
    return detection.feedback_tallies(feedback)


def sequential_test_stream(rows: DataFrame) -> DataFrame:
    """The sequential test with its state kept by file: file, seen, llr, decision
    after each micro-batch.  ``rows``: file, row_index, hit; a batch's rows are
    taken in order of row_index."""
    import math

    up, down = math.log(detection.P1 / detection.P0), math.log((1 - detection.P1) / (1 - detection.P0))
    high, low, least = math.log((1 - detection.BETA) / detection.ALPHA), math.log(detection.BETA / (1 - detection.ALPHA)), detection.LEAST_ROWS

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, llr, decision = state.get if state.exists else (0, 0.0, "undecided")
        rows_ = sorted((int(i), bool(h)) for pdf in batches for i, h in zip(pdf["row_index"], pdf["hit"], strict=True))
        for _, hit in rows_:
            seen, llr = seen + 1, llr + (up if hit else down)
            if decision == "undecided" and seen >= least:
                decision = "anomalous" if llr >= high else "clean" if llr <= low else decision
        state.update((seen, llr, decision))
        yield pd.DataFrame({"file": [key[0]], "seen": [seen], "llr": [llr], "decision": [decision]})

    return rows.groupBy("file").applyInPandasWithState(step, "file string, seen long, llr double, decision string", "seen long, llr double, decision string", "update", GroupStateTimeout.NoTimeout)


def validate_batches(stream: DataFrame, suite: DataFrame, path: str, checkpoint: str) -> Callable:
    """Validates each micro-batch and appends one summary row to a dataset;
    returns the running query."""

    def one(batch: DataFrame, number: int) -> None:
        profiling.validation_summary(profiling.validate(batch, suite)).withColumn("batch", F.lit(number)).write.mode("append").json(path)

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
