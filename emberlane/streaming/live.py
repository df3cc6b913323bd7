"""A running error tally, and bursts found as events arrive, with state per key and a watermark."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from emberlane.tables import new_path

_EVENT = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str, *, files_per_batch: int = 1) -> DataFrame:
    """Events of Parquet files, as they arrive; a single file is named by a glob."""
    return spark.readStream.schema(_EVENT).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def running_tally(stream: DataFrame, by: list[str]) -> DataFrame:
    """Counts of each group so far, whatever the number of batches."""
    return stream.groupBy(*by).agg(F.count("*").alias("n"))


def windowed_tally(stream: DataFrame, *, at: str, by: list[str], width: str, late: str) -> DataFrame:
    """Counts of tumbling windows; a window closes when the watermark passes it, and later rows are dropped."""
    return stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).groupBy(F.window(at, width), *by).agg(F.count("*").alias("n"))


def first_bursts(stream: DataFrame, *, key: str, at: str, ordinal: str, endpoint: str, width: int, least: int, key_type: str = "long", late: str = "0 seconds") -> DataFrame:
    """(key, at, refs): for each key, the first row whose trailing ``width`` microseconds hold ``least`` different endpoints.

    Rows of a key must arrive in the order of time over the batches, up to ``late``; within a
    batch they may be in any order. The state of a key is what lies in the window. It is
    dropped when the watermark has passed the window; of a key whose burst was found a mark stays.
    """
    # the first watermark is 1970: nothing may be as old as that
    rows = stream.select(key, F.col(at).alias("at"), F.col(ordinal).alias("ordinal"), F.col(endpoint).cast("string").alias("endpoint"), F.timestamp_micros(F.greatest(at, F.lit(1000))).alias("time")).withWatermark("time", late)

    def step(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, done = state.get if state.exists else ("", False)
        if state.hasTimedOut:
            if not done:
                state.remove()
            return
        window = [tuple(x.split("\x1f")) for x in held.split("\x1e")] if held else []
        window = [(int(a), int(o), e) for a, o, e in window]
        found = None
        new = sorted((int(a), int(o), e) for f in frames for a, o, e in zip(f["at"], f["ordinal"], f["endpoint"])) if not done else []
        for row in new:
            window = [w for w in window if w[0] >= row[0] - width] + [row]
            if len({e for _, _, e in window}) >= least:
                found, done = (row[0], ",".join(str(o) for _, o, _ in window)), True
                window = []
                break
        state.update(("\x1e".join("\x1f".join(map(str, w)) for w in window), done))
        if window:
            state.setTimeoutTimestamp(max((window[-1][0] + width) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        if found:
            yield pd.DataFrame({key: [group[0]], "at": [found[0]], "refs": [found[1]]})

    return rows.groupBy(key).applyInPandasWithState(step, f"{key} {key_type}, at long, refs string", "held string, done boolean", "append", GroupStateTimeout.EventTimeTimeout)


def run_to_end(out: DataFrame, mode: str) -> DataFrame:
    """Runs a stream over what is there now; its result is written under the shared folder and read from there."""
    spark = out.sparkSession
    at = new_path(spark, "stream")
    writer = out.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{at}/checkpoint")
    if mode == "append":
        writer.format("parquet").option("path", f"{at}/rows").start().awaitTermination()
        return spark.read.schema(out.schema).parquet(f"{at}/rows")
    last = [None]  # in complete mode each batch is the whole result

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/batch-{number}")
        last[0] = number

    writer.foreachBatch(save).start().awaitTermination()
    return spark.createDataFrame([], out.schema) if last[0] is None else spark.read.schema(out.schema).parquet(f"{at}/batch-{last[0]}")


def each_batch_appends(stream: DataFrame, path: str, checkpoint: str, transform) -> None:
    """Alert intake: every micro-batch goes through ``transform`` and is appended as a table; exactly once by batch id."""

    def save(batch: DataFrame, number: int) -> None:
        transform(batch).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
