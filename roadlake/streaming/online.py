"""The online variant: congestion windows and vehicle states over streams of events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from roadlake.functions.storage import new_folder

EVENT = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"

#: What each event makes of a vehicle; others leave it as it is.
MOVES = {"view": "departed", "click": "queued", "purchase": "planned", "signup": "arrived"}
#: An arrived vehicle is closed; without news for so long, a vehicle is dropped.
SILENCE = "6 hours"


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """Events from files as they appear; a path to one file must be a pattern that matches it."""
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def congestion_windows(events: DataFrame, delay: str | None = "1 hour", width: str = "15 minutes") -> DataFrame:
    """(begin, edge_id, n, milli): measurements by edge and event-time window.

    Those that come later than ``delay`` are lost. Without a delay, as for the replay of a bounded
    history, nothing is lost in whatever order files are read, and all windows are kept as state.
    """
    timed = events.withWatermark("ts", delay) if delay else events
    sums = timed.groupBy(F.window("ts", width).alias("w"), F.col("user_id").alias("edge_id")).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("value") * 1000).cast("bigint")).alias("milli"))
    return sums.select(F.unix_timestamp("w.start").alias("begin"), "edge_id", "n", "milli")


def smoothed_times(events: DataFrame) -> DataFrame:
    """(edge_id, n, smooth) after each batch: a moving value that halves towards every measurement."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, smooth = state.get if state.exists else (0, 0.0)
        for v in pd.concat(batches).sort_values(["ts", "event_id"])["value"]:
            smooth = v if n == 0 else (smooth + v) / 2
            n += 1
        state.update((n, smooth))
        yield pd.DataFrame({"edge_id": [key[0]], "n": [n], "smooth": [smooth]})

    return events.withColumnRenamed("user_id", "edge_id").groupBy("edge_id").applyInPandasWithState(run, "edge_id bigint, n bigint, smooth double", "n bigint, smooth double", "update", GroupStateTimeout.NoTimeout)


def vehicle_states(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """(vehicle_id, state, changes, seen) whenever a vehicle's state changes or it falls silent.

    A vehicle's own events of a batch are taken in order of time. After arrival its state is
    removed; so it is when nothing was heard for ``SILENCE`` of event time.
    """
    silence = int(pd.Timedelta(SILENCE).total_seconds() * 1000)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, changes, seen = state.get if state.exists else ("new", 0, 0)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"vehicle_id": [key[0]], "state": ["silent"], "changes": [changes], "seen": [seen]})
            return
        rows = pd.concat(batches).sort_values(["ts", "event_id"])
        before = changes
        for kind in rows["event_type"]:
            to = MOVES.get(kind, now)
            changes += to != now
            now = to
        seen = max(seen, int(rows["ts"].max().timestamp()))
        if changes > before:
            yield pd.DataFrame({"vehicle_id": [key[0]], "state": [now], "changes": [changes], "seen": [seen]})
        if now == "arrived":
            state.remove()
            return
        state.update((now, changes, seen))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), seen * 1000) + silence)

    keyed = events.withWatermark("ts", delay).withColumnRenamed("user_id", "vehicle_id").groupBy("vehicle_id")
    return keyed.applyInPandasWithState(run, "vehicle_id bigint, state string, changes bigint, seen bigint", "state string, changes bigint, seen bigint", "append", GroupStateTimeout.EventTimeTimeout)


def drained(stream: DataFrame, mode: str) -> DataFrame:
    """All that a stream gives for what is there now, as a table in the shared folder."""
    spark = stream.sparkSession
    base = new_folder(spark)

    def keep(batch: DataFrame, k: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={k}")

    done = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(keep).start()
    done.awaitTermination()
    return spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])).parquet(f"{base}/out")
