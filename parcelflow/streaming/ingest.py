"""Incremental ingest, price tracking and trailing rates as Structured Streaming jobs."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from parcelflow.sources.fixtures import observations
from parcelflow.sources.shared import scratch

TRACKED = "source string, source_id string, observed_at timestamp_ntz, obs_id long, price long"
_OUT = "source string, source_id string, observed_at timestamp_ntz, obs_id long, price long, previous_price long, is_change boolean"


def _track(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Emit each new sighting with the price before it; the state is the last price and whether there was a sighting."""
    rows = pd.concat(frames).sort_values(["observed_at", "obs_id"])
    seen, last = state.get if state.exists else (False, None)
    out = []
    for at, obs, price in zip(rows.observed_at, rows.obs_id, rows.price, strict=True):
        price = None if pd.isna(price) else int(price)
        out.append((*key, at, obs, price, last, price is not None and (not seen or price != last)))
        seen, last = True, price
    state.update((seen, last))
    yield pd.DataFrame(out, columns=["source", "source_id", "observed_at", "obs_id", "price", "previous_price", "is_change"]).astype({"price": "Int64", "previous_price": "Int64"})


def tracked_prices(sightings: DataFrame) -> DataFrame:
    """A stream of sightings to a stream of price steps, state by listing."""
    return sightings.groupBy("source", "source_id").applyInPandasWithState(_track, _OUT, "seen boolean, last long", "append", GroupStateTimeout.NoTimeout)


def run_ingest(spark: SparkSession, sf_dir: str, batches: int = 3) -> DataFrame:
    """Land the sightings as files in time order, stream them in, and report what each listing ended with.

    Returns (source, source_id, last_seen_at, price, history_rows), a missing last price as -1; a batch run over the same
    sightings gives the same rows.
    """
    base = scratch(spark, "stream")
    obs = observations(spark, sf_dir).select("source", "source_id", "observed_at", "obs_id", "price")
    cuts = obs.select(F.percentile_approx(F.unix_micros(F.col("observed_at").cast("timestamp")), [k / batches for k in range(1, batches)]).alias("c")).first()["c"] or []
    part = sum([F.when(F.unix_micros(F.col("observed_at").cast("timestamp")) > c, 1).otherwise(0) for c in cuts], F.lit(0))
    landed = obs.withColumn("part", part)
    for k in range(batches):
        landed.where(F.col("part") == k).drop("part").coalesce(1 if batches > 8 else 4).write.mode("append").parquet(f"{base}/landed/{k}")
        source = spark.readStream.schema(TRACKED).option("recursiveFileLookup", "true").parquet(f"{base}/landed")
        run = tracked_prices(source).writeStream.format("parquet").option("path", f"{base}/steps").option("checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True).start()
        run.awaitTermination()
    steps = spark.read.parquet(f"{base}/steps")
    last = F.max_by(F.coalesce("price", F.lit(-1)), F.struct("observed_at", "obs_id"))
    return steps.groupBy("source", "source_id").agg(F.max("observed_at").alias("last_seen_at"), last.alias("price"), F.count_if("is_change").alias("history_rows"))


def rates(events: DataFrame, late: str = "10 minutes", width: str = "10 minutes", slide: str = "1 minute") -> DataFrame:
    """Requests of the trailing ``width`` and type, every ``slide``, closed by a watermark."""
    return events.withWatermark("at", late).groupBy(F.window("at", width, slide), "event_type").agg(F.count("*").alias("requests"), F.count_if(F.col("value") > 50).alias("large"))


def run_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windowed counts of the event log as a stream, complete once all input is read."""
    name, base = f"rate_{uuid.uuid4().hex}", scratch(spark, "stream")
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*").withColumn("at", F.col("ts").cast("timestamp"))

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("append").parquet(f"{base}/out/batch={number}")

    run = rates(stream).writeStream.foreachBatch(keep).option("checkpointLocation", f"{base}/state").outputMode("update").trigger(availableNow=True).start()
    run.awaitTermination()
    out = spark.read.parquet(f"{base}/out")
    last = out.groupBy("window", "event_type").agg(F.max_by(F.struct("requests", "large"), "batch").alias("r"))
    return last.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), "event_type", "r.requests", "r.large")


TRAILING = "event_id long, at long, recent long, oldest long"
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _source_type(events: DataFrame) -> str:
    return events.schema["source"].dataType.simpleString()


class _Trailing(StatefulProcessor):
    """Events of one source and slice, and those before it that its windows reach, as list state until the stream's time is
    past the slice.

    Times are whole microseconds. Every batch says anew how many events lie in the window behind each event of the slice
    whose count its rows can have changed.
    """

    def __init__(self, width: int, length: int):
        self.width, self.length = width, length

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getListState("events", "event_id long, at long, own boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        source, slice_ = key
        new = pd.concat(rows)[["event_id", "at", "own"]]
        known = pd.DataFrame(list(self.events.get()), columns=["event_id", "at", "own"])
        self.events.appendList(list(new.itertuples(index=False, name=None)))
        if known.empty:
            self.handle.registerTimer((int(slice_) + 1) * self.length // 1000)
        every = np.sort(np.concatenate([known["at"].to_numpy(np.int64), new["at"].to_numpy(np.int64)]))
        own = pd.concat([known[known["own"].astype(bool)], new[new["own"].astype(bool)]])
        own = own[own["at"] >= new["at"].min()]
        at = own["at"].to_numpy(np.int64)
        low = np.searchsorted(every, at - (self.width - 1))
        yield pd.DataFrame({"source": source, "event_id": own["event_id"].to_numpy(np.int64), "at": at, "recent": np.searchsorted(every, at, "right") - low, "oldest": every[np.minimum(low, len(every) - 1)]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.events.clear()
        return iter(())

    def close(self) -> None:
        pass


def trailing(events: DataFrame, minutes: int = 10, slice_minutes: int = 60, late: str = "10 minutes") -> DataFrame:
    """A stream of (event_id, source, ts) to (source, event_id, at, recent, oldest): exact counts of the trailing minutes.

    A source's log is cut into slices, so a busy source isn't one group; an event is also shown to the next slice if a
    window there reaches it. Event ids are unique, and a later row of an event replaces the one before. Events over ``late``
    behind the stream's time are dropped, as are events without a time.
    """
    width, length = minutes * 60_000_000, slice_minutes * 60_000_000
    timed = events.where("ts is not null").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).withColumn("at", F.unix_micros("ts"))
    first, last = F.floor(F.col("at") / length), F.floor((F.col("at") + (width - 1)) / length)
    shown = timed.withColumn("slice", F.explode(F.sequence(first, last)))
    shown = shown.select("source", "slice", "event_id", "at", (F.col("slice") == first).alias("own"), "ts")
    return shown.groupBy("source", "slice").transformWithStateInPandas(_Trailing(width, length), f"source {_source_type(events)}, {TRAILING}", "Append", "EventTime")


def run_trailing(events: DataFrame, limit: int, minutes: int = 10, parts: int = 3) -> DataFrame:
    """(event_id, source, recent, over_limit, retry_at) of a log that lands part by part in time order and is read as it lands."""
    spark = events.sparkSession
    base, before = scratch(spark, "stream"), spark.conf.get(STORE)
    log = events.select("event_id", "source", "ts")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    cuts = log.select(F.percentile_approx(micros, [k / parts for k in range(1, parts)]).alias("c")).first()["c"] or []
    landed = log.withColumn("part", sum([F.when(micros > c, 1).otherwise(0) for c in cuts], F.lit(0)))

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    spark.conf.set(STORE, ROCKS)  # list state and timers need this store
    try:
        for k in range(parts):
            landed.where(F.col("part") == k).drop("part").write.mode("append").parquet(f"{base}/landed/{k}")
            stream = trailing(spark.readStream.schema(log.schema).option("recursiveFileLookup", "true").parquet(f"{base}/landed"), minutes)
            stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(STORE, before)
    last = spark.read.schema(f"source {_source_type(events)}, {TRAILING}, batch int").parquet(f"{base}/out").groupBy("source", "event_id").agg(F.max_by(F.struct("recent", "oldest"), "batch").alias("r"))
    over = F.col("r.recent") > limit
    return last.select("event_id", "source", "r.recent", over.alias("over_limit"), F.when(over, F.timestamp_micros(F.col("r.oldest") + F.lit(minutes * 60_000_000)).cast("timestamp_ntz")).alias("retry_at"))
