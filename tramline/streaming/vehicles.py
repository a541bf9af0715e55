"""Vehicle positions as a stream: snapshots land as files, rows are kept where strictly newer, late ones flagged and never dropped."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues

from tramline.operators.timetable import flagged_stale, previous_snapshots
from tramline.sources.documents import read_vehicles

KEY = ["operator_ref", "vehicle_ref"]


def snapshot_stream(spark: SparkSession, folder: str, per_trigger: int = 50) -> DataFrame:
    """Rows of the snapshots that land in a folder, in order of their files."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", per_trigger).load(folder)
    return read_vehicles(files)


#: Seconds between snapshots that the first one of an archive is held to be behind its predecessor.
NOMINAL_S = 10.0


#: Seconds after which a vehicle that is not heard of is forgotten.
FORGOTTEN_S = 2 * 86_400.0


class Newest(StatefulProcessor):
    """Marks a vehicle's rows that are strictly newer than all before. Its state is one time, which goes after `ttl_s` seconds without a row of the vehicle."""

    def __init__(self, names: list[str], ttl_s: float):
        self.names, self.ttl_ms = names, int(ttl_s * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "at long", self.ttl_ms)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last = self.last.get()[0] if self.last.exists() else None
        frame = pd.concat(list(rows)).sort_values(["response_ts", "recorded_at"], kind="stable")
        at = frame.recorded_at.astype("int64")
        top = at.cummax().shift()
        if last is not None:
            top = top.fillna(last).clip(lower=last)
        self.last.update((int(at.max()) if last is None else max(int(at.max()), last),))
        yield frame[self.names].assign(kept=~(at <= top))  # nothing before: kept

    def close(self) -> None:
        pass


def newer_stream(rows: DataFrame, ttl_s: float = FORGOTTEN_S) -> DataFrame:
    """Valid rows with kept: strictly newer than all kept before of their vehicle. Repeats stay, as they show which snapshots there were.

    State is one time a vehicle, in the checkpoint, and goes ttl_s seconds after the vehicle was last heard of (by the clock
    of the run, so nothing is dropped for being late); a vehicle that comes back later begins anew. Needs the RocksDB state
    store, which is set for the session.
    """
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = rows.filter("not invalid")
    out = T.StructType([*rows.schema.fields, T.StructField("kept", T.BooleanType())])
    return rows.groupBy(*KEY).transformWithStateInPandas(Newest(rows.schema.fieldNames(), ttl_s), out, "append", "processingTime")


def run_to_folder(rows: DataFrame, out: str, checkpoint: str, nominal_s: float = NOMINAL_S) -> StreamingQuery:
    """Writes the kept rows of what there is, with stale: recorded before the previous snapshot (of whatever vehicles) was sent.

    Each micro-batch goes to a place of its own number, and so does the time of its last snapshot, so that a replayed batch
    replaces itself and looks at what came before it alone.
    """
    times = f"{checkpoint}/snapshots"

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        batch.agg(F.max("response_ts").alias("last")).write.mode("overwrite").parquet(f"{times}/batch={number}")
        (last,) = spark.read.parquet(times).filter(F.col("batch") < number).agg(F.max("last")).first()
        cuts = previous_snapshots(batch, "response_ts", nominal_s, F.lit(last))
        fresh = flagged_stale(batch.filter("kept").drop("kept"), cuts, "response_ts", "recorded_at")
        fresh.withColumn("day", F.to_date("recorded_at")).write.mode("overwrite").parquet(f"{out}/batch={number}")
        batch.unpersist()

    # State that ends by the clock would ask for batches without data for ever; a query takes its settings when it starts.
    spark, setting = rows.sparkSession, "spark.sql.streaming.noDataMicroBatches.enabled"
    was = spark.conf.get(setting)
    spark.conf.set(setting, "false")
    try:
        return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(setting, was)


def close_day(spark: SparkSession, parts: str, out: str, day: str) -> None:
    """A day's parts as one set of files, in order of operator, vehicle and time."""
    rows = spark.read.parquet(parts).filter(F.col("day") == day).drop("batch")
    rows.repartitionByRange(*KEY, "recorded_at").sortWithinPartitions(*KEY, "recorded_at").write.mode("overwrite").parquet(f"{out}/day={day}")


def latest_per_bucket(rows: DataFrame, seconds: int, watermark: str = "1 day") -> DataFrame:
    """The latest row of each vehicle and clock bucket, as a windowed aggregate for streams."""
    every = F.window("recorded_at", f"{seconds} seconds")
    cols = [c for c in rows.columns if c not in KEY]
    return rows.withWatermark("recorded_at", watermark).groupBy(*KEY, every.alias("bucket")).agg(F.max_by(F.struct(*cols), "recorded_at").alias("r")).select(*KEY, "bucket", "r.*")


class Governor:
    """How fast to ask a server: halts after failures in a row or a failing share, doubles its interval when answers get slow.

    Of each window of requests the median time to the first byte is compared with the first window's; at twice that or more
    the interval doubles, up to a limit.
    """

    def __init__(self, interval: float = 1.0, most: float = 60.0, in_a_row: int = 5, share: float = 0.2, least: int = 20, window_s: float = 600.0, batch: int = 50):
        self.interval, self.most, self.in_a_row, self.share, self.least, self.window_s, self.batch = interval, most, in_a_row, share, least, window_s, batch
        self.seen: list[tuple[float, bool]] = []
        self.times: list[float] = []
        self.base: float | None = None
        self.run, self.halted = 0, ""

    def tell(self, now: float, failed: bool, first_byte: float | None = None) -> None:
        self.run = self.run + 1 if failed else 0
        self.seen = [x for x in self.seen if x[0] > now - self.window_s] + [(now, failed)]
        bad = sum(f for _, f in self.seen)
        if self.run >= self.in_a_row:
            self.halted = "failures in a row"
        elif len(self.seen) >= self.least and bad > self.share * len(self.seen):
            self.halted = "share of failures"
        if first_byte is not None:
            self.times.append(first_byte)
            if len(self.times) == self.batch:
                median = sorted(self.times)[self.batch // 2]
                self.times = []
                if self.base is None:
                    self.base = median
                elif median >= 2 * self.base:
                    self.interval = min(self.most, self.interval * 2)

    def wait(self, attempt: int, retry_after: float = 0.0, jitter: float = 0.0, start: float = 1.0) -> float:
        """Seconds before the next attempt; jitter in 0 to 1 adds up to a tenth."""
        return max(self.interval, retry_after, min(self.most, start * 2**attempt) * (1 + 0.1 * jitter))
