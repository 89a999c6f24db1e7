"""Structured Streaming forms of compaction and exact duplicate detection."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from twinfinder.operators.index import latest
from twinfinder.plans.skew import HotKeys, skewed_join
from twinfinder.sources.versions import Versions

KEYS = ["repo", "path"]
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_stream(
    spark: SparkSession, folder: str, schema: T.StructType, pattern: str = "*.parquet", files_per_batch: int = 1000
) -> DataFrame:
    """A folder of Parquet files as a stream; new files that fit the pattern are new records."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    return reader.option("pathGlobFilter", pattern).parquet(folder)


def latest_stream(log: DataFrame) -> DataFrame:
    """The newest record of every path so far, for update mode.

    A late record with a lower `seq` than the one held changes nothing, so no watermark is needed. State is one
    record per path.
    """
    values = [c for c in log.columns if c not in KEYS]
    newest = F.max_by(F.struct(*values), "seq").alias("r")
    return log.groupBy(*KEYS).agg(newest).select(*KEYS, "r.*")


def write_latest(updates: DataFrame, table_path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Keep the updates of `latest_stream` as one folder per batch; `read_latest` reads the current state.

    A batch that is repeated after a failure overwrites its own folder, so every update is stored once.
    """
    def store(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{table_path}/batch={number}")

    writer = updates.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
    return writer.foreachBatch(store).trigger(**(trigger or {"availableNow": True})).start()


def _stored(spark: SparkSession, table_path: str) -> tuple[DataFrame, int]:
    """What is stored of a stream: the merged part and the batches after it; and the number of the last batch."""
    versions = Versions(spark, table_path)
    _, state = versions.current()
    folders = versions._fs.globStatus(versions._path(f"{versions.folder}/batch=*")) or []
    numbers = sorted(int(f.getPath().getName()[len("batch="):]) for f in folders)
    newer = [n for n in numbers if n > state.get("through", -1)]
    paths = [f"{versions.folder}/batch={n}" for n in newer]
    if state:
        paths.append(versions.part_path(state["part"]))
    return spark.read.parquet(*paths), max([state.get("through", -1), *numbers])


def read_latest(spark: SparkSession, table_path: str) -> DataFrame:
    return latest(_stored(spark, table_path)[0])


def merge_latest(spark: SparkSession, table_path: str) -> int:
    """Replace the stored batches of `write_latest` by the current state; the number of the last batch in it.

    The merged part counts from the moment its pointer is written; a stream may go on meanwhile, its later batches
    stay beside it. `clean_latest` deletes what was merged.
    """
    stored, through = _stored(spark, table_path)
    versions, part = Versions(spark, table_path), uuid.uuid4().hex
    number, _ = versions.current()
    latest(stored).write.parquet(versions.part_path(part))
    versions.commit(number, {"part": part, "through": through})
    return through


def clean_latest(spark: SparkSession, table_path: str) -> int:
    """Delete the batches that are merged; call it when no other job reads the table. How many there were."""
    versions = Versions(spark, table_path)
    _, state = versions.current()
    folders = versions._fs.globStatus(versions._path(f"{versions.folder}/batch=*")) or []
    merged = [f.getPath() for f in folders if int(f.getPath().getName()[len("batch="):]) <= state.get("through", -1)]
    for folder in merged:
        versions._fs.delete(folder, True)
    return len(merged)


def contents_stream(records: DataFrame) -> DataFrame:
    """Copies and first sequence number of every (hash, size) so far, for update mode.

    Aggregated before the shuffle, so a very common content costs one row per task and batch. All contents ever
    seen are kept as state; `first_seen_within` bounds it.
    """
    return records.groupBy("hash", "size").agg(F.count("*").alias("copies"), F.min("seq").alias("first_seq"))


def first_seen_within(records: DataFrame, event_time: str, delay: str) -> DataFrame:
    """The first record of every (hash, size), with bounded state.

    Repeats that follow within `delay` of event time are always recognised; later ones count as first again as soon
    as the watermark has passed the one held.
    """
    return records.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["hash", "size"])


def write_contents(updates: DataFrame, table_path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Keep the updates of `contents_stream`; `read_contents` reads the current counts."""
    return write_latest(updates, table_path, checkpoint, **trigger)


def read_contents(spark: SparkSession, table_path: str) -> DataFrame:
    """Counts only grow and first numbers only fall, so the newest values are the extremes of all updates."""
    stored = spark.read.parquet(table_path)
    return stored.groupBy("hash", "size").agg(F.max("copies").alias("copies"), F.min("first_seq").alias("first_seq"))


class Repeats(StatefulProcessor):
    """Emits each record whose content has come before, when it arrives.

    The state of a content is one value: the number of its first record, and until when it is held. A timer takes it
    away as soon as the watermark has passed that time; every record of the content moves the time on by `keep_ms`.
    """

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "first_seq bigint, until bigint")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        # The records of one content in one batch, as narrow rows; what a batch holds is bounded by its trigger.
        new = pd.concat(list(rows), ignore_index=True).sort_values(["seq", "repo", "path"], kind="stable")
        known = self.held.get() if self.held.exists() else None
        if known and known[1] <= timerValues.getCurrentWatermarkInMs():  # its timer comes after the rows of this batch
            self.handle.deleteTimer(int(known[1]))
            known = None
        first, until = (int(known[0]), int(known[1])) if known else (int(new["seq"].iloc[0]), None)
        latest = int(new["at_ms"].max()) + self.keep_ms
        if until is None or latest > until:
            if until is not None:
                self.handle.deleteTimer(until)
            self.handle.registerTimer(latest)
            until = latest
        self.held.update((first, until))
        repeated = new if known else new.iloc[1:]
        yield repeated[["repo", "path", "seq", "hash", "size"]].assign(first_seq=first)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.held.clear()
        yield pd.DataFrame()

    def close(self) -> None:
        pass


def repeats_stream(records: DataFrame, event_time: str, delay: str, keep: str) -> DataFrame:
    """Records whose (hash, size) has come before, with the number of its first record, for append mode.

    Within a batch the first is the one with the lowest `seq`. Records later than the watermark (`delay` behind the
    newest) are dropped, as are those without hash, size, `seq` or time. A content is held for `keep` of event time
    after its last record, so state is bounded; one that comes again later counts as new.
    """
    spark = records.sparkSession
    keep_ms = int(spark.range(1).select((F.unix_millis(F.timestamp_seconds(F.lit(0)) + F.expr(f"INTERVAL {keep}"))).alias("ms")).first()["ms"])
    timed = records.withWatermark(event_time, delay)
    narrow = timed.filter(F.col("seq").isNotNull() & F.col("hash").isNotNull() & F.col("size").isNotNull()).select(
        *KEYS, "seq", "hash", "size", F.unix_millis(event_time).alias("at_ms"), event_time
    )
    schema = T.StructType([records.schema[c] for c in (*KEYS, "seq", "hash", "size")]).add("first_seq", T.LongType())
    return narrow.groupBy("hash", "size").transformWithStateInPandas(
        Repeats(keep_ms), outputStructType=schema, outputMode="Append", timeMode="EventTime"
    )


def write_repeats(found: DataFrame, folder: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Write what `repeats_stream` finds as Parquet files; started again, it goes on from its checkpoint."""
    spark = found.sparkSession
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKS)  # read when the query starts; timers need it
    try:
        writer = found.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint)
        return writer.option("path", folder).trigger(**(trigger or {"availableNow": True})).start()
    finally:
        spark.conf.set(STORE, before)


def exact_duplicates(records: DataFrame, contents: DataFrame, hot: HotKeys | None = None) -> DataFrame:
    """Records whose (hash, size) was seen earlier, with the number of that first record."""
    repeated = contents.filter(F.col("copies") > 1).select("hash", "size", "first_seq")
    joined = skewed_join(records, repeated, ["hash", "size"], "inner", KEYS, hot)
    return joined.filter(F.col("seq") > F.col("first_seq"))
