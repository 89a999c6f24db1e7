"""The index as a log of records: compaction, lookups, statistics, pruning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from twinfinder.plans.skew import HotKeys, skewed_join
from twinfinder.schema import DEFAULT_BUCKETS, bucket_of

COUNTERS = ["Lines", "Changes", "files", "missing", "duplicates"]


def _last(log: DataFrame, keys: list[str], *order: str) -> DataFrame:
    newest_first = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return log.withColumn("_turn", F.row_number().over(newest_first)).filter(F.col("_turn") == 1).drop("_turn")


def latest(log: DataFrame, shard: str | None = None) -> DataFrame:
    """Last record of every (repo, path), tombstones included.

    The `= 1` on the row number lets Spark trim each key before the shuffle, so a path with very many records
    costs one row per task. With a `shard` column, `seq` counts inside a shard; a path that occurs in several
    shards is settled by the modification time of its last record in each.
    """
    if shard is None:
        return _last(log, ["repo", "path"], "seq")
    return _last(_last(log, ["repo", "path", shard], "seq"), ["repo", "path"], "last_modified", shard)


def live(state: DataFrame) -> DataFrame:
    """Records that are not tombstones."""
    return state.filter(~F.col("missing"))


def lookup_path(state: DataFrame, path: str) -> DataFrame:
    """Newest record of a path in each repo, by modification time and then log order; may be a tombstone."""
    rows = state.filter(F.col("path") == path)
    names = rows.columns
    newest = F.max_by(F.struct(*names), F.struct("last_modified", "seq")).alias("r")
    return rows.groupBy("repo", "path").agg(newest).select("r.*")


def lookup_hash(state: DataFrame, content_hash: str, size: int | None = None) -> DataFrame:
    """Current records of a hash, tombstones included; optionally of one size."""
    rows = state.filter(F.col("hash") == content_hash)
    return rows if size is None else rows.filter(F.col("size") == size)


def lookup_contents(state: DataFrame, wanted: DataFrame, hot: HotKeys | None = None) -> DataFrame:
    """Current records whose (hash, size) occurs in `wanted`."""
    content = ["hash", "size"]
    return skewed_join(state, wanted.select(*content).distinct(), content, "left_semi", ["repo", "path"], hot)


def index_stats(log: DataFrame, buckets: int = DEFAULT_BUCKETS) -> DataFrame:
    """(repo, counter, value): records read, records that replaced another, live and deleted paths, and how many
    live paths of a bucket repeat a hash of that bucket.
    """
    last = F.max_by(F.struct("hash", "size", "missing"), "seq")
    paths = log.groupBy("repo", "path").agg(F.count("*").alias("n"), last.alias("last"))
    alive = (~F.col("last.missing")).cast("bigint")
    contents = paths.groupBy(
        "repo", bucket_of(F.col("last.size"), buckets).alias("bucket"), F.col("last.hash").alias("hash")
    ).agg(F.sum("n").alias("n"), F.count("*").alias("paths"), F.sum(alive).alias("alive"))
    totals = contents.groupBy("repo").agg(
        F.sum("n").alias("Lines"),
        F.sum(F.col("n") - F.col("paths")).alias("Changes"),
        F.sum("alive").alias("files"),
        F.sum(F.col("paths") - F.col("alive")).alias("missing"),
        F.sum(F.greatest(F.col("alive") - 1, F.lit(0))).alias("duplicates"),
    )
    return totals.unpivot(["repo"], COUNTERS, "counter", "value")


def merge_stats(*stats: DataFrame) -> DataFrame:
    """Sum of counters by name, in name order."""
    parts = [s.select("counter", "value") for s in stats]
    return (
        reduce(DataFrame.unionByName, parts).groupBy("counter").agg(F.sum("value").alias("value")).orderBy("counter")
    )


def prune(log: DataFrame, buckets: int = DEFAULT_BUCKETS, keep_deleted: bool = False) -> DataFrame:
    """What remains after pruning: the last state, without tombstones unless wanted, with its new bucket."""
    state = latest(log)
    kept = state if keep_deleted else live(state)
    return kept.withColumn("bucket", bucket_of("size", buckets))


def next_seq(log: DataFrame) -> int:
    """A sequence number above all of the log's."""
    return (log.agg(F.max("seq")).first()[0] or 0) + 1


def with_records(log: DataFrame, records: DataFrame, seq: int | Column | None = None) -> DataFrame:
    """The log followed by `records` (one per path), which win over what it holds for their paths."""
    number = seq if isinstance(seq, Column) else F.lit(next_seq(log) if seq is None else seq).cast("bigint")
    return log.unionByName(records.withColumn("seq", number).select(*log.columns))
