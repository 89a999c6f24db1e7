"""Group counts and statistics that a rescan brings up to date at the cost of its changes.

A `ContentIndex` keeps the current record of every path, in buckets of paths, and signed counts of contents: a batch of
records adds one to the content of each new live record, and takes one from that of the record it replaces. Applying
a batch reads and rewrites only the buckets that its paths fall into; counts are sums over the stored changes, which
are merged from time to time. A batch becomes visible by one pointer (see `sources.versions`), and is applied once,
however often it is tried.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from twinfinder.operators.exact import was_read
from twinfinder.operators.index import COUNTERS
from twinfinder.plans.skew import HotKeys, skewed_join
from twinfinder.schema import DEFAULT_BUCKETS, FILE_RECORD, bucket_of, normalise, records
from twinfinder.session import checkpointed
from twinfinder.sources.versions import PARTS, Conflict, Versions

CONTENT, ROW = ["hash", "size"], ["repo", "path"]
PATH_BUCKETS = 256
# So many stored batches of changes are merged into one.
MERGED = 16
_NAMES = [f.name for f in FILE_RECORD]
_CHANGE = "repo string, hash string, size bigint, lines bigint, paths bigint, alive bigint"


class ContentIndex:
    """The index in `folder`; it is made by the first batch, with `buckets` buckets of paths."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = PATH_BUCKETS):
        self.spark, self.versions, self.buckets = spark, Versions(spark, folder), buckets

    def _changes_path(self, name: str) -> str:
        return f"{self.versions.folder}/_changes/part={name}"

    def _read_state(self, generations: dict[str, str]) -> DataFrame:
        """Current records of some buckets; each lies in the part that last rewrote it."""
        schema = T.StructType([*FILE_RECORD, T.StructField("_bucket", T.IntegerType())])
        if not generations:
            return self.spark.createDataFrame([], schema)
        reader = self.spark.read.option("basePath", f"{self.versions.folder}/{PARTS}")
        with_part = T.StructType([*FILE_RECORD, T.StructField("part", T.StringType()), T.StructField("_bucket", T.IntegerType())])
        paths = [f"{self.versions.part_path(part)}/_bucket={bucket}" for bucket, part in sorted(generations.items())]
        return reader.schema(with_part).parquet(*paths).drop("part")

    def _read_changes(self, names: list[str]) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], _CHANGE)
        return self.spark.read.schema(_CHANGE).parquet(*[self._changes_path(n) for n in names])

    def apply(self, batch: int, log: DataFrame, attempts: int = 5) -> bool:
        """Apply the records of one batch; batches are numbered upwards. False if this or a later one is in already.

        Records may come in any order: for each path the highest `seq` wins, within the batch and against what is held.
        """
        for _ in range(attempts):
            number, state = self.versions.current()
            if state and batch <= state["batch"]:
                return False
            try:
                self.versions.commit(number, self._applied(state, batch, log))
                return True
            except Conflict:  # another writer changed the index: its records count now
                continue
        raise Conflict(f"{self.versions.folder} changed {attempts} times in a row")

    def _applied(self, state: dict, batch: int, log: DataFrame) -> dict:
        buckets = state.get("buckets", self.buckets)
        generations = state.get("generations", {})
        newest = F.max_by(F.struct(*[n for n in _NAMES if n not in ROW]), "seq").alias("new")
        new = normalise(records(log)).groupBy(*ROW).agg(F.count("*").alias("lines"), newest)
        new = checkpointed(new.withColumn("_bucket", F.pmod(F.xxhash64(*ROW), F.lit(buckets)).cast("int")))
        touched = [str(r["_bucket"]) for r in new.select("_bucket").distinct().collect()]
        old = self._read_state({b: generations[b] for b in touched if b in generations})
        old = old.select("_bucket", *ROW, F.struct(*[n for n in _NAMES if n not in ROW]).alias("old"))
        both = old.join(new, ["_bucket", *ROW], "full_outer")
        wins = F.col("new").isNotNull() & (F.col("old").isNull() | (F.col("new.seq") >= F.col("old.seq")))
        both = checkpointed(both.withColumn("wins", F.coalesce(wins, F.lit(False))))

        part = uuid.uuid4().hex
        kept = both.withColumn("r", F.when(F.col("wins"), F.col("new")).otherwise(F.col("old")))
        kept.select("_bucket", *ROW, "r.*").select("_bucket", *_NAMES).write.partitionBy("_bucket").parquet(self.versions.part_path(part))
        self._signed(both).write.parquet(self._changes_path(part))
        changes = [*state.get("changes", []), part]
        if len(changes) > MERGED:
            merged = uuid.uuid4().hex
            _summed(self._read_changes(changes)).write.parquet(self._changes_path(merged))
            changes = [merged]
        return {"batch": batch, "buckets": buckets, "generations": {**generations, **dict.fromkeys(touched, part)}, "changes": changes}

    def _signed(self, both: DataFrame) -> DataFrame:
        """What a batch changes, summed by repo and content; contents that stay the same are left out."""

        def change(side: str, lines: Column, sign: int) -> Column:
            alive = F.when(F.col(f"{side}.missing"), 0).otherwise(sign)
            return F.struct(
                F.col(f"{side}.hash").alias("hash"), F.col(f"{side}.size").alias("size"), lines.cast("bigint").alias("lines"),
                F.lit(sign).cast("bigint").alias("paths"), alive.cast("bigint").alias("alive"),
            )

        held = F.struct("old.hash", "old.size", F.col("lines").cast("bigint").alias("lines"), F.lit(0).cast("bigint").alias("paths"), F.lit(0).cast("bigint").alias("alive"))
        gained = F.when(F.col("wins"), change("new", F.col("lines"), 1)).otherwise(held)
        lost = F.when(F.col("wins") & F.col("old").isNotNull(), change("old", F.lit(0), -1))
        signed = both.filter(F.col("new").isNotNull()).select("repo", F.explode(F.array_compact(F.array(gained, lost))).alias("c"))
        return _summed(signed.select("repo", "c.*"))

    def _changes(self) -> DataFrame:
        return self._read_changes(self.versions.current()[1].get("changes", []))

    def state(self) -> DataFrame:
        """The current record of every path, deletions included."""
        return self._read_state(self.versions.current()[1].get("generations", {})).drop("_bucket")

    def group_counts(self) -> DataFrame:
        """(hash, size, copies) of all contents that more than one live path has."""
        counts = self._changes().filter(was_read()).groupBy(*CONTENT).agg(F.sum("alive").alias("copies"))
        return counts.filter(F.col("copies") > 1)

    def groups(self, hot: HotKeys | None = None) -> DataFrame:
        """The live records of these contents with `copies`."""
        rows = self.state().filter(~F.col("missing"))
        return skewed_join(rows, self.group_counts(), CONTENT, "inner", ROW, hot)

    def stats(self, buckets: int = DEFAULT_BUCKETS) -> DataFrame:
        """What `index.index_stats` gives for the whole log."""
        by_hash = self._changes().groupBy("repo", bucket_of("size", buckets).alias("bucket"), "hash")
        sums = by_hash.agg(*[F.sum(c).alias(c) for c in ("lines", "paths", "alive")])
        totals = sums.groupBy("repo").agg(
            F.sum("lines").alias("Lines"),
            F.sum(F.col("lines") - F.col("paths")).alias("Changes"),
            F.sum("alive").alias("files"),
            F.sum(F.col("paths") - F.col("alive")).alias("missing"),
            F.sum(F.greatest(F.col("alive") - 1, F.lit(0))).alias("duplicates"),
        )
        return totals.unpivot(["repo"], COUNTERS, "counter", "value")


def _summed(changes: DataFrame) -> DataFrame:
    sums = changes.groupBy("repo", *CONTENT).agg(*[F.sum(c).alias(c) for c in ("lines", "paths", "alive")])
    return sums.filter((F.col("lines") != 0) | (F.col("paths") != 0) | (F.col("alive") != 0))
