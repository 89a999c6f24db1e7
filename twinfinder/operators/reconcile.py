"""Comparing two indexes by sketches: what they have in common is never brought together.

Contents fall into buckets by hash. For every bucket an index stores an invertible sketch: each content is added to three
cells of it, which hold a count and the exclusive-or of keys. Subtracting the sketches of two indexes leaves only
contents that differ; a cell with a single one gives its key away, and taking that out of its other cells uncovers
more. Buckets whose difference is too large for their cells are read from both sides and compared as they are; buckets
with equal sketches are not read at all.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from twinfinder.operators.index import live
from twinfinder.plans.skew import HotKeys, skewed_join
from twinfinder.session import checkpointed

CONTENT, ROW = ["hash", "size"], ["repo", "path"]
# Cells of one part of a sketch; a bucket decodes about two contents for every three of its cells.
PARTS, WIDTH = 3, 20
KEYS = ["k1", "k2"]
# A list of so many buckets prunes the partitions that are read; a longer one is joined.
MOST_LISTED = 10_000


def _cells() -> Column:
    """The cells of a key, one in each part; live and deleted of one content lie in different ones."""
    return F.array(*[(F.lit(p * WIDTH) + F.pmod(F.xxhash64(*KEYS, F.lit(p)), F.lit(WIDTH))).cast("int") for p in range(PARTS)])


def _check(k1: Column, k2: Column) -> Column:
    return F.xxhash64(k1, k2, F.lit(97))


@dataclass(frozen=True)
class Contents:
    """The stored contents of one index, partitioned by `bucket`, and the sketch of every bucket."""

    spark: SparkSession
    folder: str
    buckets: int

    def contents(self) -> DataFrame:
        """`bucket`, `hash`, `size`, `alive` (whether a live record has the content), and the 128-bit key `k1`, `k2`."""
        schema = "k1 bigint, k2 bigint, hash string, size bigint, alive boolean, bucket int"
        return self.spark.read.schema(schema).parquet(f"{self.folder}/contents")

    def sketch(self) -> DataFrame:
        schema = "bucket int, cell int, n bigint, k1 bigint, k2 bigint, check bigint"
        return self.spark.read.schema(schema).parquet(f"{self.folder}/sketch")


def store_contents(state: DataFrame, folder: str, buckets: int) -> Contents:
    """Store contents and sketches of a compacted state; two indexes must have the same number of buckets.

    About a thousand contents a bucket make sketches of a few per cent of the contents' size.
    """
    stored = Contents(state.sparkSession, folder.rstrip("/"), buckets)
    contents = state.groupBy(*CONTENT).agg(F.bool_or(~F.col("missing")).alias("alive"))
    # The lowest bit of the key tells live from deleted, so that these differ as contents do.
    second = F.xxhash64(F.lit(2), *CONTENT).bitwiseAND(F.lit(-2)).bitwiseOR(F.col("alive").cast("bigint"))
    keyed = contents.withColumns({"k1": F.xxhash64(*CONTENT), "k2": second})
    keyed = keyed.withColumn("bucket", F.pmod(F.xxhash64("k1", F.lit(5)), F.lit(buckets)).cast("int"))
    keyed.select(*KEYS, *CONTENT, "alive", "bucket").repartition("bucket").write.partitionBy("bucket").parquet(f"{stored.folder}/contents")
    entries = stored.contents().select("bucket", *KEYS, F.explode(_cells()).alias("cell"))
    sketch = entries.groupBy("bucket", "cell").agg(
        F.count("*").alias("n"), F.bit_xor("k1").alias("k1"), F.bit_xor("k2").alias("k2"),
        F.bit_xor(_check(F.col("k1"), F.col("k2"))).alias("check"),
    )
    sketch.write.parquet(f"{stored.folder}/sketch")
    return stored


def _subtracted(a: Contents, b: Contents) -> DataFrame:
    """The cells of all buckets that differ, stored."""
    def signed(sketch: DataFrame, sign: int) -> DataFrame:
        return sketch.withColumn("n", F.col("n") * sign)

    return _folded(signed(a.sketch(), 1).unionByName(signed(b.sketch(), -1)))


def _folded(cells: DataFrame) -> DataFrame:
    """One row per cell that is not empty, stored."""
    sums = cells.groupBy("bucket", "cell").agg(
        F.sum("n").alias("n"), *[F.bit_xor(c).alias(c) for c in (*KEYS, "check")]
    )
    return checkpointed(sums.filter("n <> 0 OR k1 <> 0 OR k2 <> 0 OR check <> 0"))


def differences(a: Contents, b: Contents) -> tuple[DataFrame, dict[str, int]]:
    """(`side`, `k1`, `k2`) of the contents that only one index has, 1 for `a` and -1 for `b`; and what was looked at.

    Cells are peeled in rounds of Spark's own functions: each takes out all contents that are alone in a cell. What is
    left when a round finds none belongs to buckets that are read: `read` counts their contents on both sides.
    """
    if a.buckets != b.buckets:
        raise ValueError("sketches with different numbers of buckets cannot be compared")
    cells = _subtracted(a, b)
    differing = cells.select("bucket").distinct().count()
    found = []
    while True:
        single = (F.abs("n") == 1) & (F.col("check") == _check(F.col("k1"), F.col("k2")))
        alone = checkpointed(cells.filter(single).select("bucket", F.col("n").cast("int").alias("side"), *KEYS).distinct())
        if alone.isEmpty():
            break
        found.append(alone)
        taken = alone.select(
            "bucket", F.explode(_cells()).alias("cell"), (-F.col("side")).cast("bigint").alias("n"), *KEYS, _check(F.col("k1"), F.col("k2")).alias("check")
        )
        cells = _folded(cells.unionByName(taken))
    stuck = checkpointed(cells.select("bucket").distinct())
    undecoded = [r["bucket"] for r in stuck.collect()] if stuck.count() <= MOST_LISTED else None
    sides = []
    read = 0
    if undecoded != []:
        def of(index: Contents) -> DataFrame:
            rows = index.contents()
            # A listed set of partitions is pruned before anything is read.
            return rows.filter(F.col("bucket").isin(undecoded)) if undecoded is not None else rows.join(stuck, "bucket", "left_semi")

        left, right = of(a).select("bucket", *KEYS), of(b).select("bucket", *KEYS)
        read = left.count() + right.count()
        for side, mine, other in ((1, left, right), (-1, right, left)):
            sides.append(mine.join(other, ["bucket", *KEYS], "left_anti").select("bucket", F.lit(side).alias("side"), *KEYS))
    schema = "bucket int, side int, k1 bigint, k2 bigint"
    result = a.spark.createDataFrame([], schema)
    for part in found:
        # What was taken out of a bucket that stayed undecodable is found again by reading it.
        result = result.unionByName(part.join(stuck, "bucket", "left_anti"))
    for part in sides:
        result = result.unionByName(part)
    looked = {"buckets": a.buckets, "differing": differing, "read_buckets": stuck.count(), "read": read}
    return checkpointed(result), looked


def reconciled_status(
    source: DataFrame, a: Contents, b: Contents, hot: HotKeys | None = None
) -> tuple[DataFrame, dict[str, int]]:
    """The status of every live row of `source`, as by `diff.diff_status` without the matching path; and what was read.

    `a` and `b` are the stored contents of source and target. Of the target only sketches are read, and the contents
    of buckets that could not be decoded.
    """
    found, looked = differences(a, b)
    plain = F.col("k2").bitwiseAND(F.lit(-2)).alias("k2")
    mine = found.filter((F.col("side") == 1) & (F.col("k2").bitwiseAND(F.lit(1)) == 1)).select("k1", plain)
    deleted = found.filter((F.col("side") == -1) & (F.col("k2").bitwiseAND(F.lit(1)) == 0)).select("k1", plain)
    deleted = deleted.withColumn("_status", F.lit("deleted_in_target"))
    changed = mine.join(deleted, KEYS, "left").withColumn("_status", F.coalesce("_status", F.lit("new")))
    keyed = live(source).select(*ROW, *CONTENT).withColumns(
        {"k1": F.xxhash64(*CONTENT), "k2": F.xxhash64(F.lit(2), *CONTENT).bitwiseAND(F.lit(-2))}
    )
    joined = skewed_join(keyed, changed, KEYS, "left", ROW, hot)
    return joined.select(*ROW, *CONTENT, F.coalesce("_status", F.lit("equal")).alias("status")), looked
