"""Row numbers that never sort one large group, or the whole table, in a single task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from twinfinder.plans.skew import HotKeys, find_hot_keys
from twinfinder.session import checkpointed

_PART_BITS = 33  # monotonically_increasing_id keeps the partition above bit 33 and the row below


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Number all rows 0, 1, 2, … in a total order.

    The rows are range-partitioned and sorted, then stored with their partition and their place in it; each
    partition starts where the ones before it end. Only one row count per partition reaches the driver.
    """
    sorted_rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = checkpointed(sorted_rows.withColumn("_row", F.monotonically_increasing_id()))
    part = F.shiftright("_row", _PART_BITS)
    counts = ranged.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()
    starts, total = [], 0
    for part_no, n in sorted((r["part"], r["n"]) for r in counts):
        starts.append((part_no, total))
        total += n
    offsets = df.sparkSession.createDataFrame(starts, "_part bigint, _start bigint")
    within = F.col("_row").bitwiseAND(F.lit((1 << _PART_BITS) - 1))
    return (
        ranged.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_start") + within)
        .drop("_row", "_part", "_start")
    )


def row_numbers(
    df: DataFrame, keys: list[str], order: list[Column], name: str, hot: HotKeys | None = None
) -> DataFrame:
    """Number the rows of every key 1, 2, 3, … in a total order.

    Ordinary keys use a window. Rows of hot keys are numbered together by `numbered`, minus where their key
    starts; there are at most as many starts as hot keys, so those are broadcast.
    """
    hot = find_hot_keys(df, keys) if hot is None else hot
    window = Window.partitionBy(*keys).orderBy(*order)
    if not hot:
        return df.withColumn(name, F.row_number().over(window).cast("bigint"))
    cold, large = hot.split(df)
    cold = cold.withColumn(name, F.row_number().over(window).cast("bigint"))
    return cold.unionByName(hot_row_numbers(large, keys, order, name))


def hot_row_numbers(
    large: DataFrame, keys: list[str], order: list[Column], name: str, count: str | None = None
) -> DataFrame:
    """`row_numbers` of a few keys with very many rows each; `count` names a column for how many their key has.

    Numbering all rows together tells both where a key starts and how large it is.
    """
    large = numbered(large, [F.col(k).asc() for k in keys] + order, "_pos")
    starts = large.groupBy(*keys).agg(F.min("_pos").alias("_first"), F.count("*").alias(count or "_rows"))
    large = large.join(F.broadcast(starts), keys).withColumn(name, F.col("_pos") - F.col("_first") + 1)
    return large.drop("_pos", "_first", "_rows")
