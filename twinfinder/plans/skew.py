"""Joins and detection of keys that hold too many rows for one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Rows of one key that a single task may handle comfortably.
ROWS_PER_TASK = 2_000_000
# Share of rows looked at when searching for hot keys.
SAMPLE = 1 / 1024
_KEY = "_key_hash"
_SALT = "_salt"
_SLICES = "_slices"


class HotKeys:
    """Key hashes with the number of slices each should be cut into: at most one for every ROWS_PER_TASK rows.

    Read once by the driver and then fixed, so that both sides of a join agree on it. It only steers the
    distribution of work: missing or additional entries never change a result.
    """

    def __init__(self, keys: list[str], slices: dict[int, int]):
        self.keys = list(keys)
        self.slices = slices

    def __bool__(self) -> bool:
        return bool(self.slices)

    def attach(self, df: DataFrame, keys: list[str] | None = None) -> DataFrame:
        """Add the slice count of each row's key (null for ordinary keys) from a broadcast of the fixed list."""
        table = df.sparkSession.createDataFrame(
            list(self.slices.items()), f"{_KEY} bigint, {_SLICES} int"
        )
        tagged = df.withColumn(_KEY, key_hash(keys or self.keys))
        return tagged.join(F.broadcast(table), _KEY, "left").drop(_KEY)

    def split(self, df: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(rows of ordinary keys, rows of hot keys)."""
        tagged = self.attach(df)
        return (
            tagged.filter(F.col(_SLICES).isNull()).drop(_SLICES),
            tagged.filter(F.col(_SLICES).isNotNull()).drop(_SLICES),
        )


def key_hash(keys: list[str]) -> Column:
    return F.xxhash64(*[F.col(k) for k in keys])


def find_hot_keys(
    df: DataFrame, keys: list[str], rows_per_task: int = ROWS_PER_TASK, sample: float = SAMPLE
) -> HotKeys:
    """Look for keys with more than `rows_per_task` rows in a sample of `df`."""
    rows = df if sample >= 1 else df.sample(fraction=sample, seed=11)
    share = min(sample, 1.0)
    found = (
        rows.select(key_hash(keys).alias(_KEY))
        .groupBy(_KEY)
        .agg(F.count("*").alias("n"))
        .filter(F.col("n") > rows_per_task * share)
        .collect()
    )
    return HotKeys(keys, {r[_KEY]: int(r["n"] / share / rows_per_task) + 1 for r in found})


def skewed_join(
    many: DataFrame,
    one: DataFrame,
    keys: list[str],
    how: str,
    spread: list[str],
    hot: HotKeys | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Equi-join of a side that may be skewed with a side that has few rows per key.

    Rows of `many` with a hot key are spread over slices by their `spread` columns and meet a copy of the
    matching rows of `one` in each slice. Without hot keys this is a plain join. `how` is one of inner, left,
    left_semi, left_anti. With `partitions` both sides are shuffled into that many, whatever their size.
    """
    hot = find_hot_keys(many, keys) if hot is None else hot

    def join(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
        if partitions is None:
            return left.join(right, on, how)
        return left.repartition(partitions, *on).join(right.repartition(partitions, *on).hint("merge"), on, how)

    if not hot:
        return join(many, one, keys)
    salt = F.coalesce(F.pmod(F.xxhash64(*[F.col(c) for c in spread]), F.col(_SLICES)), F.lit(0).cast("bigint"))
    left = hot.attach(many, keys).withColumn(_SALT, salt).drop(_SLICES)
    copies = F.sequence(F.lit(0).cast("bigint"), F.coalesce(F.col(_SLICES), F.lit(1)) - F.lit(1).cast("bigint"))
    right = hot.attach(one, keys).withColumn(_SALT, F.explode(copies)).drop(_SLICES)
    return join(left, right, [*keys, _SALT]).drop(_SALT)
