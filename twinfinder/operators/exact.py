"""Groups of records with equal content, across any number of repos."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from twinfinder.functions.hashing import is_fallback
from twinfinder.operators.filters import dim_filter
from twinfinder.operators.index import live
from twinfinder.plans.skew import HotKeys, find_hot_keys

GROUP = ["kind", "group_key"]
ROW = ["repo", "path"]


def candidates(state: DataFrame, width: str | None = None, height: str | None = None) -> DataFrame:
    """Live records that pass the dimension filter."""
    rows = live(state)
    return rows if width is None and height is None else rows.filter(dim_filter(width, height))


def was_read() -> Column:
    """Whether a record has the hash of its content; only that of an empty one is empty."""
    return F.col("hash").isNotNull() & ((F.col("hash") != "") | (F.col("size") == 0))


def content_keys(rows: DataFrame) -> DataFrame:
    """Give each record its content group, and a second one to records with a fallback video hash.

    A record without a hash (its content was never read) is in no group of equal contents.
    """
    exact = F.when(was_read(), F.struct(F.lit("exact").alias("kind"), F.col("hash").alias("h")))
    if "video_hash" in rows.columns:
        fallback = F.struct(F.lit("fallback").alias("kind"), F.col("video_hash").alias("h"))
        keys = F.explode(F.array_compact(F.array(exact, F.when(is_fallback("video_hash"), fallback))))
        rows = rows.filter(was_read() | is_fallback("video_hash"))
    else:
        keys = exact
        rows = rows.filter(was_read())
    return (
        rows.withColumn("_key", keys)
        .withColumns({"kind": F.col("_key.kind"), "group_key": F.concat_ws(":", "_key.h", "size")})
        .drop("_key")
    )


def repeated(keyed: DataFrame, hot: HotKeys | None = None) -> DataFrame:
    """Rows whose group has more than one member, with the number of `copies`.

    One shuffle by group, which ranking can go on to use. Rows of hot groups stay where they are: their counts
    are pre-aggregated, at most as many as there are hot keys, and broadcast to them.
    """
    hot = find_hot_keys(keyed, GROUP) if hot is None else hot
    counted = F.count("*").over(Window.partitionBy(*GROUP))
    if not hot:
        return keyed.withColumn("copies", counted).filter(F.col("copies") > 1)
    cold, large = hot.split(keyed)
    sizes = large.groupBy(*GROUP).agg(F.count("*").alias("copies"))
    parts = cold.withColumn("copies", counted).unionByName(large.join(F.broadcast(sizes), GROUP))
    return parts.filter(F.col("copies") > 1)


def exact_groups(
    state: DataFrame, width: str | None = None, height: str | None = None, hot: HotKeys | None = None
) -> DataFrame:
    """Duplicate groups by (hash, size) over all live records of `state`, whichever repo they are in."""
    return repeated(content_keys(candidates(state, width, height)), hot)


def stored_groups(state: DataFrame, width: str | None = None, height: str | None = None) -> DataFrame:
    """`exact_groups` of a state that is stored in buckets of (hash, size), such as `catalog.read_states`.

    Groups are counted where they lie, without an exchange of contents; fallback groups, which have another key,
    shuffle their own few rows. A content is in one bucket, so one that holds a large share of all rows is one long
    task; `exact_groups` cuts such contents up.
    """
    rows = candidates(state, width, height)
    counted = F.count("*").over(Window.partitionBy("hash", "size"))
    alike = rows.filter(was_read()).withColumn("copies", counted).filter(F.col("copies") > 1)
    alike = alike.withColumns({"kind": F.lit("exact"), "group_key": F.concat_ws(":", "hash", "size")})
    fallback = rows.filter(is_fallback("video_hash"))
    fallback = fallback.withColumns({"kind": F.lit("fallback"), "group_key": F.concat_ws(":", "video_hash", "size")})
    return alike.unionByName(repeated(fallback))


def text_groups(
    state: DataFrame, width: str | None = None, height: str | None = None, hot: HotKeys | None = None
) -> DataFrame:
    """Groups of records with the same text hash."""
    rows = candidates(state, width, height).filter(F.trim("pdf_hash") != "")
    return repeated(rows.withColumns({"kind": F.lit("text"), "group_key": F.col("pdf_hash")}), hot)
