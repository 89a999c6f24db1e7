"""Which copy to keep, and plans that act on the others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from twinfinder.functions.media import rank_area
from twinfinder.functions.text import file_name, join_path
from twinfinder.operators.exact import GROUP, ROW, candidates, content_keys, repeated
from twinfinder.operators.index import live, with_records
from twinfinder.plans.numbering import hot_row_numbers, numbered, row_numbers
from twinfinder.plans.skew import HotKeys, find_hot_keys, skewed_join
from twinfinder.session import checkpointed


def keep_order(df: DataFrame) -> list[Column]:
    """Ascending sort values, the copy to keep first: larger image, larger file, older, path, then tie-breakers."""
    pixels = rank_area("image_size") if "image_size" in df.columns else F.lit(-1).cast("bigint")
    return [
        (-pixels).alias("_o0"),
        (-F.col("size")).alias("_o1"),
        F.col("last_modified").alias("_o2"),
        F.lower("path").alias("_o3"),
        F.col("path").alias("_o4"),
        F.col("repo").alias("_o5"),
    ]


def rank_group(groups: DataFrame, hot: HotKeys | None = None) -> DataFrame:
    """Add `rank`: 1 for the copy to keep, then 2, 3, … in keep order. Very large groups are ranked in parts."""
    ordered, names = _ordered(groups)
    return row_numbers(ordered, GROUP, [F.col(n).asc() for n in names], "rank", hot).drop(*names)


def _ordered(groups: DataFrame) -> tuple[DataFrame, list[str]]:
    order = keep_order(groups)
    names = [f"_o{i}" for i in range(len(order))]
    return groups.withColumns(dict(zip(names, order))), names


def ranked_exact(state: DataFrame, width: str | None = None, height: str | None = None, **limits) -> DataFrame:
    """Exact groups with ranks; large groups are looked for once, for grouping and ranking together.

    If there are any, records are stored before they are split. The sort that numbers large groups counts them as well.
    """
    keyed = content_keys(candidates(state, width, height))
    hot = find_hot_keys(keyed, GROUP, **limits)
    none = HotKeys(GROUP, {})
    if not hot:
        return rank_group(repeated(keyed, none), none)
    cold, large = hot.split(checkpointed(keyed))
    large, names = _ordered(large)
    large = hot_row_numbers(large, GROUP, [F.col(n).asc() for n in names], "rank", "copies").drop(*names)
    return rank_group(repeated(cold, none), none).unionByName(large.filter(F.col("copies") > 1))


def survivors(groups: DataFrame) -> DataFrame:
    """(kind, group_key, repo, path) of the copy to keep in each group, by partial aggregation."""
    first = F.min_by(F.struct(*ROW), F.struct(*keep_order(groups))).alias("first")
    return groups.groupBy(*GROUP).agg(first).select(*GROUP, "first.*")


def _others(groups: DataFrame) -> DataFrame:
    """Every row that survives in none of its groups, once, with its earliest place in plan order as `_turn`."""
    turn = F.min(F.struct(*GROUP, *keep_order(groups))).alias("_turn")
    rows = groups.groupBy(*ROW).agg(turn)
    return rows.join(survivors(groups).select(*ROW).distinct(), ROW, "left_anti")


def removal_plan(groups: DataFrame) -> DataFrame:
    """Keep the first copy of each group and remove the others; what one group keeps no other group removes.

    With a `rank` in `groups` (as from `rank_group`) this is one aggregation of rows, without one it is ranked first.
    """
    ranked = groups if "rank" in groups.columns else rank_group(groups)
    turn = F.min(F.struct(*GROUP, *keep_order(ranked))).alias("_turn")
    rows = ranked.groupBy(*ROW).agg(F.min("rank").alias("_best"), turn)
    first = F.col("_best") == 1
    return rows.select(
        F.when(first, "keep").otherwise("remove").alias("action"), *ROW, F.lit(None).cast("string").alias("target"),
        F.when(first, "first").otherwise(F.col("_turn.group_key")).alias("reason"),
    )


def move_plan(
    groups: DataFrame, directory: str, existing: DataFrame | None = None, hot: HotKeys | None = None
) -> DataFrame:
    """Move the other copies into one directory under their file names.

    A name can be taken once: the first row in plan order moves, later ones and names in `existing(path)` skip.
    """
    rows = _others(groups).withColumn("target", join_path(directory, file_name("path")))
    first = rows.groupBy("target").agg(F.min("_turn").alias("_first"))
    if existing is not None:
        taken = existing.select(F.col("path").alias("target")).distinct().withColumn("_taken", F.lit(True))
        first = first.join(taken, "target", "left").withColumn(
            "_first", F.when(F.col("_taken").isNull(), F.col("_first"))
        ).drop("_taken")
    joined = skewed_join(rows, first, ["target"], "inner", ROW, hot)
    moves = F.coalesce(F.col("_turn") == F.col("_first"), F.lit(False))
    return joined.select(
        F.when(moves, "move").otherwise("skip").alias("action"),
        *ROW,
        "target",
        F.when(moves, F.col("_turn.group_key")).otherwise("target exists").alias("reason"),
    )


def default_keep_set(ranked: DataFrame) -> DataFrame:
    """The preselected keep set: rank 1 of every group."""
    return ranked.filter(F.col("rank") == 1).select(*GROUP, "rank")


def keep_plan(ranked: DataFrame, keep: DataFrame) -> DataFrame:
    """Remove every group member that is not in `keep(kind, group_key, rank)`, unless another group keeps it."""
    chosen = keep.select(*GROUP, "rank").distinct()
    kept = ranked.join(chosen, [*GROUP, "rank"], "left_semi").select(*ROW).distinct()
    removed = ranked.select(*ROW).distinct().join(kept, ROW, "left_anti")
    nothing = F.lit(None).cast("string")
    return removed.select(
        F.lit("remove").alias("action"), *ROW, nothing.alias("target"), F.lit("not kept").alias("reason")
    )


def plan_records(state: DataFrame, done: DataFrame) -> DataFrame:
    """Deletion records for what was removed or moved, to be appended to the log.

    `done` holds the results of `files.apply_plan`, of which only rows with status `done` count; a plan, without a
    `status`, is taken as carried out.
    """
    if "status" in done.columns:
        done = done.filter("status = 'done'")
    gone = done.filter(F.col("action").isin("remove", "move", "delete")).select(*ROW).distinct()
    return live(state).join(gone, ROW, "left_semi").withColumn("missing", F.lit(True))


def apply_plan_to_log(log: DataFrame, state: DataFrame, plan: DataFrame, seq: int | None = None) -> DataFrame:
    """The log after a plan, or after the results of its execution: see `plan_records`."""
    return with_records(log, plan_records(state, plan), seq)


def number_groups(groups: DataFrame, hot: HotKeys | None = None) -> DataFrame:
    """Add `group_no`: groups counted from 1 in the order of kind and key. Only the keys are sorted."""
    keys = groups.select(*GROUP).distinct()
    counted = numbered(keys, [F.col(c).asc() for c in GROUP], "_no")
    named = counted.select(*GROUP, (F.col("_no") + 1).alias("group_no"))
    return skewed_join(groups, named, GROUP, "inner", ROW, hot)

