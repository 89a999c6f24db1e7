"""Comparison and synchronisation of two indexes by content, path being irrelevant.

`source` and `target` are compacted states. Contents of the target are aggregated to one row per (hash, size)
before joining, so nothing fans out; source rows of very common contents are spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from twinfinder.functions.text import join_path
from twinfinder.operators.index import live, with_records
from twinfinder.plans.skew import HotKeys, skewed_join

CONTENT = ["hash", "size"]
ROW = ["repo", "path"]


def _kept(rows: DataFrame, where: Column | None) -> DataFrame:
    return rows if where is None else rows.filter(where)


def _contents(target: DataFrame) -> DataFrame:
    """One row per content of the target: whether a live copy exists and the first live path."""
    alive = ~F.col("missing")
    return target.groupBy(*CONTENT).agg(
        F.bool_or(alive).alias("any_live"), F.min(F.when(alive, F.col("path"))).alias("match")
    )


def _action(name: str, rows: DataFrame, target: Column, reason: str) -> DataFrame:
    return rows.select(F.lit(name).alias("action"), *ROW, target.alias("target"), F.lit(reason).alias("reason"))


def _no_target() -> Column:
    return F.lit(None).cast("string")


def diff_status(
    source: DataFrame, target: DataFrame, where: Column | None = None, hot: HotKeys | None = None
) -> DataFrame:
    """Each live source row as `new`, `equal` (with one matching live path) or `deleted_in_target`."""
    rows = _kept(live(source), where)
    joined = skewed_join(rows, _contents(target), CONTENT, "left", ROW, hot)
    status = (
        F.when(F.col("any_live").isNull(), "new").when(F.col("any_live"), "equal").otherwise("deleted_in_target")
    )
    return joined.select(*ROW, *CONTENT, status.alias("status"), "match")


def diff_copy_plan(
    source: DataFrame,
    target: DataFrame,
    directory: str,
    where: Column | None = None,
    action: str = "copy",
    hot: HotKeys | None = None,
) -> DataFrame:
    """Copy live source rows whose content the target has never had; its deletion records block a copy."""
    rows = _kept(live(source), where)
    known = target.select(*CONTENT).distinct()
    missing = skewed_join(rows, known, CONTENT, "left_anti", ROW, hot)
    return _action(action, missing, join_path(directory, "path"), "not in target")


def diff_move_plan(
    source: DataFrame, target: DataFrame, directory: str, where: Column | None = None, hot: HotKeys | None = None
) -> DataFrame:
    """As `diff_copy_plan`, but moving; apply it to the source's log with `rank.apply_plan_to_log`."""
    return diff_copy_plan(source, target, directory, where, "move", hot)


def diff_delete_plan(
    source: DataFrame, target: DataFrame, where: Column | None = None, hot: HotKeys | None = None
) -> DataFrame:
    """Delete live source rows whose content the target holds live."""
    rows = _kept(live(source), where)
    held = live(target).select(*CONTENT).distinct()
    return _action("delete", skewed_join(rows, held, CONTENT, "left_semi", ROW, hot), _no_target(), "in target")


def sync_plan(
    source: DataFrame,
    target: DataFrame,
    copy_new: bool = True,
    delete_missing: bool = False,
    where: Column | None = None,
    occupied: DataFrame | None = None,
    hot: HotKeys | None = None,
    target_hot: HotKeys | None = None,
) -> DataFrame:
    """What to do to bring the target up to date, as rows of `action, repo, path, target, reason, hash, size`.

    `equal`: the target has the content, or gets it by an earlier row. `copy`: the first source row, by path, of
    a new content whose path is free in the target. `skip`: a row before that one whose path is taken.
    `delete`: a live target row of a content that the source only remembers as deleted.
    `occupied(path)` lists paths taken in the target, by default those of its live rows.
    """
    columns = ["action", *ROW, "target", "reason", *CONTENT]
    rows = _kept(source, where)
    plan = None
    if copy_new:
        held = live(target).select(*CONTENT).distinct().withColumn("held", F.lit(True))
        taken = (live(target) if occupied is None else occupied).select("path").distinct()
        wanted = live(rows).select(*ROW, *CONTENT)
        # A path that several repos want belongs to the first of them; it is taken for the others.
        owners = wanted.groupBy("path").agg(F.min("repo").alias("owner"))
        wanted = wanted.join(owners, "path").join(taken.withColumn("taken", F.lit(True)), "path", "left")
        wanted = wanted.withColumn("taken", F.when(F.col("repo") == F.col("owner"), F.col("taken")).otherwise(True))
        wanted = wanted.drop("owner")
        # The first row that can be copied decides for its content; counted per content before joining back.
        free = F.min(F.when(F.col("taken").isNull(), F.struct("path", "repo"))).alias("first")
        contents = wanted.groupBy(*CONTENT).agg(free).join(held, CONTENT, "left")
        joined = skewed_join(wanted, contents, CONTENT, "left", ROW, hot)
        turn = F.struct("path", "repo")
        action = (
            F.when(F.col("held"), "equal")
            .when(F.col("first").isNull() | (turn < F.col("first")), "skip")
            .when(turn == F.col("first"), "copy")
            .otherwise("equal")
        )
        reason = F.when(F.col("held"), "in target").when(F.col("action") == "equal", "copied before")
        reason = reason.when(F.col("action") == "skip", "target exists").otherwise("not in target")
        plan = joined.withColumn("action", action).withColumns({"target": F.col("path"), "reason": reason})
        plan = plan.select(*columns)
    if delete_missing:
        dead = rows.filter("missing").select(*CONTENT).distinct()
        alive = live(source).select(*CONTENT).distinct()
        dead = dead.join(alive, CONTENT, "left_anti")
        gone = skewed_join(live(target), dead, CONTENT, "left_semi", ROW, target_hot)
        gone = gone.withColumns({
            "action": F.lit("delete"), "target": _no_target(), "reason": F.lit("deleted in source")
        }).select(*columns)
        plan = gone if plan is None else plan.unionByName(gone)
    if plan is None:
        plan = rows.limit(0).withColumns({c: F.lit("") for c in ("action", "target", "reason")}).select(*columns)
    return plan


def mirror_plan(source: DataFrame, target: DataFrame, **options) -> DataFrame:
    """Copy what is new and delete what the source has deleted."""
    return sync_plan(source, target, copy_new=True, delete_missing=True, **options)


def sync_counters(plan: DataFrame, results: DataFrame | None = None) -> DataFrame:
    """One row of counters for a plan; with `results(action, status)` of its execution, what really happened."""
    def count(action: str, alias: str) -> Column:
        return F.count_if(F.col("action") == action).alias(alias)

    planned = plan.agg(
        count("equal", "equal"),
        F.count_if(F.col("action").isin("copy", "skip")).alias("new"),
        count("delete", "deleted"),
        count("copy", "copied"),
        count("delete", "removed"),
        count("skip", "skipped"),
        F.lit(0).cast("bigint").alias("errors"),
    )
    if results is None:
        return planned
    done = results.agg(
        F.count_if((F.col("action") == "copy") & (F.col("status") == "done")).alias("copied"),
        F.count_if((F.col("action") == "delete") & (F.col("status") == "done")).alias("removed"),
        F.count_if(F.col("status") == "error").alias("errors"),
    ).first()
    return planned.withColumns({c: F.lit(done[c]).cast("bigint") for c in ("copied", "removed", "errors")})


def sync_records(source: DataFrame, target: DataFrame, done: DataFrame, repo: str | None = None) -> DataFrame:
    """Records to append to the target's log: copied rows live under its name, deleted rows as deletion records.

    `done` holds the results of `files.apply_plan`, of which only rows with status `done` count; a plan, without a
    `status`, is taken as carried out. The name is taken from the target's rows unless `repo` gives it, as it must for
    an empty target.
    """
    if "status" in done.columns:
        done = done.filter("status = 'done'")
    if repo is None:
        first = target.select("repo").first()
        if first is None:
            raise ValueError("name the repo of an empty target")
        repo = first["repo"]
    copied = source.join(done.filter("action = 'copy'").select(*ROW), ROW, "left_semi")
    copied = copied.withColumns({"repo": F.lit(repo), "missing": F.lit(False)})
    deleted = target.join(done.filter("action = 'delete'").select(*ROW), ROW, "left_semi")
    return copied.unionByName(deleted.withColumn("missing", F.lit(True)))


def apply_sync_to_log(
    target_log: DataFrame,
    source: DataFrame,
    target: DataFrame,
    plan: DataFrame,
    seq: int | None = None,
    repo: str | None = None,
) -> DataFrame:
    """The target's log after a sync plan, or after the results of its execution: see `sync_records`."""
    return with_records(target_log, sync_records(source, target, plan, repo), seq)
