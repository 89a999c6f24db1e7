"""Listing, copying, moving and removing the files of an index; changes are plans until applied."""

from __future__ import annotations

import os
import shutil
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from twinfinder.functions.text import file_name, format_date, join_path, parent, replace_suffix
from twinfinder.operators.index import live
from twinfinder.plans.skew import HotKeys, skewed_join

ACTIONS_PER_TASK = 1000
RESULT = "action string, repo string, path string, target string, status string, message string"


def _kept(state: DataFrame, where: Column | None) -> DataFrame:
    rows = live(state)
    return rows if where is None else rows.filter(where)


def files_ls(state: DataFrame, where: Column | None = None) -> DataFrame:
    """Live rows in path order with directory, name, size and date; files at the root have an empty directory."""
    return _kept(state, where).orderBy("path").select(
        parent("path").alias("parent"),
        file_name("path").alias("name"),
        "size",
        format_date("last_modified").alias("modified"),
    )


def mime_types(state: DataFrame) -> DataFrame:
    """Distinct content types of live rows, sorted."""
    return live(state).select("mime").distinct().orderBy("mime")


def files_rm_plan(state: DataFrame, where: Column | None = None) -> DataFrame:
    """Delete the selected files, in path order."""
    nothing = F.lit(None).cast("string")
    return _kept(state, where).orderBy("path").select(
        F.lit("delete").alias("action"), "repo", "path", nothing.alias("target"), F.lit("selected").alias("reason")
    )


def files_cp_plan(
    state: DataFrame,
    directory: str,
    suffix: str | None = None,
    where: Column | None = None,
    action: str = "copy",
    hot: HotKeys | None = None,
) -> DataFrame:
    """Copy the selected files below a directory, optionally with another suffix.

    Files that would get the same target are marked `conflict` and not written over each other, except the first.
    """
    rows = _kept(state, where).withColumn("target", join_path(directory, replace_suffix("path", suffix)))
    owner = rows.groupBy("target").agg(F.min(F.struct("repo", "path")).alias("_first"), F.count("*").alias("_n"))
    clash = owner.filter(F.col("_n") > 1).select("target", "_first")
    joined = skewed_join(rows.select("repo", "path", "target"), clash, ["target"], "left", ["repo", "path"], hot)
    first = F.col("_first").isNull() | (F.struct("repo", "path") == F.col("_first"))
    return joined.select(
        F.when(first, action).otherwise("conflict").alias("action"),
        "repo",
        "path",
        "target",
        F.when(first, "selected").otherwise("target used before").alias("reason"),
    )


def files_mv_plan(
    state: DataFrame, directory: str, suffix: str | None = None, where: Column | None = None
) -> DataFrame:
    """As `files_cp_plan`, but moving."""
    return files_cp_plan(state, directory, suffix, where, "move")


def _act(action: str, source: str, target: str | None, overwrite: bool) -> tuple[str, str]:
    """One action, written so that a repeated attempt finds its own work and reports it as done."""
    if action in ("remove", "delete"):
        if os.path.exists(source):
            os.remove(source)
        return "done", ""
    if action not in ("copy", "move"):
        return "skipped", action
    if not os.path.exists(source):
        return ("done", "") if action == "move" and os.path.exists(target) else ("error", "source is missing")
    if os.path.exists(target) and not overwrite:
        a, b = os.stat(source), os.stat(target)
        if action == "copy" and (a.st_size, a.st_mtime_ns) == (b.st_size, b.st_mtime_ns):
            return "done", ""
        return "skipped", "target exists"
    os.makedirs(os.path.dirname(target), exist_ok=True)
    partial = f"{target}.part-{os.getpid()}"
    shutil.copy2(source, partial)
    os.replace(partial, target)
    if action == "move":
        os.remove(source)
    return "done", ""


def apply_plan(
    plan: DataFrame,
    roots: dict[str, str],
    dry_run: bool = True,
    overwrite: bool = False,
    target_root: str | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Carry out a plan on storage that all executors mount; one result row per action.

    `roots` maps repos to their base paths; relative targets lie below `target_root`. Nothing is touched while
    `dry_run` is on. Read the result once and store it: every evaluation performs the plan again, which is
    harmless because finished actions are recognised. Without `partitions` there is a task for every ACTIONS_PER_TASK
    actions, and the plan is counted. Switch speculation off, so that no action runs twice at a time.
    """
    spark = plan.sparkSession
    if not dry_run and spark.conf.get("spark.speculation", "false") == "true":
        raise RuntimeError("turn spark.speculation off before applying a plan")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            results = []
            for row in batch.itertuples(index=False):
                target = row.target if isinstance(row.target, str) else None
                if target is not None and target_root is not None:
                    target = os.path.join(target_root, target)
                try:
                    source = os.path.join(roots[row.repo], row.path)
                    status = ("planned", "") if dry_run else _act(row.action, source, target, overwrite)
                except (OSError, KeyError) as e:
                    status = ("error", repr(e))
                results.append((row.action, row.repo, row.path, target, *status))
            yield pd.DataFrame(results, columns=["action", "repo", "path", "target", "status", "message"])

    partitions = partitions or 1 + plan.count() // ACTIONS_PER_TASK
    spread = plan.select("action", "repo", "path", "target").repartition(partitions, "repo", "path")
    return spread.mapInPandas(run, RESULT)
