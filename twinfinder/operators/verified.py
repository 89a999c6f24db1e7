"""Removing duplicates only while the copy to keep is on disk, as recorded.

A plan becomes claims: each victim with its own recorded content and the copy that is to survive it. Survivors are read
and compared with their records once each; only then are victims read, compared, and removed, after another look at
their survivor. What does not agree with the records is skipped, and says why. A last look confirms the outcome. Every
step is stored, so that none is done again by a later one, and a repeated run finds nothing left to do.
"""

from __future__ import annotations

import hashlib
import os
import shutil
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from twinfinder.functions.hashing import INLINE_LIMIT
from twinfinder.operators.exact import GROUP, ROW
from twinfinder.operators.rank import removal_plan, survivors
from twinfinder.plans.skew import HotKeys, skewed_join
from twinfinder.session import checkpointed

FILES_PER_TASK = 256
PIECE = 1 << 20
CLAIM = ["action", *ROW, "hash", "size", "target", "keep_repo", "keep_path"]
RESULT = "action string, repo string, path string, target string, status string, message string, keep_repo string, keep_path string"


def claims(groups: DataFrame, plan: DataFrame | None = None, hot: HotKeys | None = None) -> DataFrame:
    """What a plan (by default `removal_plan`) claims: its removals and moves with the victim's record and survivor.

    A row in several groups has the survivor of the first of them that keeps another row.
    """
    plan = removal_plan(groups) if plan is None else plan
    chosen = plan.filter(F.col("action").isin("remove", "move")).select("action", *ROW, "target")
    kept = survivors(groups).select(*GROUP, F.col("repo").alias("keep_repo"), F.col("path").alias("keep_path"))
    members = skewed_join(groups.select(*GROUP, *ROW, "hash", "size"), kept, GROUP, "inner", ROW, hot)
    members = members.filter((F.col("repo") != F.col("keep_repo")) | (F.col("path") != F.col("keep_path")))
    # A survivor must not be a victim itself; the plan never removes the first of a group.
    first = F.min_by(F.struct("hash", "size", "keep_repo", "keep_path"), F.struct(*GROUP)).alias("c")
    found = chosen.join(members.groupBy(*ROW).agg(first), ROW)
    return found.select("action", *ROW, "c.hash", "c.size", "target", "c.keep_repo", "c.keep_path")


def _content(path: str) -> tuple[str, int, int]:
    """Content hash, size and modification time of a file that does not change while it is read."""
    digest, head = hashlib.sha1(), b""
    with open(path, "rb") as file:
        before = os.fstat(file.fileno())
        while piece := file.read(PIECE):
            head = head or piece[:INLINE_LIMIT]
            digest.update(piece)
        after = os.fstat(file.fileno())
    if (before.st_size, before.st_mtime_ns) != (after.st_size, after.st_mtime_ns):
        raise OSError("changes while it is read")
    return (head.hex() if before.st_size < INLINE_LIMIT else digest.hexdigest()), before.st_size, before.st_mtime_ns


def _unlike(path: str, digest: str, size: int) -> str | None:
    """Why a file is not the one that was recorded."""
    try:
        if os.path.getsize(path) != size:
            return "has another size"
        return None if _content(path)[0] == digest else "has another content"
    except FileNotFoundError:
        return "is missing"


def _survivors_on_disk(wanted: DataFrame, roots: dict[str, str], partitions: int) -> DataFrame:
    """`keep_repo`, `keep_path`, `keep_time` (its modification time in ns), `problem` of every survivor, read once."""

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for row in batch.itertuples(index=False):
                try:
                    path = os.path.join(roots[row.keep_repo], row.keep_path)
                    digest, size, time = _content(path)
                    problem = None if (digest, size) == (row.hash, row.size) else "has another content"
                    found.append((row.keep_repo, row.keep_path, row.hash, row.size, time, problem))
                except FileNotFoundError:
                    found.append((row.keep_repo, row.keep_path, row.hash, row.size, 0, "is missing"))
                except (OSError, KeyError) as e:
                    found.append((row.keep_repo, row.keep_path, row.hash, row.size, 0, repr(e)))
            yield pd.DataFrame(found, columns=["keep_repo", "keep_path", "hash", "size", "keep_time", "problem"])

    schema = "keep_repo string, keep_path string, hash string, size bigint, keep_time bigint, problem string"
    return wanted.repartition(partitions, "keep_repo", "keep_path").mapInPandas(check, schema)


def _act(row, roots: dict[str, str], target_root: str | None, dry_run: bool) -> tuple[str, str]:
    if isinstance(row.problem, str):
        return "skipped", f"the copy to keep {row.problem}"
    victim, keep = os.path.join(roots[row.repo], row.path), os.path.join(roots[row.keep_repo], row.keep_path)
    target = None
    if row.action == "move":
        target = row.target if target_root is None else os.path.join(target_root, row.target)
    problem = _unlike(victim, row.hash, row.size)
    if problem == "is missing":
        if target is None:
            return "gone", "already removed"
        problem = _unlike(target, row.hash, row.size)
        return ("gone", "already moved") if problem is None else ("skipped", f"the file is missing, its target {problem}")
    if problem:
        return "skipped", f"the file {problem}"
    try:
        stat = os.stat(keep)
    except FileNotFoundError:
        return "skipped", "the copy to keep is missing"
    if (stat.st_size, stat.st_mtime_ns) != (row.size, row.keep_time):
        return "skipped", "the copy to keep has changed"
    if os.path.samefile(victim, keep):
        return "skipped", "the file is the copy to keep"
    if dry_run:
        return "planned", ""
    if target is not None:
        if os.path.exists(target):
            return "skipped", "target exists"
        os.makedirs(os.path.dirname(target), exist_ok=True)
        partial = f"{target}.part-{uuid.uuid4().hex}"
        shutil.copy2(victim, partial)
        try:
            if _unlike(partial, row.hash, row.size):
                return "error", "the copy at the target is not right"
            os.link(partial, target)  # fails if somebody has made it meanwhile
        finally:
            os.remove(partial)
    os.remove(victim)
    return "done", ""


def apply_claims(
    claimed: DataFrame, roots: dict[str, str], dry_run: bool = True, target_root: str | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Carry out claims on storage that all executors mount; one stored result row per claim.

    `done`: removed or moved now; `gone`: was so already; `skipped`: victim or survivor is not what the records say;
    `error`: could not be done, nothing is lost; `planned` while `dry_run` is on; `lost` should never occur: after the
    run the survivor of a removed file is no longer as it was seen. Only `done` and `gone` belong into the log (see
    `results_for_log`). `roots` maps repos to their base paths; relative targets lie below `target_root`.
    """
    spark: SparkSession = claimed.sparkSession
    if not dry_run and spark.conf.get("spark.speculation", "false") == "true":
        raise RuntimeError("turn spark.speculation off before applying claims")
    claimed = checkpointed(claimed.select(*CLAIM))
    partitions = partitions or 1 + claimed.count() // FILES_PER_TASK
    wanted = claimed.select("keep_repo", "keep_path", "hash", "size").distinct()
    seen = checkpointed(_survivors_on_disk(wanted, roots, partitions))
    ready = claimed.join(seen, ["keep_repo", "keep_path", "hash", "size"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            results = []
            for row in batch.itertuples(index=False):
                try:
                    status = _act(row, roots, target_root, dry_run)
                except (OSError, KeyError) as e:
                    status = ("error", repr(e))
                results.append((row.action, row.repo, row.path, row.target, *status, row.keep_repo, row.keep_path))
            yield pd.DataFrame(results, columns=[c.split()[0] for c in RESULT.split(", ")])

    acted = checkpointed(ready.repartition(partitions, *ROW).mapInPandas(run, RESULT))
    if dry_run:
        return acted
    return checkpointed(_confirmed(acted, seen, roots, partitions))


def _confirmed(acted: DataFrame, seen: DataFrame, roots: dict[str, str], partitions: int) -> DataFrame:
    """The results, with status `lost` where a survivor is no longer as it was seen before the removals."""

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            there = []
            for row in batch.itertuples(index=False):
                try:
                    stat = os.stat(os.path.join(roots[row.keep_repo], row.keep_path))
                    there.append((stat.st_size, stat.st_mtime_ns) == (row.size, row.keep_time))
                except (OSError, KeyError):
                    there.append(False)
            yield batch[["keep_repo", "keep_path"]].assign(there=there)

    sound = seen.filter(F.col("problem").isNull()).select("keep_repo", "keep_path", "size", "keep_time").distinct()
    looked = sound.repartition(partitions, "keep_repo", "keep_path").mapInPandas(look, "keep_repo string, keep_path string, there boolean")
    there = looked.groupBy("keep_repo", "keep_path").agg(F.min("there").alias("there"))
    joined = acted.join(there, ["keep_repo", "keep_path"], "left")
    lost = (F.col("status") == "done") & ~F.coalesce("there", F.lit(False))
    names = [c.split()[0] for c in RESULT.split(", ")]
    return joined.withColumn("status", F.when(lost, "lost").otherwise(F.col("status"))).select(*names)


def results_for_log(results: DataFrame) -> DataFrame:
    """Results as `rank.plan_records` takes them: what is no longer there counts as done."""
    status = F.when(F.col("status").isin("done", "gone", "lost"), "done").otherwise(F.col("status"))
    return results.select("action", *ROW, "target", status.alias("status"), "message")
