"""The stored log: JSON lines to import, partitioned Parquet to keep.

A Parquet log is a folder of parts, and a state that lists them (see `versions`). Appending adds a part, pruning and
repairing replace parts; each becomes visible at once, and nothing that others append meanwhile is lost.
"""

from __future__ import annotations

import uuid
import warnings

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from twinfinder.operators.index import prune
from twinfinder.schema import DEFAULT_BUCKETS, FILE_RECORD, JSON_KEYS, JSON_RECORD, bucket_of, normalise, records
from twinfinder.plans.numbering import numbered
from twinfinder.plans.skew import skewed_join
from twinfinder.session import checkpointed
from twinfinder.sources.versions import PARTS, Versions

CORRUPT = "_corrupt"


def read_json_log(spark: SparkSession, path: str | list[str], repo: str) -> DataFrame:
    """All lines of a JSON-lines log as records plus `shard` (their file) and `_corrupt`, gzip by file suffix.

    The order of lines in a file is kept as `seq`: rows of one split are read in order, and splits are put in
    order by their position. Undecodable lines keep their text in `_corrupt`. Compact with
    `latest(log, shard="shard")` when the log has several files.
    """
    schema = T.StructType([*JSON_RECORD, T.StructField(CORRUPT, T.StringType())])
    raw = (
        spark.read.schema(schema)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .json(path)
    )
    lines = checkpointed(
        raw.select(
            *[F.col(key).alias(column) for key, column in JSON_KEYS.items()],
            CORRUPT,
            F.col("_metadata.file_path").alias("shard"),
            F.col("_metadata.file_block_start").alias("_start"),
            F.monotonically_increasing_id().alias("_line"),
        )
    )
    # One row per split: its first line number, and how many lines of the file come before it.
    splits = lines.groupBy("shard", "_start").agg(F.count("*").alias("_n"), F.min("_line").alias("_first"))
    before = Window.partitionBy("shard").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select(
        "shard", "_start", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift")
    )
    placed = lines.join(offsets, ["shard", "_start"]).withColumn("seq", F.col("_line") + F.col("_shift"))
    return placed.select(F.lit(repo).alias("repo"), *[f.name for f in FILE_RECORD][1:], "shard", CORRUPT)


def quarantine(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, bad): decodable records with defaults applied, and the lines to keep aside.

    A line is bad when it does not parse or has no hash.
    """
    bad = F.col(CORRUPT).isNotNull() | F.col("hash").isNull()
    return normalise(lines.filter(~bad).drop(CORRUPT)), lines.filter(bad)


def _compact(column: str, kind: T.DataType) -> Column:
    c = F.col(column)
    if column == "hash":  # the empty hash is that of an empty file
        return c
    if isinstance(kind, T.StringType):
        return F.when(c != "", c)
    if isinstance(kind, T.BooleanType):
        return F.when(c, c)
    if isinstance(kind, T.MapType):
        return F.when(F.size(c) > 0, c)
    return c


def write_json_log(df: DataFrame, path: str, compress: bool = False) -> None:
    """Write records as JSON lines with the short keys, empty values left out."""
    rows = df.select(*[_compact(column, JSON_RECORD[key].dataType).alias(key) for key, column in JSON_KEYS.items()])
    rows.write.option("ignoreNullFields", "true").option("compression", "gzip" if compress else "none").json(path)


def _write_part(versions: Versions, rows: DataFrame, name: str) -> None:
    rows.write.partitionBy("bucket").parquet(versions.part_path(name))


def append_log(
    df: DataFrame, path: str, buckets: int = DEFAULT_BUCKETS, order: list[Column] | None = None
) -> dict[str, int]:
    """Append records to a Parquet log, partitioned by bucket; how many, and the highest `seq` of the log.

    With `order` the log numbers the records itself, in that order, behind all it holds. A part keeps numbers from 0,
    and its state says where they start, so writers that append at the same time get numbers of their own without
    writing anything again, and nobody scans the log for its highest number.
    """
    versions = Versions(df.sparkSession, path)
    rows = df if order is None else numbered(df.drop("seq"), order, "seq")
    name = uuid.uuid4().hex
    _write_part(versions, records(rows).withColumn("bucket", bucket_of("size", buckets)), name)
    found = {"n": 0, "last": None}
    if not _empty(versions, name):
        found = versions.spark.read.parquet(versions.part_path(name)).agg(F.count("*").alias("n"), F.max("seq").alias("last")).first()

    def add(state: dict) -> dict:
        last = state.get("last_seq", _last_seq(versions) if not state else 0)
        base = 0 if order is None else last + 1
        last = max(last, base + (found["last"] or 0)) if found["n"] else last
        parts = [*_parts(versions, state), {"name": name, "base": base, "rows": found["n"]}]
        return {**state, "parts": parts, "last_seq": last}

    return {"rows": found["n"], "last_seq": versions.change(add)["last_seq"]}


def _loose(versions: Versions) -> bool:
    """Whether the folder holds a log without states: bucket folders, as other tools write them."""
    path = versions._path(f"{versions.folder}/bucket=*")
    return bool(len(versions._fs.globStatus(path) or []))


def _last_seq(versions: Versions) -> int:
    if not _loose(versions):
        return 0
    return versions.spark.read.parquet(f"{versions.folder}/bucket=*").agg(F.max("seq")).first()[0] or 0


def _parts(versions: Versions, state: dict) -> list[dict]:
    """The parts of a state; before the first, what lies in the folder is one part without a name."""
    return state["parts"] if state else [{"name": None, "base": 0}] if _loose(versions) else []


def _read_parts(versions: Versions, parts: list[dict]) -> DataFrame:
    spark = versions.spark
    named = [p for p in parts if p["name"] is not None]
    frames = []
    if len(named) < len(parts):
        frames.append(spark.read.option("basePath", versions.folder).parquet(f"{versions.folder}/bucket=*"))
    if any(p.get("rows") != 0 for p in named):
        reader = spark.read.option("basePath", f"{versions.folder}/{PARTS}")
        rows = reader.schema(T.StructType([*FILE_RECORD, T.StructField("part", T.StringType()), T.StructField("bucket", T.IntegerType())]))
        rows = rows.parquet(*[versions.part_path(p["name"]) for p in named if p.get("rows") != 0])
        bases = {p["name"]: p["base"] for p in named if p["base"]}
        if bases:
            known = F.create_map(*[F.lit(x) for pair in bases.items() for x in pair])
            rows = rows.withColumn("seq", F.col("seq") + F.coalesce(F.try_element_at(known, F.col("part")), F.lit(0)))
        frames.append(rows.drop("part"))
    if not frames:
        return spark.createDataFrame([], T.StructType([*FILE_RECORD, T.StructField("bucket", T.IntegerType())]))
    return frames[0] if len(frames) == 1 else frames[0].unionByName(frames[1], allowMissingColumns=True)


def read_log(spark: SparkSession, path: str, codec: str = "parquet", repo: str = "table") -> DataFrame:
    """Records of a stored log with defaults applied.

    Corrupt JSON lines are left out with a warning that counts them; `repair_log` keeps them. Bad lines of a repaired
    log are in `bad_lines`.
    """
    if codec == "json":
        good, bad = quarantine(read_json_log(spark, path, repo))
        left_out = bad.count()
        if left_out:
            warnings.warn(f"{left_out} undecodable lines of {path} were left out", stacklevel=2)
        return good
    if codec == "parquet":
        versions = Versions(spark, path)
        return normalise(_read_parts(versions, _parts(versions, versions.current()[1])))
    raise ValueError(f"unknown codec {codec}")


def repair_log(
    spark: SparkSession, source: str | list[str], path: str, repo: str, buckets: int = DEFAULT_BUCKETS
) -> dict[str, int]:
    """Take a JSON-lines log into the Parquet log at `path`: decodable lines as records, all others kept beside them.

    Both are written before one state makes them part of the log, so a failure at any time leaves the log as it was;
    the source is only read. `good` and `bad` count the lines; together they are all lines of the source. Records keep
    their order, behind what the log holds. A path that occurs in several files is settled as by `latest(…, "shard")`.
    """
    versions = Versions(spark, path)
    good, bad = quarantine(read_json_log(spark, source, repo))
    name = uuid.uuid4().hex
    # All records of a path in a file go by the time of its last one there, files in that order.
    entry = ["repo", "path", "shard"]
    last = good.groupBy(*entry).agg(F.max_by("last_modified", "seq").alias("_at"))
    placed = skewed_join(good, last, entry, "inner", ["seq"])
    order = [F.col(c).asc() for c in ("_at", "shard", "seq")]
    rows = numbered(placed, order, "_number").withColumn("seq", F.col("_number"))
    rows = rows.select(*[f.name for f in FILE_RECORD]).withColumn("bucket", bucket_of("size", buckets))
    _write_part(versions, rows, name)
    kept = bad.select("repo", "shard", F.col("seq").alias("line"), F.col(CORRUPT).alias("text"), "path")
    kept.write.parquet(f"{versions.folder}/_bad/part={name}")
    read = spark.read
    counts = {
        "good": 0 if _empty(versions, name) else read.parquet(versions.part_path(name)).count(),
        "bad": read.schema(kept.schema).parquet(f"{versions.folder}/_bad/part={name}").count(),
    }

    def add(state: dict) -> dict:
        before = state.get("last_seq", _last_seq(versions) if not state else 0)
        part = {"name": name, "base": before + 1, "rows": counts["good"], "bad": counts["bad"]}
        bad_parts = [*state.get("bad_parts", []), *([name] if counts["bad"] else [])]
        return {**state, "parts": [*_parts(versions, state), part], "bad_parts": bad_parts, "last_seq": before + counts["good"]}

    versions.change(add)
    return counts


def bad_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines that repairs kept aside: `repo`, `shard` (their file), `line` (its place), `text`, `path`.

    `text` is null for a line that can be read but has no hash.
    """
    versions = Versions(spark, path)
    schema = "repo string, shard string, line bigint, text string, path string"
    names = versions.current()[1].get("bad_parts", [])
    if not names:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{versions.folder}/_bad/part={n}" for n in names])


def prune_log(
    spark: SparkSession, path: str, buckets: int = DEFAULT_BUCKETS, keep_deleted: bool = False
) -> dict[str, int]:
    """Rewrite a Parquet log to its last state.

    The new part replaces those it was made from by one state; parts appended meanwhile stay. Records win by `seq`,
    which pruned ones keep, so the order to later parts is kept as well. Old files are left to `clean_log`.
    """
    versions = Versions(spark, path)
    old = _parts(versions, versions.current()[1])
    name = uuid.uuid4().hex
    kept = prune(normalise(_read_parts(versions, old)).drop("bucket"), buckets, keep_deleted)
    _write_part(versions, kept, name)
    files = 0 if _empty(versions, name) else spark.read.parquet(versions.part_path(name)).count()
    replaced = {p["name"] for p in old}

    def exchange(state: dict) -> dict:
        stay = [p for p in _parts(versions, state) if p["name"] not in replaced]
        last = state.get("last_seq", _last_seq(versions) if not state else 0)
        return {**state, "parts": [{"name": name, "base": 0, "rows": files}, *stay], "last_seq": last}

    versions.change(exchange)
    return {"files": files, "failed": 0}


def _empty(versions: Versions, name: str) -> bool:
    found = versions._fs.globStatus(versions._path(f"{versions.part_path(name)}/bucket=*"))
    return found is None or len(found) == 0


def clean_log(spark: SparkSession, path: str) -> list[str]:
    """Delete the parts that the current state does not name; call it when no other job reads or writes the log."""
    versions = Versions(spark, path)
    number, state = versions.current()
    if not number:
        return []
    held = {p["name"] for p in state["parts"]}
    folder = versions._path(f"{versions.folder}/{PARTS}")
    found = {s.getPath().getName()[len("part="):]: s.getPath() for s in versions._fs.listStatus(folder)} if versions._fs.exists(folder) else {}
    gone = sorted(set(found) - held)
    for name in gone:
        versions._fs.delete(found[name], True)
    if None not in held:
        for status in versions._fs.globStatus(versions._path(f"{versions.folder}/bucket=*")) or []:
            versions._fs.delete(status.getPath(), True)
    return gone
