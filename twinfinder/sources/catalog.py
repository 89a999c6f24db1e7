"""Repos as tables of the Spark catalog: base path and layout are table properties."""

from __future__ import annotations

import re
import uuid
import warnings
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession, functions as F

from twinfinder.operators.index import latest, prune
from twinfinder.schema import DEFAULT_BUCKETS, FILE_RECORD, bucket_of, normalise, records

DATABASE = "twinfinder"
# One table holds the current states of all repos, in buckets of their contents.
STATES, STATE_BUCKETS = "current_states", 64
PREFIX = "twinfinder."
CODECS = ("parquet", "json")


def _check_name(name: str) -> None:
    if not name or not all(c == "_" or c.isalpha() or c.isdecimal() for c in name):
        raise ValueError(f"repo names consist of letters, digits and underscore: {name!r}")


def _table(name: str, database: str) -> str:
    """Table of a repo. The catalog folds case and accepts ASCII only, so other names are spelled in hex."""
    plain = re.fullmatch(r"[a-z0-9_]+", name)
    return f"`{database}`.`{'repo_' + name if plain else 'hex_' + name.encode().hex()}`"


def _next_name(name: str) -> str:
    """A name for what is to replace a repo; in the catalog it shows `_next_`, however the repo is called."""
    return f"{'x' if not re.fullmatch('[a-z0-9_]+', name) else name}_next_{uuid.uuid4().hex}"


def _quoted(value: object) -> str:
    text = str(value).replace("\\", "\\\\").replace("'", "\\'")
    return f"'{text}'"


def _set(spark: SparkSession, table: str, **properties: object) -> None:
    pairs = ", ".join(f"'{PREFIX}{k}' = {_quoted(v)}" for k, v in properties.items())
    spark.sql(f"ALTER TABLE {table} SET TBLPROPERTIES ({pairs})")


def _properties(spark: SparkSession, table: str) -> dict[str, str]:
    rows = spark.sql(f"SHOW TBLPROPERTIES {table}").collect()
    return {r["key"][len(PREFIX):]: r["value"] for r in rows if r["key"].startswith(PREFIX)}


def exists(spark: SparkSession, name: str, database: str = DATABASE) -> bool:
    return spark.catalog.tableExists(_table(name, database)) or _finish_exchange(spark, name, database)


def _replacements(spark: SparkSession, database: str) -> dict[str, str]:
    """Tables that are complete and wait to take the place of a repo, by its name."""
    found = {}
    for table in spark.catalog.listTables(database):
        if "_next_" in table.name:
            target = _properties(spark, f"`{database}`.`{table.name}`").get("replaces")
            if target:
                found[target] = f"`{database}`.`{table.name}`"
    return found


def _finish_exchange(spark: SparkSession, name: str, database: str) -> bool:
    """Put a complete replacement in the place of a repo that is gone: a writer failed between the two steps."""
    waiting = _replacements(spark, database).get(name) if spark.catalog.databaseExists(database) else None
    if waiting is not None:
        _take_place(spark, waiting, name, database)
    return waiting is not None


def _take_place(spark: SparkSession, waiting: str, name: str, database: str) -> None:
    spark.sql(f"ALTER TABLE {waiting} RENAME TO {_table(name, database)}")
    _set(spark, _table(name, database), name=name)
    spark.sql(f"ALTER TABLE {_table(name, database)} UNSET TBLPROPERTIES IF EXISTS ('{PREFIX}replaces')")


def _exchange(spark: SparkSession, other: str, name: str, database: str) -> None:
    """Let `other` take the place of `name`. From the first step on it is known what it replaces, so a failure between
    dropping and renaming is mended by whoever opens the repo next."""
    _set(spark, _table(other, database), replaces=name)
    spark.sql(f"DROP TABLE {_table(name, database)}")
    _finish_exchange(spark, name, database)


def _require(spark: SparkSession, name: str, database: str) -> str:
    if not exists(spark, name, database):
        raise LookupError(f"no repo {name!r}")
    return _table(name, database)


def create_repo(
    spark: SparkSession,
    name: str,
    path: str,
    buckets: int = DEFAULT_BUCKETS,
    codec: str = "parquet",
    compressed: bool = False,
    database: str = DATABASE,
) -> None:
    """Register a repo with an empty log; fails for bad or used names."""
    _check_name(name)
    if codec not in CODECS:
        raise ValueError(f"unknown codec {codec!r}")
    if exists(spark, name, database):
        raise ValueError(f"repo {name!r} exists")
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in FILE_RECORD)
    table = _table(name, database)
    compression = ("zstd" if codec == "parquet" else "gzip") if compressed else "none"
    spark.sql(
        f"CREATE TABLE {table} ({columns}, bucket bigint) USING {codec} "
        f"OPTIONS (compression = '{compression}') PARTITIONED BY (bucket)"
    )
    _set(spark, table, name=name, path=path, buckets=buckets, codec=codec, compressed=str(compressed).lower())


def list_repos(spark: SparkSession, verbose: bool = False, database: str = DATABASE) -> DataFrame:
    """Registered repos by name; `verbose` adds layout. Tables that are no repos, or cannot be read, are left out."""
    rows = []
    if spark.catalog.databaseExists(database):
        for name in _replacements(spark, database):
            exists(spark, name, database)
        for table in spark.catalog.listTables(database):
            try:
                found = _properties(spark, f"`{database}`.`{table.name}`")
                spark.table(f"`{database}`.`{table.name}`")
            except (AnalysisException, Py4JJavaError, ParseException) as error:
                warnings.warn(f"{table.name} cannot be read: {error}", stacklevel=2)
                continue
            if {"name", "path", "buckets"} <= set(found) and "_next_" not in table.name:
                rows.append((
                    found["name"], found["path"], int(found["buckets"]), found.get("codec", "json"),
                    found.get("compressed") == "true",
                ))
    repos = spark.createDataFrame(rows, "name string, path string, buckets int, codec string, compressed boolean")
    return repos.orderBy("name") if verbose else repos.select("name", "path").orderBy("name")


def drop_repo(spark: SparkSession, name: str, database: str = DATABASE) -> bool:
    """Forget a repo, its log and stored state, not the files it describes. False if there was none."""
    found = exists(spark, name, database)
    spark.sql(f"DROP TABLE IF EXISTS {_table(name, database)}")
    if spark.catalog.tableExists(f"`{database}`.`{STATES}`"):
        spark.sql(f"ALTER TABLE `{database}`.`{STATES}` DROP IF EXISTS PARTITION (repo = {_quoted(name)})")
    return found


def append_records(spark: SparkSession, name: str, df: DataFrame, database: str = DATABASE) -> None:
    """Append records to a repo's log."""
    table = _require(spark, name, database)
    buckets = int(_properties(spark, table)["buckets"])
    rows = records(df).withColumn("repo", F.lit(name)).withColumn("bucket", bucket_of("size", buckets))
    rows.write.mode("append").insertInto(table)


def read_repo(spark: SparkSession, name: str, database: str = DATABASE) -> DataFrame:
    """The log of a repo under its current name."""
    table = _require(spark, name, database)
    return normalise(spark.table(table).drop("bucket").withColumn("repo", F.lit(name)))


def repo_path(spark: SparkSession, name: str, database: str = DATABASE) -> str:
    return _properties(spark, _require(spark, name, database))["path"]


def copy_repo(spark: SparkSession, source: str, target: str, path: str, database: str = DATABASE) -> None:
    """Clone the log of a repo under a new name and base path."""
    if source == target:
        raise ValueError("source and target are the same repo")
    table = _require(spark, source, database)
    found = _properties(spark, table)
    create_repo(
        spark, target, path, int(found["buckets"]), found["codec"], found["compressed"] == "true", database
    )
    append_records(spark, target, spark.table(table).drop("bucket"), database)


def rename_repo(spark: SparkSession, source: str, target: str, database: str = DATABASE) -> bool:
    """False when nothing can be renamed: same name, no such repo, or the new name is used."""
    if source == target or not exists(spark, source, database) or exists(spark, target, database):
        return False
    _check_name(target)
    spark.sql(f"ALTER TABLE {_table(source, database)} RENAME TO {_table(target, database)}")
    _set(spark, _table(target, database), name=target)
    return True


def relocate_repo(spark: SparkSession, name: str, path: str, database: str = DATABASE) -> None:
    """Change the base path; records are relative to it and stay."""
    _set(spark, _require(spark, name, database), path=path)


def configure_repo(
    spark: SparkSession, name: str, codec: str | None = None, compressed: bool | None = None, database: str = DATABASE
) -> None:
    """Change the storage of a repo by rewriting its log into a table of the other kind; the rest is kept."""
    table = _require(spark, name, database)
    found = _properties(spark, table)
    new_codec = codec or found["codec"]
    new_compressed = (found["compressed"] == "true") if compressed is None else compressed
    if (new_codec, new_compressed) == (found["codec"], found["compressed"] == "true"):
        return
    other = _next_name(name)
    create_repo(spark, other, found["path"], int(found["buckets"]), new_codec, new_compressed, database)
    append_records(spark, other, spark.table(table).drop("bucket"), database)
    _exchange(spark, other, name, database)


def open_repos(
    spark: SparkSession,
    names: list[str] | None = None,
    skip_unknown: bool = False,
    database: str = DATABASE,
) -> DataFrame:
    """The logs of some repos, or of all, as one; `repo` tells them apart.

    Unknown names are an error for updates and are skipped where `skip_unknown` is set, as for duplicates and pruning.
    """
    if names is None:
        names = [r["name"] for r in list_repos(spark, database=database).collect()]
    if skip_unknown:
        names = [n for n in names if exists(spark, n, database)]
    if not names:
        raise LookupError("no repos selected")
    return reduce(DataFrame.unionByName, [read_repo(spark, n, database) for n in names])


def prune_repo(
    spark: SparkSession, name: str, buckets: int | None = None, keep_deleted: bool = False, database: str = DATABASE
) -> int:
    """Rewrite a repo's log to its last state, optionally with another number of buckets; the records kept."""
    table = _require(spark, name, database)
    found = _properties(spark, table)
    n = int(found["buckets"]) if buckets is None else buckets
    other = _next_name(name)
    create_repo(spark, other, found["path"], n, found["codec"], found["compressed"] == "true", database)
    append_records(spark, other, prune(read_repo(spark, name, database), n, keep_deleted).drop("bucket"), database)
    _exchange(spark, other, name, database)
    return spark.table(table).count()


def _log_size(spark: SparkSession, name: str, database: str) -> int:
    return spark.table(_table(name, database)).count()


def store_states(
    spark: SparkSession, names: list[str], buckets: int = STATE_BUCKETS, database: str = DATABASE
) -> None:
    """Compact the logs of repos into the table of current states, each replacing what it holds of that repo.

    The table is partitioned by repo, and bucketed and sorted by (hash, size): contents are shuffled here once, and
    grouping them (`exact.stored_groups`) or comparing repos (`operators.diff`) needs no exchange any more. `buckets`
    counts when the table is made; it should make files of a few hundred MB.
    """
    for name in names:
        _require(spark, name, database)
    table = f"`{database}`.`{STATES}`"
    if not spark.catalog.tableExists(table):
        columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in FILE_RECORD if f.name != "repo")
        spark.sql(
            f"CREATE TABLE {table} ({columns}, repo string) USING parquet PARTITIONED BY (repo) "
            f"CLUSTERED BY (hash, size) SORTED BY (hash, size) INTO {buckets} BUCKETS"
        )
        _set(spark, table, state_buckets=buckets)
    buckets = int(_properties(spark, table)["state_buckets"])
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        for name in names:
            size = _log_size(spark, name, database)
            state = latest(read_repo(spark, name, database))
            state = state.select(*[f.name for f in FILE_RECORD if f.name != "repo"], F.lit(name).alias("repo"))
            if state.isEmpty():
                spark.sql(f"ALTER TABLE {table} DROP IF EXISTS PARTITION (repo = {_quoted(name)})")
            else:
                state.repartition(buckets, "hash", "size").write.mode("overwrite").insertInto(table)
            _set(spark, _table(name, database), state_of=size)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)


def read_states(spark: SparkSession, names: list[str], database: str = DATABASE) -> DataFrame:
    """The stored states of repos, refreshed where the log has grown or shrunk since; `repo` tells them apart."""
    stale = [
        n for n in names
        if _properties(spark, _require(spark, n, database)).get("state_of") != str(_log_size(spark, n, database))
    ]
    if stale:
        store_states(spark, stale, database=database)
    return spark.table(f"`{database}`.`{STATES}`").filter(F.col("repo").isin(names)).select(*[f.name for f in FILE_RECORD])
