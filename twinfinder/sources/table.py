"""Any table with a key and a content column as a repo."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from twinfinder.functions.hashing import content_hash
from twinfinder.schema import FILE_RECORD


def _c(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def from_table(
    df: DataFrame,
    path: Column | str,
    content: Column | str,
    mtime: Column | str,
    repo: Column | str | None = None,
    seq: Column | str | None = None,
    missing: Column | None = None,
    mime: Column | None = None,
    **extra: Column,
) -> DataFrame:
    """Records of a table: hash and size of its content, and whatever media columns are given as `extra`.

    Without `seq` a record is as new as its content: of several with one path the last modified wins.

    One narrow pass over the table. Store or checkpoint the result, so that contents are read only once.
    """
    given = {
        "repo": F.lit("table") if repo is None else _c(repo),
        "seq": _c(mtime if seq is None else seq),
        "hash": content_hash(_c(content)),
        "path": _c(path),
        "size": F.octet_length(_c(content)),
        "last_modified": _c(mtime),
        "missing": F.lit(False) if missing is None else missing,
        "mime": F.lit("") if mime is None else mime,
        **extra,
    }
    return df.select(*[given[f.name].cast(f.dataType).alias(f.name) for f in FILE_RECORD if f.name in given])
