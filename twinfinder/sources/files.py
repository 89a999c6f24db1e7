"""Files on shared storage as listings and contents."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import reduce
from itertools import islice
from typing import BinaryIO
from urllib.parse import urlparse

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from twinfinder.functions.hashing import CHUNK_BYTES, FALLBACK_PREFIX, FALLBACK_SKIP, ID3_HEADER, INLINE_LIMIT
from twinfinder.functions.media import detect_mime
from twinfinder.session import checkpointed

HEAD_BYTES = 64
FILES_PER_TASK = 1000
DIRECTORIES_PER_TASK = 100
ENTRIES_TOGETHER = 10_000
_HASHED = (
    "path string, size bigint, last_modified bigint, hash string, head binary, fallback_hash string, "
    "audio_hash string, message string"
)
_ENTRY = "kind string, path string, size bigint, last_modified bigint, message string"


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """Listing through Spark's file source, on any storage: path below the root, size, epoch milliseconds.

    Contents are never read. Names that start with "_" or "." are hidden by the source and links are followed;
    use `scan_files` where that matters.
    """
    base = (urlparse(root).path if "://" in root else os.path.abspath(root)).rstrip("/") + "/"
    start = F.locate(base, F.col("path")) + len(base)
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return reader.load(root).select(
        F.substring("path", start, F.length("path")).alias("path"),
        F.col("length").alias("size"),
        F.unix_millis("modificationTime").alias("last_modified"),
    )


def _read_at(file: BinaryIO, position: int) -> bytes:
    file.seek(position)
    return file.read(CHUNK_BYTES)


def _hashes(path: str) -> tuple[str, bytes, str | None, str | None]:
    """Content hash, first bytes, fallback hash and audio hash of a file of any size, read in pieces."""
    digest, size = hashlib.sha1(), 0
    with open(path, "rb") as file:
        head = file.read(HEAD_BYTES)
        file.seek(0)
        while piece := file.read(1 << 20):
            digest.update(piece)
            size += len(piece)
        tag = 0
        if len(head) >= ID3_HEADER and head.startswith(b"ID3"):
            tag = sum((b & 0x7F) << shift for b, shift in zip(head[6:10], (21, 14, 7, 0)))
        late, sound = _read_at(file, FALLBACK_SKIP), _read_at(file, ID3_HEADER + tag)
    return (
        head[:size].hex() if size < INLINE_LIMIT else digest.hexdigest(),
        head,
        FALLBACK_PREFIX + hashlib.sha256(late).hexdigest() if late else None,
        hashlib.sha256(sound).hexdigest() if sound else None,
    )


def hash_files(root: str, wanted: DataFrame, partitions: int | None = None) -> DataFrame:
    """Hash the `wanted(path, size, last_modified)` files below a mounted directory, and no others.

    Adds `hash`, `mime`, `fallback_hash`, `audio_hash` and `message` (why a file could not be read). Files are
    streamed inside the tasks, so their size is no limit and no contents are shuffled. `update.enrich` picks what
    applies to each type. Without `partitions` there is a task for every FILES_PER_TASK files, and `wanted` is counted.
    """
    base = os.path.abspath(root)
    partitions = partitions or 1 + wanted.count() // FILES_PER_TASK

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            results = []
            for path in batch["path"]:
                try:
                    results.append((*_hashes(os.path.join(base, path)), None))
                except OSError as e:
                    results.append((None, None, None, None, repr(e)))
            found = pd.DataFrame(results, columns=["hash", "head", "fallback_hash", "audio_hash", "message"])
            yield pd.concat([batch.reset_index(drop=True), found], axis=1)

    spread = wanted.select("path", "size", "last_modified").repartition(partitions, "path")
    hashed = spread.mapInPandas(read, _HASHED)
    return hashed.withColumn("mime", detect_mime("head", "path")).drop("head")


def scan_files(spark: SparkSession, root: str, partitions: int | None = None) -> DataFrame:
    """Everything below a mounted directory as `kind, path, size, last_modified, message`.

    `file` rows are regular files; links to files and directories are skipped. `failed` rows are directories that
    could not be listed, and entries that could not be examined or whose names are no text (shown with "?"); the rest of
    the tree is still read. `dir` rows are the directories seen. The tree is walked level by level, each level spread
    over the executors, and entries leave a task in portions, however many one directory has. Without `partitions` there
    is a task for every DIRECTORIES_PER_TASK directories.
    """
    base = os.path.abspath(root)
    if not os.path.isdir(base):
        raise FileNotFoundError(base)

    def entry_row(directory: str, entry: os.DirEntry) -> tuple | None:
        name = os.path.join(directory, entry.name)
        try:
            name.encode()
            if entry.is_symlink():
                return None
            if entry.is_dir():
                return "dir", name, None, None, None
            if entry.is_file():
                stat = entry.stat()
                return "file", name, stat.st_size, stat.st_mtime_ns // 1_000_000, None
            return None
        except (OSError, UnicodeEncodeError) as e:
            return "failed", name.encode(errors="replace").decode(), None, None, type(e).__name__

    def entries_of(directory: str) -> Iterator[tuple]:
        try:
            with os.scandir(os.path.join(base, directory)) as entries:
                yield from filter(None, (entry_row(directory, e) for e in entries))
        except OSError as e:
            yield "failed", directory, None, None, repr(e)

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (row for batch in batches for directory in batch["path"] for row in entries_of(directory))
        while portion := list(islice(rows, ENTRIES_TOGETHER)):
            frame = pd.DataFrame(portion, columns=["kind", "path", "size", "last_modified", "message"])
            yield frame.astype({"size": "Int64", "last_modified": "Int64"})

    levels = [spark.createDataFrame([("dir", "")], "kind string, path string")]
    found = []
    while True:
        directories = levels[-1].filter("kind = 'dir'").select("path")
        tasks = partitions or 1 + directories.count() // DIRECTORIES_PER_TASK
        level = checkpointed(directories.repartition(tasks, "path").mapInPandas(expand, _ENTRY))
        if level.isEmpty():
            break
        found.append(level)
        levels.append(level)
    if not found:
        return spark.createDataFrame([], _ENTRY)
    return reduce(DataFrame.unionByName, found)
