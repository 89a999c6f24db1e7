"""Scans and growing logs as Spark formats: `spark.read.format("twinscan")` and `spark.readStream.format("twinlog")`.

Call `register(spark)` once per session. Both read folders that driver and executors mount. The scan plans its tasks
from the directories near the root, and can take filters on `path` and `kind` so that whole directories are passed over. The
log remembers how far it has read every file, by bytes, so that a stream goes on where it ended, in the middle of files
that have grown.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession, types as T
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, InputPartition, StringStartsWith,
)

from twinfinder.schema import FILE_RECORD, JSON_KEYS

SCAN, LOG = "twinscan", "twinlog"
SCAN_SCHEMA = "kind string, path string, size bigint, last_modified bigint, message string"
LOG_SCHEMA = T.StructType([
    *[T.StructField(c, FILE_RECORD[c].dataType) for c in JSON_KEYS.values()],
    T.StructField("shard", T.StringType()), T.StructField("position", T.LongType()), T.StructField("corrupt", T.StringType()),
])


def register(spark: SparkSession) -> None:
    """Make both formats known to the session, and let it hand filters to them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FileScan)
    spark.dataSource.register(GrowingLog)


# --- scan --------------------------------------------------------------------------------------------------------


@dataclass
class Directories(InputPartition):
    """Directories to list; those of `deep` with all below them."""

    flat: list[str]
    deep: list[str]


class FileScan(DataSource):
    """Everything below `path`, as `files.scan_files` gives it.

    Options: `tasks`, how many tasks to plan for (64); `push`, whether filters pass over directories (false). Spark keeps
    what is pushed for the whole frame that `load` gave, wherever a query uses it: with `push` load a frame of its own for
    every filter.
    """

    @classmethod
    def name(cls) -> str:
        return SCAN

    def schema(self) -> str:
        return SCAN_SCHEMA

    def reader(self, schema: T.StructType) -> ScanReader:
        push = str(self.options.get("push", "false")).lower() == "true"
        return ScanReader(os.path.abspath(self.options["path"]), int(self.options.get("tasks", 64)), push)


class ScanReader(DataSourceReader):
    def __init__(self, root: str, tasks: int, push: bool):
        if not os.path.isdir(root):
            raise FileNotFoundError(root)
        self.root, self.tasks, self.push = root, tasks, push
        self.prefix, self.kind = "", None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes `kind = …`, `path = …` and paths with a beginning; the rest is left to Spark."""
        for one in filters:
            if not self.push:
                yield one
            elif isinstance(one, EqualTo) and one.attribute == ("kind",) and self.kind is None:
                self.kind = one.value
            elif isinstance(one, StringStartsWith) and one.attribute == ("path",) and not self.prefix:
                self.prefix = one.value
            else:
                if isinstance(one, EqualTo) and one.attribute == ("path",) and not self.prefix and isinstance(one.value, str):
                    self.prefix = one.value  # Spark still compares whole paths
                yield one

    def _may_hold(self, directory: str) -> bool:
        """Whether paths below a directory can begin as asked for."""
        inside = f"{directory}/" if directory else ""
        return inside.startswith(self.prefix) or self.prefix.startswith(inside)

    def partitions(self) -> list[InputPartition]:
        """Directories near the root, a level deeper while there are too few of them for the tasks."""
        passed, level = [], [""]
        while level and len(level) < self.tasks:
            below = []
            for directory in level:
                below += [e[1] for e in self._entries(directory) if e[0] == "dir" and self._may_hold(e[1])]
            passed += level
            if not below:
                level = []
                break
            level = below
        step = max(1, -(-len(level) // self.tasks))
        parts = [Directories([], level[i : i + step]) for i in range(0, len(level), step)]
        step = max(1, -(-len(passed) // self.tasks))
        return parts + [Directories(passed[i : i + step], []) for i in range(0, len(passed), step)]

    def _entries(self, directory: str) -> Iterator[tuple]:
        try:
            with os.scandir(os.path.join(self.root, directory)) as entries:
                for entry in entries:
                    name = os.path.join(directory, entry.name)
                    try:
                        name.encode()
                        if entry.is_symlink():
                            continue
                        if entry.is_dir():
                            yield "dir", name, None, None, None
                        elif entry.is_file():
                            stat = entry.stat()
                            yield "file", name, stat.st_size, stat.st_mtime_ns // 1_000_000, None
                    except (OSError, UnicodeEncodeError) as e:
                        yield "failed", name.encode(errors="replace").decode(), None, None, type(e).__name__
        except OSError as e:
            yield "failed", directory, None, None, repr(e)

    def read(self, partition: Directories) -> Iterator[tuple]:
        waiting = [(d, False) for d in partition.flat] + [(d, True) for d in partition.deep]
        while waiting:
            directory, deep = waiting.pop()
            for row in self._entries(directory):
                if deep and row[0] == "dir" and self._may_hold(row[1]):
                    waiting.append((row[1], True))
                if (self.kind is None or row[0] == self.kind) and row[1].startswith(self.prefix):
                    yield row


# --- log ---------------------------------------------------------------------------------------------------------


@dataclass
class Span(InputPartition):
    """Bytes of a log file; a line belongs to the span that holds its first byte."""

    shard: str
    start: int
    end: int


class GrowingLog(DataSource):
    """JSON lines of the files `*.json` below `path`, in the short keys of the log.

    `shard` is the file and `position` the byte at which the line begins, so (shard, position) is the order of the log. Of
    a line that does not parse all columns but these and `corrupt`, which holds it, are null. What comes after the last
    line break of a file waits for its end. Files may grow and come, but not shrink. Option `span`: bytes a task.
    """

    @classmethod
    def name(cls) -> str:
        return LOG

    def schema(self) -> T.StructType:
        return LOG_SCHEMA

    def reader(self, schema: T.StructType) -> LogReader:
        return LogReader(self.options["path"], int(self.options.get("span", 64 << 20)))

    def streamReader(self, schema: T.StructType) -> LogStream:
        return LogStream(self.options["path"], int(self.options.get("span", 64 << 20)))


class _Lines:
    def __init__(self, root: str, span: int):
        self.root, self.span = os.path.abspath(root), span

    def complete(self) -> dict[str, int]:
        """For every file, where its last complete line ends."""
        found = {}
        for directory, _, names in os.walk(self.root):
            for name in names:
                if name.endswith(".json") and not name.startswith((".", "_")):
                    path = os.path.join(directory, name)
                    found[os.path.relpath(path, self.root)] = _last_break(path)
        return found

    def spans(self, start: dict[str, int], end: dict[str, int]) -> list[InputPartition]:
        spans = []
        for shard, stop in sorted(end.items()):
            first = start.get(shard, 0)
            if stop < first:
                raise ValueError(f"{shard} has become shorter")
            spans += [Span(shard, a, min(a + self.span, stop)) for a in range(first, stop, self.span)]
        return spans

    def read(self, partition: Span) -> Iterator[tuple]:
        with open(os.path.join(self.root, partition.shard), "rb") as file:
            position = partition.start
            if position:  # a line that began before belongs to the span before
                file.seek(position - 1)
                position += len(file.readline()) - 1
            while position < partition.end:
                line = file.readline()
                if line.strip():
                    record, corrupt = _columns(line)
                    yield (*record, partition.shard, position, corrupt)
                position += len(line)


def _last_break(path: str) -> int:
    """The byte behind the last line break of a file."""
    with open(path, "rb") as file:
        end = file.seek(0, os.SEEK_END)
        while end > 0:
            start = max(0, end - 65_536)
            file.seek(start)
            at = file.read(end - start).rfind(b"\n")
            if at >= 0:
                return start + at + 1
            end = start
    return 0


def _typed(value: object, kind: T.DataType) -> object:
    """A JSON value as the column holds it; what does not fit makes the line a bad one."""
    if value is None:
        return None
    if isinstance(kind, T.StringType) and isinstance(value, str):
        return value
    if isinstance(kind, T.BooleanType) and isinstance(value, bool):
        return value
    if isinstance(kind, (T.LongType, T.IntegerType)) and isinstance(value, int) and not isinstance(value, bool):
        if abs(value) < 1 << (63 if isinstance(kind, T.LongType) else 31):
            return value
    if isinstance(kind, T.StructType) and isinstance(value, dict):
        return tuple(_typed(value.get(f.name), f.dataType) for f in kind)
    if isinstance(kind, T.MapType) and isinstance(value, dict):
        return {k: _typed(v, kind.valueType) for k, v in value.items()}
    raise ValueError(f"{value!r} is no {kind.simpleString()}")


_KINDS = {key: FILE_RECORD[column].dataType for key, column in JSON_KEYS.items()}


def _columns(line: bytes) -> tuple[tuple, str | None]:
    """The columns of a record and null, or nulls and the line."""
    try:
        found = json.loads(line)
        if not isinstance(found, dict):
            raise ValueError("no record")
        return tuple(_typed(found.get(key), kind) for key, kind in _KINDS.items()), None
    except ValueError:
        return (None,) * len(_KINDS), line.rstrip(b"\r\n").decode(errors="replace")


class LogReader(_Lines, DataSourceReader):
    def partitions(self) -> list[InputPartition]:
        return self.spans({}, self.complete())


class LogStream(_Lines, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return self.complete()

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return self.spans(start, end)

    def commit(self, end: dict) -> None:
        """Nothing to do: offsets are kept by the checkpoint of the stream."""
