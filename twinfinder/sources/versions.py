"""Folders that change by one pointer: every state of the folder is a numbered file that says what belongs to it.

Data is written first, under new names; what it replaces stays where it is. One file, renamed into place, then makes
the new state visible. A writer that fails before leaves files that nobody reads; of two writers that start from the
same state one finds the number taken, looks at the new state, and tries again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

VERSIONS, PARTS = "_versions", "_parts"


class Conflict(RuntimeError):
    """Another writer has made the next state."""


class Versions:
    """The states of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(self._conf)

    def part_path(self, name: str) -> str:
        return f"{self.folder}/{PARTS}/part={name}"

    def current(self) -> tuple[int, dict]:
        """Number and content of the current state; (0, {}) before the first."""
        folder = self._path(f"{self.folder}/{VERSIONS}")
        if not self._fs.exists(folder):
            return 0, {}
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        numbers = [int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()]
        if not numbers:
            return 0, {}
        number = max(numbers)
        stream = self._fs.open(self._path(f"{self.folder}/{VERSIONS}/{number:012d}.json"))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return number, json.loads(text)

    def commit(self, number: int, content: dict) -> None:
        """Make `content` the state after `number`, or raise Conflict if there is one already."""
        draft = self._path(f"{self.folder}/{VERSIONS}/.{uuid.uuid4().hex}")
        stream = self._fs.create(draft, False)
        try:
            stream.write(bytearray(json.dumps(content).encode()))
        finally:
            stream.close()
        # Renaming with these options fails where the target exists, on every file system.
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self._conf)
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(
                self._fs.makeQualified(draft),
                self._fs.makeQualified(self._path(f"{self.folder}/{VERSIONS}/{number + 1:012d}.json")), options,
            )
        except Exception as error:
            self._fs.delete(draft, False)
            if "FileAlreadyExists" in str(error):
                raise Conflict(f"{self.folder} has a state {number + 1} already") from error
            raise

    def change(self, make: Callable[[dict], dict], attempts: int = 20) -> dict:
        """Commit what `make` turns the current state into, again from the new state when another writer was first."""
        for _ in range(attempts):
            number, content = self.current()
            wanted = make(content)
            try:
                self.commit(number, wanted)
                return wanted
            except Conflict:
                continue
        raise Conflict(f"{self.folder} changed {attempts} times in a row")
