"""Files of a folder and its sub-folders as a Spark data source, `settled_files`, for batches and streams.

Options: `path` (of any store that Arrow knows), `extensions` (comma separated, in any case; all without), `depth` (levels of folders, 4), `settle` (seconds for which a
file must not have been written, 15 in a stream and 0 in a batch), `since` (microseconds: files changed up to then are left out), `content`: `none` gives a row for each file (path, bytes, modified in microseconds), `lines`
a row for each line of text with its number from 0. Empty files take no part, a folder that is missing has no files, and a file that is gone when its turn comes is passed over.

A stream's offset is the time of change up to which settled files have been given. A file that is written again is given again; a batch
that is repeated lists the same span of times. A file moved in with a time before the offset isn't seen.
"""

from __future__ import annotations

import io
import sys
import time
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, StringContains, StringEndsWith, StringStartsWith

from momentis.session import ship

FILES = "path string, bytes bigint, modified bigint"
LINES = FILES + ", line bigint, text string"
#: Bytes of files that one task reads, unless a file is larger.
TASK = 128 << 20
ROWS = 10_000

_TESTS = {
    EqualTo: lambda own, x: own == x, GreaterThan: lambda own, x: own > x, GreaterThanOrEqual: lambda own, x: own >= x, LessThan: lambda own, x: own < x, LessThanOrEqual: lambda own, x: own <= x,
    StringStartsWith: str.startswith, StringEndsWith: str.endswith, StringContains: str.__contains__,
}


class Files(InputPartition):
    """Files (path, bytes, modified) of one task."""

    def __init__(self, files: list[tuple]):
        super().__init__(None)
        self.files = files


class Folder:
    """What a folder holds under the options, and how its files are dealt out and read."""

    def __init__(self, options: dict):
        if "path" not in options:
            raise ValueError("settled_files needs a path")
        self.path = options["path"]
        self.extensions = {x.strip().lower().lstrip(".") for x in options.get("extensions", "").split(",") if x.strip()}
        self.depth = int(options.get("depth", 4))
        self.since = int(options.get("since", -1))
        self.lines = options.get("content", "none") == "lines"

    def store(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path) if ":" in self.path else (fs.LocalFileSystem(), self.path)

    def files(self, after: int, upto: float) -> list[tuple]:
        """Files changed after the one time and up to the other, in order of time and path."""
        store, top = self.store()
        top = top.rstrip("/")
        found = []
        for info in store.get_file_info(fs.FileSelector(top, allow_not_found=True, recursive=True)):
            inner = info.path[len(top) :].strip("/").split("/")
            fits = info.is_file and info.size and len(inner) <= self.depth and (not self.extensions or info.extension.lower() in self.extensions)
            if fits:
                at = info.mtime_ns // 1000
                if max(after, self.since) < at <= upto:
                    found.append((info.path, info.size, at))
        return sorted(found, key=lambda f: (f[2], f[0]))

    def dealt(self, files: list[tuple]) -> list[Files]:
        parts: list[list[tuple]] = []
        room = 0
        for f in files:
            if not parts or f[1] > room:
                parts.append([])
                room = TASK
            parts[-1].append(f)
            room -= f[1]
        return [Files(p) for p in parts]

    def rows(self, files: list[tuple]) -> Iterator[pa.RecordBatch]:
        names = ["path", "bytes", "modified"]
        if not self.lines:
            if files:
                path, size, at = zip(*files, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(path), pa.array(size, pa.int64()), pa.array(at, pa.int64())], names)
            return
        store, _ = self.store()
        for path, size, at in files:
            try:
                raw = store.open_input_file(path)
            except FileNotFoundError:
                continue
            with io.TextIOWrapper(raw, encoding="utf-8-sig", errors="replace") as text:
                done, held = 0, []
                for line in text:
                    held.append(line.rstrip("\n"))
                    if len(held) == ROWS:
                        yield self.batch((path, size, at), done, held)
                        done, held = done + ROWS, []
                if held:
                    yield self.batch((path, size, at), done, held)

    def batch(self, file: tuple, first: int, held: list[str]) -> pa.RecordBatch:
        n = len(held)
        own = [pa.array([file[0]] * n), pa.array([file[1]] * n, pa.int64()), pa.array([file[2]] * n, pa.int64())]
        return pa.RecordBatch.from_arrays([*own, pa.array(range(first, first + n), pa.int64()), pa.array(held, pa.string())], ["path", "bytes", "modified", "line", "text"])


class BatchReader(DataSourceReader):
    """All files of a folder; filters on a file's path, size and time decide before it is opened."""

    def __init__(self, options: dict):
        self.folder, self.settle, self.wanted = Folder(options), float(options.get("settle", 0)), []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if type(f) in _TESTS and f.attribute in (("path",), ("bytes",), ("modified",)):
                self.wanted.append((("path", "bytes", "modified").index(f.attribute[0]), type(f), f.value))
            else:
                yield f

    def partitions(self) -> list[Files]:
        files = self.folder.files(-1, (time.time() - self.settle) * 1e6)
        return self.folder.dealt([f for f in files if all(_TESTS[test](f[k], x) for k, test, x in self.wanted)]) or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        yield from self.folder.rows(partition.files)


class StreamReader(DataSourceStreamReader):
    """Files as they settle."""

    def __init__(self, options: dict):
        self.folder, self.settle, self.until = Folder(options), float(options.get("settle", 15)), None

    def initialOffset(self) -> dict:
        return {"until": self.folder.since}

    def latestOffset(self) -> dict:
        files = self.folder.files(self.until if self.until is not None else self.folder.since, (time.time() - self.settle) * 1e6)
        if files:
            self.until = files[-1][2]
        return {"until": self.until if self.until is not None else self.folder.since}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        return self.folder.dealt(self.folder.files(start["until"], end["until"]))

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        yield from self.folder.rows(partition.files)

    def commit(self, end: dict) -> None:
        # After a restart the times given before are known from the offsets of the checkpoint.
        self.until = max(end["until"], self.until if self.until is not None else end["until"])


class SettledFiles(DataSource):
    """The source `settled_files`."""

    @classmethod
    def name(cls) -> str:
        return "settled_files"

    def schema(self) -> str:
        return LINES if Folder(self.options).lines else FILES

    def reader(self, schema) -> BatchReader:
        return BatchReader(dict(self.options))

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make `settled_files` known to a session."""
    ship(spark)
    # Its workers begin before the package reaches them, so the source travels by value.
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SettledFiles)
