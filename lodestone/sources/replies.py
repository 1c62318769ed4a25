"""A data source over a folder of stored replies and manifests: ``spark.read.format("stored_replies").load(folder)`` or ``readStream``.

Files lie in ``<folder>/<kind>/<name>``, at any depth below the kind. Reads are partitioned by size; filters on kind, name, path, size and modified are
applied to the listing, so other files are never opened; a projection without content opens none. A stream's offset is the place of the last
file in order of (modified, path): files that come later with an earlier time are not seen, as with Spark's own file streams when old files are
ignored.

Folders are opened by pyarrow's file systems (local, HDFS, S3, GCS). A file that is gone when it is read gives null content; bytes that
are no UTF-8 become U+FFFD.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringEndsWith, StringStartsWith
from pyspark.sql.types import StructType

SCHEMA = "kind string, name string, path string, size long, modified timestamp, content string"
PART_BYTES = 32 << 20
_LISTED = {"kind": 0, "name": 1, "path": 2, "size": 3, "modified": 4}
_TESTS = {
    EqualTo: lambda x, v: x == v, GreaterThan: lambda x, v: x > v, GreaterThanOrEqual: lambda x, v: x >= v, LessThan: lambda x, v: x < v, LessThanOrEqual: lambda x, v: x <= v,
    In: lambda x, v: x in v, StringStartsWith: lambda x, v: x.startswith(v), StringEndsWith: lambda x, v: x.endswith(v),
}


def _listed(folder: str) -> list[tuple]:
    """kind, name, path, size, modified of every file, in order of time and path."""
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
    root = root.rstrip("/")
    out = []
    for info in system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
        inside = info.path[len(root) + 1 :].split("/")
        if info.is_file and len(inside) > 1 and not inside[-1].startswith((".", "_")):
            out.append((inside[0], inside[-1], info.path, info.size, info.mtime))
    return sorted(out, key=lambda f: (f[4], f[2]))


class Part(InputPartition):
    def __init__(self, files: list[tuple]):
        self.files = files


def _parts(files: list[tuple]) -> list[Part]:
    out, size = [], PART_BYTES
    for f in files:
        if size + f[3] > PART_BYTES or size >= PART_BYTES:
            out.append([])
            size = 0
        out[-1].append(f)
        size += f[3] + 4096
    return [Part(p) for p in out]


def _rows(folder: str, part: Part) -> Iterator[tuple]:
    from pyarrow import fs

    system = fs.FileSystem.from_uri(folder)[0] if "://" in folder else fs.LocalFileSystem()
    for f in part.files if part is not None else ():
        try:
            with system.open_input_stream(f[2], compression=None) as stream:
                content = stream.read().decode("utf-8", "replace")
        except FileNotFoundError:
            content = None
        yield (*f, content)


class _Reader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder, self.tests = folder, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if type(f) in _TESTS and len(f.attribute) == 1 and f.attribute[0] in _LISTED and f.value is not None:
                self.tests.append((_LISTED[f.attribute[0]], _TESTS[type(f)], f.value))
            else:
                yield f

    def _fits(self, file: tuple) -> bool:
        for place, test, value in self.tests:
            own = file[place]
            if place == 4 and getattr(value, "tzinfo", None) is None:
                own = own.astimezone().replace(tzinfo=None)
            if not test(own, value):
                return False
        return True

    def partitions(self) -> list[Part]:
        return _parts([f for f in _listed(self.folder) if self._fits(f)]) or [Part([])]

    def read(self, partition: Part) -> Iterator[tuple]:
        return _rows(self.folder, partition)


class _StreamReader(DataSourceStreamReader):
    def __init__(self, folder: str):
        self.folder = folder

    @staticmethod
    def _place(file: tuple) -> list:
        return [int(file[4].timestamp() * 1_000_000), file[2]]

    def initialOffset(self) -> dict:
        return {"at": json.dumps([0, ""])}

    def latestOffset(self) -> dict:
        files = _listed(self.folder)
        return {"at": json.dumps(self._place(files[-1]) if files else [0, ""])}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        low, high = json.loads(start["at"]), json.loads(end["at"])
        return _parts([f for f in _listed(self.folder) if low < self._place(f) <= high])

    def read(self, partition: Part) -> Iterator[tuple]:
        return _rows(self.folder, partition)


class StoredReplies(DataSource):
    @classmethod
    def name(cls) -> str:
        return "stored_replies"

    def schema(self) -> str:
        return SCHEMA

    def _folder(self) -> str:
        folder = self.options.get("path")
        if not folder:
            raise ValueError("stored_replies asks for a path")
        return folder

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(self._folder())

    def streamReader(self, schema: StructType) -> _StreamReader:
        return _StreamReader(self._folder())


def register(spark: SparkSession) -> None:
    """Name the source in a session, with filters reaching it."""
    from lodestone.runtime import ship_package

    ship_package(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(StoredReplies)
