"""A sink for reports and listings: lines in order, written once and whole.

    spark.dataSource.register(LinesSink)
    report_lines(spark, report.table()).write.format("lines").mode("overwrite").save("/shared/report")

Each write is a version of its own below the path: a file for each task, and
a manifest that names them in order and comes last. A version counts once its
manifest is there, so readers never find a report missing or half written; a
write that fails takes its files away and leaves the versions before it. The
two newest versions stay; what tasks that outlive a failed write leave goes
with the versions before these. No rename is needed, and nothing passes through the
driver but the names of files. The path is one that pyarrow's file systems
know and that the driver and all tasks share.
"""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow.fs import FileInfo, FileSelector, FileSystem, FileType
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

MANIFEST, KEPT = "manifest.json", 2


def report_lines(spark: SparkSession, text: str) -> DataFrame:
    """A report's table or JSON as one partition of lines."""
    return spark.createDataFrame([(line,) for line in text.splitlines()], "line string").coalesce(1)


def folders(files: FileSystem, base: str) -> list[FileInfo]:
    """The versions below the base, whole or not, oldest first."""
    found = files.get_file_info(FileSelector(base, allow_not_found=True))
    return sorted((f for f in found if f.type == FileType.Directory and f.base_name[:10].isdigit()), key=lambda f: f.base_name)


def whole(files: FileSystem, base: str) -> list[str]:
    """The paths of the whole versions, oldest first."""
    paths = [f.path for f in folders(files, base)]
    there = files.get_file_info([f"{p}/{MANIFEST}" for p in paths])
    return [p for p, m in zip(paths, there) if m.type == FileType.File]


def newest_parts(path: str) -> tuple[FileSystem, list[str]]:
    """The files of the newest whole version, in order."""
    files, base = FileSystem.from_uri(path)
    if not (versions := whole(files, base)):
        raise FileNotFoundError(f"nothing written at {path!r} yet")
    with files.open_input_stream(f"{versions[-1]}/{MANIFEST}") as f:
        return files, [f"{versions[-1]}/{p['name']}" for p in json.loads(f.read())["parts"]]


def read_lines(path: str) -> Iterator[str]:
    """The lines of the newest whole version, in order, a buffer at a time."""
    files, parts = newest_parts(path)
    for part in parts:
        with io.TextIOWrapper(files.open_input_file(part), encoding="utf-8", newline="\n") as f:
            for line in f:
                yield line.removesuffix("\n")


@dataclass
class Part(WriterCommitMessage):
    partition: int
    name: str
    lines: int


class LinesWriter(DataSourceArrowWriter):
    def __init__(self, path: str, column: int, overwrite: bool):
        self.path, self.column, self.overwrite = path, column, overwrite
        files, base = FileSystem.from_uri(path)
        last = folders(files, base)
        number = int(last[-1].base_name[:10]) + 1 if last else 0
        if last and not overwrite:
            raise ValueError(f"lines at {path!r} exist; only mode overwrite replaces them")
        self.version = f"{number:010d}-{uuid.uuid4().hex}"

    def _folder(self) -> tuple[FileSystem, str]:
        files, base = FileSystem.from_uri(self.path)
        return files, f"{base}/{self.version}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        """One file; attempts of a task write files of their own, and the manifest names that of the one which counts."""
        files, folder = self._folder()
        partition, n = TaskContext.get().partitionId(), 0
        name = f"part-{partition:06d}-{uuid.uuid4().hex}"
        files.create_dir(folder)
        with files.open_output_stream(f"{folder}/{name}") as out:
            for b in iterator:
                lines = b.column(self.column)
                if lines.null_count:
                    raise ValueError("a line is null")
                if pc.any(pc.match_substring(lines, "\n")).as_py():
                    raise ValueError("a line holds a line break")
                for line in pc.binary_join_element_wise(lines.cast(pa.binary()), b"", b"\n").to_pylist():
                    out.write(line)
                n += len(lines)
        return Part(partition, name, n)

    def commit(self, messages: Iterable[Part | None]) -> None:
        files, folder = self._folder()
        parts = sorted((m for m in messages if m is not None and m.lines), key=lambda m: m.partition)
        if any(f.type != FileType.File for f in files.get_file_info([f"{folder}/{p.name}" for p in parts])):
            raise FileNotFoundError(f"parts of {folder!r} went while it was written")
        files.create_dir(folder)
        with files.open_output_stream(f"{folder}/{MANIFEST}") as out:
            out.write(json.dumps({"parts": [{"name": p.name, "lines": p.lines} for p in parts]}).encode())
        base = folder.rpartition("/")[0]
        kept = whole(files, base)[-KEPT:]
        for old in folders(files, base):
            if old.path < kept[0]:
                files.delete_dir(old.path)

    def abort(self, messages: Iterable[Part | None]) -> None:
        files, folder = self._folder()
        if files.get_file_info(folder).type == FileType.Directory:
            files.delete_dir(folder)


class LinesSink(DataSource):
    """Writes the string column `line`; further columns are left out. Null lines and lines with breaks are errors; no rows give an empty report."""

    @classmethod
    def name(cls) -> str:
        return "lines"

    def writer(self, schema: StructType, overwrite: bool) -> LinesWriter:
        if "line" not in schema.names or schema["line"].dataType.typeName() != "string":
            raise ValueError("lines are written from a string column named line")
        return LinesWriter(self.options["path"], schema.names.index("line"), overwrite)
