"""Git repositories as Spark data sources.

    spark.dataSource.register(GitSource)
    spark.read.format("git").option("path", p).option("table", "refs").load()

Tables: refs, objects (in the order of git's own walk), contents (of trees,
commits and tags; blobs are never read). With
spark.sql.python.filterPushdown.enabled and the option pushdown, conditions on the start or the whole
of refname become patterns for git, which then lists no other references;
ord counts what is listed. The source finds a part's share of
contents by a walk of its own; read_objects and read_contents, which a scan
uses, walk once and deal the stored ids out.
"""

from __future__ import annotations

import functools
import os
import shutil
import subprocess
import threading
from collections.abc import Iterable, Iterator
from decimal import Decimal
from itertools import chain

import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith

SCHEMAS = {
    "refs": "ord long, refname string, type string, size long, oid binary",
    "objects": "ord long, oid binary, type string, size decimal(20,0)",
    "contents": "oid binary, type string, data binary",
}
ARROW = {
    "refs": pa.schema([("ord", pa.int64()), ("refname", pa.string()), ("type", pa.string()), ("size", pa.int64()), ("oid", pa.binary())]),
    "objects": pa.schema([("ord", pa.int64()), ("oid", pa.binary()), ("type", pa.string()), ("size", pa.decimal128(20, 0))]),
    "contents": pa.schema([("oid", pa.binary()), ("type", pa.string()), ("data", pa.binary())]),
}
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
BATCH, BATCH_BYTES = 10_000, 1 << 24


@functools.cache
def git_binary() -> str:
    """The absolute path of git on PATH, looked up once; never one of the repository's own."""
    found = shutil.which("git", path=os.pathsep.join(p for p in os.environ.get("PATH", "").split(os.pathsep) if os.path.isabs(p)))
    if not found:
        raise FileNotFoundError("git isn't installed")
    return os.path.realpath(found)


class Repository:
    """A full clone, by its git folder."""

    def __init__(self, git_dir: str):
        self.git_dir = git_dir
        shallow = self.run("rev-parse", "--git-path", "shallow").decode().rstrip("\n")
        if os.path.lexists(shallow if os.path.isabs(shallow) else os.path.join(os.getcwd(), shallow)):
            raise ValueError("this is a shallow clone; a full one is needed")

    @classmethod
    def at(cls, path: str) -> Repository:
        found = subprocess.run([git_binary(), "-C", path, "rev-parse", "--git-dir"], capture_output=True)
        if found.returncode:
            raise ValueError(f"no git repository at {path!r}: {found.stderr.decode().strip()}")
        return cls(os.path.abspath(os.path.join(path, found.stdout.decode().rstrip("\n"))))

    def command(self, *args: str) -> list[str]:
        return [git_binary(), "--no-replace-objects", *args]

    def environment(self) -> dict[str, str]:
        return os.environ | {"GIT_DIR": self.git_dir, "GIT_GRAFT_FILE": os.devnull}

    def run(self, *args: str, ok: tuple[int, ...] = (0,)) -> bytes:
        done = subprocess.run(self.command(*args), env=self.environment(), capture_output=True)
        if done.returncode not in ok:
            raise RuntimeError(f"git {' '.join(args)}: {done.stderr.decode(errors='replace').strip()}")
        return done.stdout

    def lines(self, *args: str, feed: Iterator[bytes] | list[bytes] = ()) -> Iterator[bytes]:
        """The lines of a git process whose input is written by another thread."""
        p = subprocess.Popen(self.command(*args), env=self.environment(), stdin=subprocess.PIPE, stdout=subprocess.PIPE)

        def write() -> None:
            try:
                for line in feed:
                    p.stdin.write(line + b"\n")
                p.stdin.close()
            except BrokenPipeError:
                pass

        writer = threading.Thread(target=write, daemon=True)
        writer.start()
        with p:
            yield from (line.rstrip(b"\n") for line in p.stdout)
        writer.join()
        if p.returncode:
            raise RuntimeError(f"git {' '.join(args)} failed")

    def resolve(self, name: str) -> str:
        return self.run("rev-parse", "--verify", "--end-of-options", name).decode().strip()

    def config(self, section: str) -> list[tuple[str, str]]:
        """(rest of key, value) in order of all settings below the section; a setting without a value is empty."""
        out = []
        for record in self.run("config", "--list", "-z", ok=(0, 1)).decode(errors="replace").split("\0"):
            key, _, value = record.partition("\n")
            if key.startswith(f"{section}."):
                out.append((key[len(section) + 1 :], value))
        return out

    def setting(self, key: str, default: str | None = None, kind: str | None = None) -> str | None:
        """One setting, read as git reads that kind (bool, int); the default where it is unset."""
        done = subprocess.run(self.command("config", *([f"--{kind}"] if kind else []), "--get", key), env=self.environment(), capture_output=True)
        if done.returncode == 1:
            return default
        if done.returncode:
            raise ValueError(f"bad setting {key}: {done.stderr.decode().strip()}")
        return done.stdout.decode().rstrip("\n")

    def references(self, patterns: Iterable[str] = ()) -> Iterator[tuple[int, str, str, int, bytes]]:
        """The references, or those that match one of git's patterns. Bytes of a name that aren't UTF-8 stand as \\xff, which no other name has, as backslashes aren't allowed in names."""
        for i, line in enumerate(self.lines("for-each-ref", "--format=%(objectname) %(objecttype) %(objectsize) %(refname)", *patterns)):
            words = line.split(b" ")
            if len(words) != 4 or int(words[2]) >= 1 << 32:
                raise ValueError(f"bad reference line: {line!r}")
            yield i, words[3].decode("utf-8", "backslashreplace"), words[1].decode(), int(words[2]), bytes.fromhex(words[0].decode())

    def walk(self, roots: Iterable[str]) -> Iterator[bytes]:
        """Hexadecimal ids of all objects that the roots reach, each once, newest commits first."""
        for line in self.lines("rev-list", "--objects", "--stdin", "--date-order", feed=(r.encode() for r in roots)):
            if len(line) < 40:
                raise ValueError(f"short line: {line!r}")
            yield line[:40]

    def headers(self, oids: Iterator[bytes]) -> Iterator[tuple[bytes, str, int]]:
        for line in self.lines("cat-file", "--batch-check", "--buffer", feed=oids):
            words = line.split(b" ")
            if words[-1] == b"missing" or len(words) != 3:
                raise ValueError(f"missing object: {line!r}")
            yield bytes.fromhex(words[0].decode()), words[1].decode(), int(words[2])

    def contents(self, oids: list[bytes]) -> Iterator[tuple[bytes, str, bytes]]:
        if not oids:
            return
        p = subprocess.Popen(self.command("cat-file", "--batch", "--buffer"), env=self.environment(), stdin=subprocess.PIPE, stdout=subprocess.PIPE)

        def write() -> None:
            p.stdin.write(b"".join(o.hex().encode() + b"\n" for o in oids))
            p.stdin.close()

        threading.Thread(target=write, daemon=True).start()
        with p:
            for oid in oids:
                words = p.stdout.readline().split()
                if len(words) != 3:
                    raise ValueError(f"missing object {oid.hex()}")
                data = p.stdout.read(int(words[2]) + 1)[:-1]
                if len(data) != int(words[2]):
                    raise ValueError(f"object {oid.hex()} cut short")
                yield oid, words[1].decode(), data


class Share(InputPartition):
    def __init__(self, part: int, parts: int):
        super().__init__((part, parts))
        self.part, self.parts = part, parts


def listed_by(condition: Filter) -> list[str]:
    """Patterns of git's that list all names that a condition takes; none if it isn't about their start."""
    match condition:
        case EqualTo(value=value):
            starts = [value]
        case In(value=values):
            starts = list(values)
        case StringStartsWith(value=value):
            starts = [value] if value.endswith("/") else [f"{glob_text(value)}*", f"{glob_text(value)}*/**"]
        case _:
            return []
    return starts if all(starts) and all(isinstance(x, str) and "\\x" not in x for x in starts) else []


def glob_text(text: str) -> str:
    return "".join(f"\\{c}" if c in "*?[\\" else c for c in text)


class GitReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.table = options["path"], options.get("table", "refs")
        self.roots = [r for r in options.get("roots", "").split(",") if r]
        self.parts = int(options.get("partitions", "4")) if self.table == "contents" else 1
        self.patterns: list[str] = []

    def partitions(self) -> list[Share]:
        return [Share(i, self.parts) for i in range(self.parts)]

    def walked(self, repository: Repository) -> Iterator[bytes]:
        return repository.walk(self.roots) if self.roots else iter(())

    def rows(self, share: Share) -> Iterator[tuple]:
        repository = Repository.at(self.path)
        if self.table == "refs":
            yield from repository.references(self.patterns)
        elif self.table == "objects":
            for i, (oid, kind, size) in enumerate(repository.headers(self.walked(repository))):
                yield i, oid, kind, Decimal(size)
        else:
            own = (o for o in self.walked(repository) if int(o[:8], 16) % share.parts == share.part)
            yield from repository.contents([oid for oid, kind, _ in repository.headers(own) if kind != "blob"])

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        yield from batched(self.rows(partition), self.table)


class PushingReader(GitReader):
    """A reader that Spark tells its conditions; it may only be one where that is switched on."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Keeps the first condition on names as patterns; since these are coarser, Spark checks every condition again."""
        for f in filters:
            if self.table == "refs" and not self.patterns and getattr(f, "attribute", None) == ("refname",):
                self.patterns = listed_by(f)
            yield f


def batched(rows: Iterator[tuple], table: str) -> Iterator[pa.RecordBatch]:
    """Arrow batches of bounded rows and, for contents, bytes."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[2]) if table == "contents" else 0
        if len(held) == BATCH or size > BATCH_BYTES:
            yield batch(held, ARROW[table])
            held, size = [], 0
    if held:
        yield batch(held, ARROW[table])


def batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


class GitSource(DataSource):
    """Options: path; table (refs, objects, contents); roots, comma-separated; partitions of contents; pushdown, true where Spark's setting is."""

    @classmethod
    def name(cls) -> str:
        return "git"

    def schema(self) -> str:
        Repository.at(self.options["path"])
        return SCHEMAS[self.options.get("table", "refs")]

    def reader(self, schema) -> GitReader:
        return (PushingReader if self.options.get("pushdown") == "true" else GitReader)(dict(self.options))


def read(spark: SparkSession, path: str, table: str, roots: list[str] = (), partitions: int = 4):
    spark.dataSource.register(GitSource)
    return spark.read.format("git").option("path", path).option("table", table).option("pushdown", spark.conf.get(PUSHDOWN)).option("roots", ",".join(roots)).option("partitions", str(partitions)).load()


def read_objects(roots: DataFrame, path: str) -> DataFrame:
    """The objects table over roots (ord, oid), in one task as git walks in one process; the roots stream into it and never gather at the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        repository = Repository.at(path)
        oids = (oid.as_py().hex() for b in chain([first], batches) for oid in b.column(0))
        yield from batched(((i, oid, kind, Decimal(size)) for i, (oid, kind, size) in enumerate(repository.headers(repository.walk(oids)))), "objects")

    once = roots.groupBy("oid").agg(F.min("ord").alias("ord")).repartition(1).sortWithinPartitions("ord").select("oid")
    return once.mapInArrow(run, SCHEMAS["objects"])


def read_contents(objects: DataFrame, path: str, partitions: int, count: Accumulator | None = None) -> DataFrame:
    """The contents table of all objects but blobs, dealt to tasks with a git process each; nothing is walked again. Tasks add their objects to count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repository = Repository.at(path)
        for b in batches:
            yield from batched(repository.contents([oid.as_py() for oid in b.column(0)]), "contents")
            if count is not None:
                count.add(b.num_rows)

    return objects.where("type <> 'blob'").select("oid").repartition(partitions).mapInArrow(run, SCHEMAS["contents"])
