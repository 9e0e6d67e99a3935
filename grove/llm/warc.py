"""Web archives: pages as WARC records, each a gzip member of its own, and a reader that splits archives at any byte.

Spark's text source does both ends. It writes the members' bytes as rows; its
separator is the last byte of a member, the highest of its length, which is 0
below 16 MB. It reads with the gzip magic as separator, so each task scans its
byte range for the magic and owns what starts inside. A candidate counts as a
member once its header decodes; a magic that is only compressed data gives
a piece of the member before it.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type
from pyspark.sql.types import StructField, StructType

from grove.operators.joins import join_one
from grove.storage import shared_folder

from .common import map_rows, stored

#: The first three bytes of every member: gzip's magic and deflate.
MAGIC = b"\x1f\x8b\x08"

#: Payloads of fewer bytes are never replaced by a reference to an equal one.
LEAST_BYTES = 1000

#: How a record's content begins.
RECORD = b"WARC/"

#: A member without content, behind records whose length doesn't end in a zero byte.
EMPTY = zlib.compress(b"", 9, 31)

#: What a record is read into; the digest is SHA-1 in hexadecimal, and only responses have a payload.
RECORDS = [("record_type", pa.string()), ("page_id", pa.string()), ("refers_to", pa.string()), ("url", pa.string()), ("date", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())]

#: What the pieces of a byte range that belong to members across its borders are kept with.
BORDERS = [("_file", pa.string()), ("_start", pa.int64()), ("_ahead", pa.list_(pa.binary())), ("_own", pa.bool_()), ("_open", pa.list_(pa.binary()))]

#: What names a record: its page's id, or none.
ID = re.compile(r"<urn:x-page:(?:id:(.*)|none)>", re.S)


class DamagedArchive(ValueError):
    """Bytes that aren't whole WARC records."""


def record_name(page_id: str | None) -> str:
    return "<urn:x-page:none>" if page_id is None else f"<urn:x-page:id:{line(page_id)}>"


def line(text: str) -> str:
    """text without line breaks: they and per cent signs before two hexadecimal digits stand as such codes."""
    return re.sub(r"[\r\n\x00]|%(?=[0-9A-Fa-f]{2})", lambda m: f"%{ord(m[0]):02X}", text)


def unline(text: str) -> str:
    return re.sub(r"%(0D|0A|00|25)", lambda m: chr(int(m[1], 16)), text)


def member(page_id: str | None, url: str | None, payload: bytes, refers_to: str | None, revisit: bool, date: str, level: int = 6) -> bytes:
    """One record as a gzip member: a response with its payload, or a revisit with its headers alone, which keep the payload's length."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_name(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {line(url)}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_name(refers_to)}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return zlib.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", level, 31)


def headers(block: bytes) -> tuple[str, dict[str, str]]:
    first, *rest = block.decode("utf-8", "replace").split("\r\n")
    return first, {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in rest) if k}


def parse_record(data: bytes) -> tuple | None:
    """A row of RECORDS from a member's content, its payload held against its digest; None if the content is no response or revisit of a page."""
    head, gap, body = data.partition(b"\r\n\r\n")
    version, own = headers(head)
    if not gap or not version.startswith("WARC/"):
        raise DamagedArchive("a member without a WARC header")
    kind, name = own.get("warc-type"), ID.fullmatch(own.get("warc-record-id", ""))
    if kind not in ("response", "revisit") or not name:
        return None
    block = body[: int(own["content-length"])]
    if len(block) != int(own["content-length"]):
        raise DamagedArchive(f"a record shorter than it says: {name[0]}")
    http, _, payload = block.partition(b"\r\n\r\n")
    n, digest = int(headers(http)[1].get("content-length", len(payload))), own.get("warc-payload-digest", "").removeprefix("sha1:")
    digest = base64.b32decode(digest).hex() if len(digest) == 32 else digest
    if kind == "response" and (len(payload) != n or hashlib.sha1(payload).hexdigest() != digest):
        raise DamagedArchive(f"a payload that doesn't fit its digest: {name[0]}")
    refers = ID.fullmatch(own.get("warc-refers-to", ""))
    url = own.get("warc-target-uri")
    plain = lambda m: None if m is None or m[1] is None else unline(m[1])
    return kind, plain(name), plain(refers), None if url is None else unline(url), own.get("warc-date"), n, digest, payload if kind == "response" else None


class Members:
    """Members out of the pieces between magics.

    A piece goes on with the open member if there is one, else it begins a
    member. With `inside`, the first pieces may belong to a member that began
    in an earlier byte range: pieces stand in `ahead` until one begins a
    member whose content starts like a record's.
    """

    def __init__(self, inside: bool = False) -> None:
        self.searching, self.ahead, self.unsure = inside, [], []
        self.decoder, self.held, self.content = None, [], []

    def open_pieces(self) -> list[bytes]:
        return self.held if self.decoder else []

    def starts(self) -> bool | None:
        """Whether a member begins with the unsure pieces; None if they are too few to say."""
        decoder = zlib.decompressobj(31)
        try:
            found = b"".join(decoder.decompress(MAGIC + p, 64) for p in self.unsure)
        except zlib.error:
            return False
        if decoder.eof or len(found) >= len(RECORD):
            return found.startswith(RECORD) or not found
        return None if RECORD.startswith(found) else False

    def add(self, piece: bytes) -> list[bytes]:
        """The contents of the members that end with this piece, which stood behind a magic."""
        if not self.searching:
            return self.follow(piece)
        self.unsure.append(piece)
        while self.unsure:
            match self.starts():
                case None:
                    return []
                case False:
                    self.ahead.append(self.unsure.pop(0))
                case True:
                    self.searching = False
                    return [data for p in self.unsure for data in self.follow(p)]
        return []

    def follow(self, piece: bytes) -> list[bytes]:
        if self.decoder is None:
            self.decoder, self.held, self.content = zlib.decompressobj(31), [], []
        try:
            self.content.append(self.decoder.decompress(MAGIC + piece))
        except zlib.error as e:
            raise DamagedArchive(f"a gzip member that doesn't decode: {e}") from None
        self.held.append(piece)
        if not self.decoder.eof:
            return []
        if self.decoder.unused_data.strip(b"\x00"):
            raise DamagedArchive("bytes between gzip members")
        done, self.decoder = b"".join(self.content), None
        return [done]


def batch(rows: list[tuple], fields: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=t) for i, (_, t) in enumerate(fields)], names=[n for n, _ in fields])


def records_of(contents: list[bytes], payload: bool) -> list[tuple]:
    rows = [row for data in contents if data and (row := parse_record(data))]
    return rows if payload else [(*row[:-1], None) for row in rows]


def scan_ranges(payload: bool):
    """A function over batches (piece, file, start of the range): the records of each byte range, and a row of BORDERS where members cross its borders."""
    fields, none = [*RECORDS, *BORDERS], (None,) * len(BORDERS)

    def border(members: Members, file: str, start: int) -> list[tuple]:
        ahead, held = [*members.ahead, *(members.unsure if members.searching else [])], members.open_pieces()
        return [(*[None] * len(RECORDS), file, start, ahead, not members.searching, held)] if ahead or held else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members, place = None, None
        for b in batches:
            rows, size = [], 0
            for piece, file, start in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if place != (file, start):
                    rows += border(members, *place) if place else []
                    members, place = Members(inside=start > 0), (file, start)
                    if start == 0:
                        if piece:
                            raise DamagedArchive(f"{file} doesn't begin with a gzip member")
                        continue
                made = members.add(piece)
                rows += [(*r, *none) for r in records_of(made, payload)]
                size += sum(map(len, made)) if payload else 0
                if size > 1 << 24:
                    yield batch(rows, fields)
                    rows, size = [], 0
            yield batch(rows, fields)
        if place:
            yield batch(border(members, *place), fields)

    return run


def join_ranges(payload: bool):
    """A function over batches of BORDERS, sorted by file and start: the records that cross borders."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members, at = Members(), None
        for b in batches:
            rows = []
            for file, start, ahead, own, held in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if file != at and members.decoder:
                    raise DamagedArchive(f"{at} ends within a member")
                at = file
                for piece in ahead:
                    rows += records_of(members.add(piece), payload)
                if own and members.decoder:
                    raise DamagedArchive(f"{file} has members within a member from {start} on")
                for piece in held:
                    members.add(piece)
            yield batch(rows, RECORDS)
        if members.decoder:
            raise DamagedArchive(f"{at} ends within a member")

    return run


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = LEAST_BYTES, date: str = "2024-01-01T00:00:00Z") -> None:
    """Writes a record for every row of pages as archives in the folder path.

    Of rows whose payloads (the html in UTF-8; null counts as empty) are equal
    and have least_bytes or more, those with the largest id become responses,
    all others revisits of it; a null id is smaller than any other. Smaller
    payloads are responses each. Rows that repeat the largest id with the
    same payload are responses each, too. Other columns aren't written.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("binary"), F.lit(b"")).alias("payload"))
    big = F.length("payload") >= least_bytes
    rows = rows.withColumn("same", F.when(big, F.unhex(F.sha2("payload", 256))))
    again = rows.where(big).groupBy("same").agg(F.max("id").alias("largest"), F.count("*").alias("n")).where("n > 1 and largest is not null")
    again = stored(again, "warc-again")
    total = again.agg(F.sum("n")).first()[0] or 0
    rows = join_one(rows, again, ["same"], "n", total, ["id", "url"])
    rows = rows.select("url", "payload", F.col("id").cast("string").alias("id"), F.col("largest").cast("string").alias("refers_to"), (F.col("largest").isNotNull() & ~F.col("id").eqNullSafe(F.col("largest"))).alias("revisit"))

    def setup():
        def row(id_, url, payload, refers_to, revisit):
            made = member(id_, url, payload, refers_to, revisit, date)
            return ((made if made[-1] == 0 else made + EMPTY)[:-1],)

        return row

    made = map_rows(rows, ["id", "url", "payload", "refers_to", "revisit"], [], "value binary", setup)
    made.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\x00").option("compression", "none").text(path)


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The responses and revisits of the archives in path, as RECORDS; without payload, that column is null.

    Members may cross any number of byte ranges, and a file's ranges may be
    read by as many tasks. Bytes that belong to no member, a member that
    doesn't decode, and a payload that doesn't fit its digest are errors, and
    so are archives whose payloads hold whole archives uncompressed where a
    range begins in one. Names that end in .gz are read whole by one task
    each, since Spark doesn't split them. With payload the archives are
    scanned twice, first for what crosses borders; without, once.
    """
    source = spark.read.option("lineSep", MAGIC.decode("latin-1")).option("encoding", "ISO-8859-1")
    plain = spark._jvm.org.apache.hadoop.io.compress.PassthroughCodec
    source = source.option("io.compression.codecs", plain.CLASSNAME).option(plain.OPT_EXTENSION, ".gz")
    pieces = source.text(path).select(F.col("value").cast("binary").alias("piece"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    schema = lambda fields: StructType([StructField(n, from_arrow_type(t)) for n, t in fields])
    scanned = pieces.mapInArrow(scan_ranges(payload), schema([*RECORDS, *BORDERS]))
    if not payload:
        scanned = stored(scanned, "warc-records")
    border = scanned.where("_file is not null").select(*[n for n, _ in BORDERS])
    border = stored(border, "warc-borders").repartition("_file").sortWithinPartitions("_file", "_start")
    whole = scanned.where("_file is null").select(*[n for n, _ in RECORDS])
    return whole.unionByName(border.mapInArrow(join_ranges(payload), schema(RECORDS)))


def archive_pages(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Writes pages (page_id, url, html) as archives and reads them back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    The archives stand in path, by default a new folder in the shared one. A
    revisit's length and digest come from its own headers. See write_warc for
    nulls and ties; no rows give no rows.
    """
    path = path or f"{shared_folder(pages.sparkSession).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write_warc(pages, path)
    kind = pages.schema["page_id"].dataType
    return read_warc(pages.sparkSession, path, payload=False).select(F.col("page_id").cast(kind), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind))


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
     m AS (SELECT page_id, html, CASE WHEN strlen(html) >= 1000 THEN max(page_id) OVER (PARTITION BY html) END AS largest FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN page_id < largest THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < largest THEN largest END AS refers_to
FROM m
"""
