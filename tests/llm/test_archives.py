import gzip
import random

import pytest

from grove.llm import warc
from grove.llm.warc import MAGIC, DamagedArchive, Members, archive_pages, member, read_warc, write_warc

SCHEMA = "page_id long, url string, html string, largest string, payload string, n long"


def made_pages():
    draw = random.Random(1)
    html = [None, "", "x" * 999, "y" * 1000, "z" * 1001, "é" * 500, "é" * 499]
    rows = [(i if i % 50 else None, draw.choice([None, "http://a/%20b\r\nX: 1", f"http://é/{i}"]), html[i % 7] if i % 3 else "".join(chr(draw.randrange(32, 0x2000)) for _ in range(draw.randrange(5000))), "q", "p", 1) for i in range(200)]
    long = "".join(chr(draw.randrange(32, 0x7000)) for _ in range(200_000))
    return [*rows, rows[4], (1000, "u", "big" * 1_000_000, *rows[0][3:]), (1001, "u", long, *rows[0][3:]), (1002, "u", long, *rows[0][3:]), (1002, "u", long, *rows[0][3:])]


def brute(pages):
    """(page_id, url, bytes, type, refers_to) of every page."""
    same = {}
    for page, _, html, *_ in pages:
        if page is not None:
            same.setdefault(html or "", []).append(page)
    for page, url, html, *_ in pages:
        n = len((html or "").encode())
        largest = max(same.get(html or "", ()), default=None) if n >= 1000 else None
        revisit = largest is not None and page != largest
        yield page, url, n, "revisit" if revisit else "response", largest if revisit else None


def small_ranges(spark, size):
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    spark.conf.set("spark.sql.files.minPartitionNum", "1")


@pytest.fixture
def ranges(spark):
    yield lambda size: small_ranges(spark, size)
    for name in ("maxPartitionBytes", "openCostInBytes", "minPartitionNum"):
        spark.conf.unset(f"spark.sql.files.{name}")


def test_round_trip(spark, tmp_path, ranges):
    """Payloads of all sizes, copies, nulls and odd addresses, over byte ranges far smaller than the longest member."""
    pages = made_pages()
    path = f"file://{tmp_path}/archive"
    write_warc(spark.createDataFrame(pages, SCHEMA).repartition(3), path)
    assert sum(gzip.decompress(f.read_bytes()).count(b"WARC/1.1\r\n") for f in tmp_path.glob("archive/*.txt")) == len(pages)
    ranges("50k")
    found = read_warc(spark, path)
    rows = found.select(found.page_id.cast("long"), "url", "payload_bytes", "record_type", found.refers_to.cast("long")).collect()
    assert sorted(map(repr, map(tuple, rows))) == sorted(map(repr, brute(pages)))
    html = {p: (h or "").encode() for p, _, h, *_ in pages}
    assert all(bytes(r["payload"]) == html[int(r["page_id"])] for r in found.where("record_type = 'response' and page_id is not null").select("page_id", "payload").collect())
    assert found.where("record_type = 'revisit' and payload is not null").isEmpty()


def test_query_columns(spark):
    pages = made_pages()
    df = spark.createDataFrame(pages, SCHEMA)
    found = archive_pages(df)
    assert found.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(repr((r[0], r[1], r[3], r[4])) for r in found.collect()) == sorted(repr((p, n, t, to)) for p, _, n, t, to in brute(pages))
    assert {r[0] for r in found.where("payload_bytes = 0").select("payload_digest").collect()} == {"da39a3ee5e6b4b0d3255bfef95601890afd80709"}
    assert archive_pages(df.limit(0)).count() == 0
    named = df.selectExpr("cast(page_id as string) page_id", "url", "html")
    assert archive_pages(named).where("record_type = 'revisit'").count() == sum(t == "revisit" for *_, t, _ in brute([(None if p is None else str(p), *r) for p, *r in pages]))


def magics(draw, n):
    """Text bytes full of what looks like the start of a member."""
    return b"".join(draw.choice([MAGIC, MAGIC + b"\x00" * 6, MAGIC[:2], b"ab", MAGIC + b"\x08\x00\x00\x00\x00\x00\x03x\x03"]) for _ in range(n))


@pytest.mark.parametrize("size", [149, 700, 5000])
def test_magic_within_members(spark, tmp_path, ranges, size):
    """Members stored without compression, whose payloads hold magics, read whole however ranges cut them; names ending in .gz as well."""
    draw = random.Random(size)
    payloads = [magics(draw, draw.randrange(100)) for _ in range(15)]
    data = b"".join(member(str(i), "u", p, None, False, "d", level=0) + (warc.EMPTY if i % 7 == 0 else b"") for i, p in enumerate(payloads))
    (tmp_path / "a.warc").write_bytes(data)
    (tmp_path / "b.warc.gz").write_bytes(data)
    ranges(str(size))
    for name in ("a.warc", "b.warc.gz"):
        found = {int(r["page_id"]): bytes(r["payload"]) for r in read_warc(spark, f"file://{tmp_path}/{name}").select("page_id", "payload").collect()}
        assert found == dict(enumerate(payloads))


def test_damage_is_an_error(spark, tmp_path):
    good = [member(str(i), None, b"text %d" % i, None, False, "d") for i in range(3)]
    broken = {"cut": b"".join(good)[:-9], "junk": good[0] + b"junk" + good[1], "first": b"x" + good[0], "header": good[0] + gzip.compress(b"other"), "digest": good[0] + warc.zlib.compress(warc.zlib.decompress(good[1], 31).replace(b"text", b"tent"), 6, 31)}
    for name, data in broken.items():
        (tmp_path / name).write_bytes(data)
        with pytest.raises(Exception, match="DamagedArchive"):
            read_warc(spark, f"file://{tmp_path}/{name}").collect()
    with pytest.raises(DamagedArchive):
        Members().add(b"no member")
