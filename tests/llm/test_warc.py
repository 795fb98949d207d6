import base64
import hashlib
import random

from pyspark.sql import functions as F

from tallyweave.llm import warc

random.seed(2)
ROWS = [(i, f"http://x/{i}", "".join(random.choice("abc é\r\n日") for _ in range(random.randrange(9000)))) for i in range(30)]
ROWS += [(100 + i, "http://same/", ROWS[0][2]) for i in range(25)] + [(7, "http://x/7", ROWS[7][2]), (200, None, None), (201, "u\r\nv", ""), (None, "n", "alone"), (None, "n", ROWS[1][2])]
ROWS += [(300, "big", "WARC/1.1\r\nContent-Length: 5\r\n\r\n" * 9000)]


def expected(rows, least=0):
    def digest(h):
        return base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()

    size = lambda h: len((h or "").encode())
    key = lambda p: -1 if p is None else p
    out = []
    for p, _, h in rows:
        same = [q for q, _, g in rows if (g or "") == (h or "")]
        first = max(same, key=key)
        revisit = size(h) >= least and p != first
        out.append((key(p), size(h), digest(h), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    pages = spark.createDataFrame([(*r, "clash") for r in ROWS], "page_id long, url string, html string, payload string").repartition(5)
    for least in (0, 1):
        got = warc.round_trip(pages, segment=1000, chunk=300, least=least).collect()
        assert all(r.complete for r in got)
        assert sorted(((-1 if r.page_id is None else r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == expected(ROWS, least)
    assert warc.round_trip(pages.where("false")).collect() == []


def test_payloads_come_back_and_damage_is_seen(spark, tmp_path):
    pages = spark.createDataFrame(ROWS[:30], "page_id long, url string, html string").repartition(3)
    warc.write_archives(pages, str(tmp_path / "a"), segment=700, chunk=300)
    records = warc.read_records(spark, str(tmp_path / "a")).persist()
    got = {r.page_id: r.payload.decode() for r in warc.assemble(records.orderBy(F.rand(1))).select(warc.page_of(F.col("origin")).alias("page_id"), "payload").collect()}
    assert got == {i: h for i, _, h in ROWS[:30]}
    assert records.where("kind = 'continuation'").count() > 30
    lost = records.where("segment is null or segment <> 2")
    broken = {r.page_id for r in warc.assemble(lost).where("not complete").select(warc.page_of(F.col("origin")).alias("page_id")).collect()}
    assert broken == {r.p for r in records.where("segment = 2").select(warc.page_of(F.col("origin")).alias("p")).collect()}


def test_chunk_framing():
    assert warc.unchunked(warc.chunked(b"x" * 1000, 300)) == b"x" * 1000
    assert warc.unchunked(b"3;ext=1\r\nabc\r\n0\r\nTrailer: x\r\n\r\n") == b"abc"
    for bad in (b"", b"zz\r\n", b"3\r\nab\r\n0\r\n\r\n", b"3\r\nabc\r\n0\r\n", b"3\r\nabc\r\n0\r\n\r\nmore"):
        assert warc.unchunked(bad) is None


def test_archives_are_bounded_and_read_piece_by_piece(spark, tmp_path):
    import gzip

    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string").repartition(1)
    warc.write_archives(pages, str(tmp_path / "b"), segment=1000, chunk=300, archive_bytes=20_000)
    files = list((tmp_path / "b").glob("part-*"))
    assert len(files) > 10 and max(len(gzip.decompress(f.read_bytes())) for f in files) < 200_000
    # As one stream, as a member for each record, and as it is.
    records = [r + warc.CLOSE.encode() for i, u, h in ROWS for r in warc.page_records(i, u, (h or "").encode(), None, False, 700, 300)]
    for archive in (gzip.compress(b"".join(records)), b"".join(map(gzip.compress, records)), b"".join(records)):
        assert [h["warc-record-id"] for h, _ in warc.parse(archive)] == [r.split(b"WARC-Record-ID: ")[1].split(b"\r\n")[0].decode() for r in records]
        pieces = list(warc.plain(archive, 100))
        assert b"".join(pieces) == b"".join(records) and max(map(len, pieces)) <= 100
    for bad in (b"WARC/1.1\r\nContent-Length: 5\r\n\r\nab", b"none\r\n\r\n", gzip.compress(records[0])[:-20]):
        try:
            assert not list(warc.parse(bad))
        except ValueError:
            continue
        raise AssertionError(bad)


def test_pages_that_repeat(spark):
    """A segmented page that was written often, a payload that most pages share, null ids."""
    rows = [(1, "u", "x" * 40_000)] * 7 + [(None, None, "same")] * 3 + [(k, "v", "same") for k in range(10, 1300)]
    got = warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()
    assert all(r.complete for r in got)
    found = sorted(((-1 if r.page_id is None else r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str)
    same = expected([(9999, "v", "same"), (1, "u", "x" * 40_000)])
    digests = {size: digest for _, size, digest, _, _ in same}
    want = [(1, 40_000, digests[40_000], "response", None)] * 7 + [(-1, 4, digests[4], "revisit", 1299)] * 3 + [(k, 4, digests[4], "response" if k == 1299 else "revisit", None if k == 1299 else 1299) for k in range(10, 1300)]
    assert found == sorted(want, key=str)
