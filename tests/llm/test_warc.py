import base64
import gzip
import hashlib
import io
from pathlib import Path

import pytest

from colprism.llm import warc
from colprism.llm.registry import QUERIES

FOLDER = "/root/testdata/sf0.001"


def brute(rows):
    """(id, html) to what the contract says."""
    raw = [(i, (h or "").encode()) for i, h in rows]
    first = {}
    for i, p in raw:
        first[p] = min((x for x in (first.get(p), i) if x is not None), default=None)
    out = []
    for i, p in raw:
        again = i != first[p]
        digest = base64.b32encode(hashlib.sha1(p).digest()).decode()
        out.append((i, len(p), digest, "revisit" if again else "response", first[p] if again else None))
    return sorted(map(str, out))


def test_whole_query(spark):
    rows = [(r.page_id, r.html) for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()]
    assert sorted(str(tuple(r)) for r in QUERIES["op1_warc"](spark, FOLDER).collect()) == brute(rows)


ROWS = [(1, "a\r\n\r\nb\r\n\r\n"), (2, None), (3, ""), (4, "é😀\x00"), (5, "x" * 3_000_000), (7, "a\r\n\r\nb\r\n\r\n"), (None, ""), (None, "q"), (3, "")]
ROWS += [(9, "WARC/1.1\r\nContent-Length: 3\r\n\r\n"), (0, "x" * 3_000_000)]


def frame(spark, rows):
    return spark.createDataFrame([(i, "http://a/\r\nX: y" if i == 4 else None, h, 1) for i, h in rows], "page_id bigint, url string, html string, offset int")


def test_edges(spark, monkeypatch):
    monkeypatch.setattr(warc, "RECORDS", 3)
    got = warc.archived(frame(spark, ROWS))
    assert sorted(str(tuple(r)[:5]) for r in got.collect()) == brute(ROWS)
    assert warc.archived(frame(spark, []).limit(0)).count() == 0


def test_archives_are_whole(spark, tmp_path):
    warc.write_archives(frame(spark, ROWS).coalesce(1), f"{tmp_path}/streams")
    streams = sorted(Path(tmp_path, "streams").glob("*.gz"))
    archives = warc.normalise(spark, f"{tmp_path}/streams", f"{tmp_path}/archives")
    [row] = archives.collect()
    assert row.n == len(ROWS) and len(streams) == 1
    plain = gzip.decompress(streams[0].read_bytes())
    assert gzip.decompress(Path(row.archive).read_bytes()) == plain
    index = [line.split(" ") for line in Path(f"{row.archive}.idx").read_text().splitlines()]
    data = Path(row.archive).read_bytes()
    assert sum(int(n) for _, n, *_ in index) == len(data)
    for at, n, kind, _ in index:
        member = gzip.decompress(data[int(at) : int(at) + int(n)])
        assert member.startswith(b"WARC/1.1\r\n") and member.endswith(b"\r\n\r\n") and kind == "response"
    read = {(r.id, bytes(r.payload)) for r in warc.read_archives(archives, f"{tmp_path}/archives").collect()}
    assert read == {(str(i) if i is not None else "", (h or "").encode()) for i, h in ROWS}
    # Normalising what is normal changes nothing but the file's name.
    again = warc.normalise(spark, f"{tmp_path}/archives", f"{tmp_path}/again").collect()
    assert gzip.decompress(Path(again[0].archive).read_bytes()) == plain


def test_broken_streams():
    whole = gzip.compress(b"WARC/1.1\r\nContent-Length: 2\r\n\r\nab\r\n\r\n")
    assert [w[-6:] for _, w in warc.split_records(warc.inflated(io.BytesIO(whole * 2)))] == [b"ab\r\n\r\n"] * 2
    for bad in (whole[:-12], gzip.compress(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nab\r\n\r\n"), gzip.compress(b"HTTP\r\n\r\n")):
        with pytest.raises(ValueError):
            list(warc.split_records(warc.inflated(io.BytesIO(bad))))


def test_copies_are_written_as_revisits(spark, tmp_path):
    warc.write_archives(frame(spark, ROWS).coalesce(1), f"{tmp_path}/streams", revisits=True)
    archives = warc.normalise(spark, f"{tmp_path}/streams", f"{tmp_path}/archives")
    [row] = archives.collect()
    data = Path(row.archive).read_bytes()
    got = []
    for line in Path(f"{row.archive}.idx").read_text().splitlines():
        at, n, kind, name = line.split(" ")
        member = gzip.decompress(data[int(at) : int(at) + int(n)])
        head, http, body = member.split(b"\r\n\r\n", 2)
        assert f"WARC-Type: {kind}\r\n".encode() in head and f"WARC-Record-ID: {name}".encode() in head
        # The block is as long as its header says.
        size = next(int(h[15:]) for h in head.split(b"\r\n") if h.startswith(b"Content-Length:"))
        assert len(http) + 4 + len(body) - 4 == size
        refers = [h[16:].decode() for h in head.split(b"\r\n") if h.startswith(b"WARC-Refers-To: ")]
        if kind == "revisit":
            assert body == b"\r\n\r\n" and b"WARC-Profile: http" in head and b"WARC-Payload-Digest: sha1:" in head and refers
        else:
            assert not refers
        got.append((name, kind, refers))
    assert ("<urn:page:7>", "revisit", ["<urn:page:1>"]) in got and ("<urn:page:5>", "revisit", ["<urn:page:0>"]) in got
    assert sum(kind == "revisit" for _, kind, _ in got) == 5 and len(data) < 20_000
    records = warc.read_archives(archives, f"{tmp_path}/archives")
    assert {r.payload is None for r in records.where("record_type = 'revisit'").collect()} == {True}
    whole = [(r.id, bytes(r.payload)) for r in warc.with_payloads(records).collect()]
    assert sorted(whole) == sorted((str(i) if i is not None else "", (h or "").encode()) for i, h in ROWS)


def test_digest_is_that_of_the_payload(spark):
    texts = ["", "a", "é😀\x00", "x" * 100_000]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", warc.digest(warc.F.col("t")).alias("d")).collect()
    assert all(r.d == base64.b32encode(hashlib.sha1(r.t.encode()).digest()).decode() for r in got)
    member = gzip.compress(b"WARC/1.1\r\nWARC-Payload-Digest: sha1:AA\r\nContent-Length: 2\r\n\r\nab\r\n\r\n")
    with pytest.raises(ValueError):
        warc.described(member)
