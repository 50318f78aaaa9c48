import base64
import hashlib

from spanforge.llm.warc import read_warc, warc_round_trip, write_warc

MAGIC = "WARC/1.1\r\n"
SCHEMA = "page_id long, url string, html string, type string"


def pages():
    fake = f"{MAGIC}WARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    return [
        (1, "http://a/", "plain"), (2, "http://b/\r\nX: y", "plain"), (3, None, None), (4, "u", ""),
        (5, "u", fake), (6, "u", "text\r\n\r\n" + fake * 3 + "\r\n\r\nWARC/1.1"), (7, "u", "WARC/1.1"),
        (8, "u", "é" * 5000), (9, "u", MAGIC * 4), (10, "u", "plain"), (11, "u", "\r\n\r\n"), (None, "u", "no id"),
    ]


def brute(rows):
    data = {i: (h or "").encode() for i, _, h in rows}
    out = set()
    for i, payload in data.items():
        holder = max((j for j, p in data.items() if p == payload and j is not None), default=None)
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        out.add((i, len(payload), digest, "response" if i == holder else "revisit", None if i == holder else holder))
    return out


def test_round_trip_with_magic_lines_in_payloads(spark, tmp_path):
    rows = pages()
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA).repartition(2)
    for n, split in enumerate(("128m", "64b", "300b")):
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        try:
            got = warc_round_trip(df, str(tmp_path / f"w{n}")).collect()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert {tuple(r) for r in got} == brute(rows)
        assert len(got) == len(rows)


def test_payloads_come_back_whole_and_compressed_files_are_read(spark, tmp_path):
    rows = [r for r in pages() if r[0] in (5, 6, 8, 9)]
    df = spark.createDataFrame([(*r, "") for r in rows], SCHEMA).coalesce(1)
    write_warc(df, str(tmp_path / "z"), compression="gzip")
    got = read_warc(spark, str(tmp_path / "z"), payloads=True)
    assert {r.record_id: bytes(r.payload) for r in got.collect()} == {f"<urn:page:{i}>": h.encode() for i, _, h in rows}


def test_no_pages(spark, tmp_path):
    df = spark.createDataFrame([], SCHEMA)
    assert warc_round_trip(df, str(tmp_path / "none")).count() == 0


def test_archives_of_version_1_0_and_broken_chains(spark, tmp_path):
    record = lambda i, body, n=None, v="1.0": (
        f"WARC/{v}\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{i}>\r\nContent-Length: {len(body) if n is None else n}\r\n\r\n{body}\r\n\r\n")
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "old.warc").write_bytes((record(1, "one WARC/1.2 and WARC/1.0\r\nx") + record(2, "two", v="1.1") + record(3, "")).encode())
    (tmp_path / "a" / "broken.warc").write_bytes((record(4, "four") + record(5, "five", n=99) + record(6, "six")).encode())
    (tmp_path / "a" / "other.txt").write_bytes(b"no archive, WARC/1.0\r\nContent-Length: 0\r\n\r\n")
    got = {r.record_id: bytes(r.payload) for r in read_warc(spark, str(tmp_path / "a"), payloads=True).collect() if r.payload is not None}
    assert {k: v for k, v in got.items() if k[-2] in "1234"} == {
        "<urn:page:1>": b"one WARC/1.2 and WARC/1.0\r\nx", "<urn:page:2>": b"two", "<urn:page:3>": b"", "<urn:page:4>": b"four"}
    assert "<urn:page:6>" not in got


def test_clashing_columns_repeated_rows_and_very_long_pages(spark, tmp_path):
    long = ("<p>text " + MAGIC) * 40_000
    rows = [(1, "u", long, "a", 1), (1, "u", long, "b", 2), (2, "u", long[:-1], "c", 3), (3, "u", None, "d", 4)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, value string, size int")
    got = sorted(tuple(r)[:5] for r in warc_round_trip(df, str(tmp_path / "c")).collect())
    assert [(r[0], r[1], r[3]) for r in got] == [(1, len(long), "response"), (1, len(long), "response"), (2, len(long) - 1, "response"), (3, 0, "response")]
    assert got[0][2] == base64.b32encode(hashlib.sha1(long.encode()).digest()).decode()
