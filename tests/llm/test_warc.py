import base64
import gzip
import hashlib
from pathlib import Path

from tablewash.llm import warc

SCHEMA = "page_id bigint, url string, html string, page string, digest string, record_id string"


def pages():
    html = [("a", "<p>one</p>"), ("b", "<p>two</p>"), ("c", "<p>one</p>"), (None, "<p>one</p>"), ("e", ""), ("f", None),
            ("g", "é\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n"), ("h x\ny", "x" * 200_000), ("i", "x" * 200_000), ("k", "\n")]
    return [(i, u, h, "x", "y", "z") for i, (u, h) in enumerate(html, 10)]


def wanted(rows, min_bytes=0):
    first, out = {}, []
    for i, _, h, *_ in sorted(rows):
        raw = (h or "").encode()
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        of = first.setdefault(raw, i) if len(raw) >= min_bytes else i
        out.append((i, len(raw), digest, "response" if of == i else "revisit", None if of == i else of))
    return out


def test_like_brute_force(spark):
    rows = pages()
    for min_bytes in (0, 20):
        got = warc.archive_and_deduplicate(spark.createDataFrame(rows, SCHEMA).repartition(3), min_bytes=min_bytes).collect()
        assert sorted((r.page, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == wanted(rows, min_bytes)


def test_repeated_rows_and_pages_without_id(spark):
    rows = [(None, "u", "same", "", "", ""), (5, "u", "same", "", "", ""), (5, "u", "same", "", "", ""), (None, None, None, "", "", "")]
    got = warc.archive_and_deduplicate(spark.createDataFrame(rows, SCHEMA)).collect()
    key = lambda r: (-1 if r[0] is None else r[0], r[1])
    assert sorted(((r.page, r.record_type, r.refers_to) for r in got), key=key) == [
        (None, "response", None), (None, "revisit", 5), (5, "response", None), (5, "revisit", 5)]


def test_files_hold_whole_payloads_once(spark, tmp_path):
    rows = pages()
    source, target = str(tmp_path / "a"), str(tmp_path / "b")
    warc.write_pages(spark.createDataFrame(rows, SCHEMA), source, "2024-01-01T00:00:00Z")
    warc.write_deduplicated(spark, source, target, "2024-02-02T00:00:00Z")
    text = b"".join(gzip.decompress(p.read_bytes()) for p in Path(target).glob("*.gz"))
    assert text.count(b"WARC-Type: revisit") == 4 and text.count(b"WARC-Profile: ") == 4
    assert text.count(b"x" * 200_000) == 1
    back = {r.page: bytes(__import__("zlib").decompress(r.payload)) for r in warc.read_archive(spark, target, with_payload=True).collect() if r.type == "response"}
    assert all(back[i] == (h or "").encode() for i, _, h, *_ in rows if i in back) and len(back) == 6
    # A deduplicated archive comes back unchanged from another pass.
    again = str(tmp_path / "c")
    warc.write_deduplicated(spark, target, again, "2024-03-03T00:00:00Z")
    assert sorted(r.type for r in warc.read_archive(spark, again).collect()) == ["response"] * 6 + ["revisit"] * 4


def test_empty_table(spark):
    assert warc.archive_and_deduplicate(spark.createDataFrame([], SCHEMA)).count() == 0
