import hashlib
import struct
from collections import defaultdict

import pytest
import zstandard
from pyspark.sql import functions as F

from pointloom.llm import warc as A

SCHEMA = "page_id long, url string, html string, digest string, n int, tied int"
COLUMNS = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def brute(rows):
    groups = defaultdict(list)
    for i, _, h in rows:
        groups[(h or "").encode()].append(i)
    out = []
    for payload, ids in groups.items():
        ids = sorted(ids, key=lambda i: (i is None, i))
        for k, i in enumerate(ids):
            again = k > 0 and len(payload) >= 100
            out.append((i, len(payload), hashlib.sha256(payload).hexdigest(), "revisit" if again else "response", ids[0] if again else None))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


EDGES = [
    (1, "http://a/1", "<p>" + "x" * 200), (2, "http://a/2", "<p>" + "x" * 200), (2, "http://a/2", "<p>" + "x" * 200), (0, None, "<p>" + "x" * 200), (None, "u", "<p>" + "x" * 200),
    (3, "http://b/ü\r\nX-Page-ID: 9", None), (4, "", ""), (5, "http://c", "short"), (6, "http://c", "short"), (6, "http://c", "short"),
    (7, "t", "tie" * 50), (7, "s", "tie" * 50), (7, "s", "tie" * 50), (7, None, "tie" * 50), (9, "s", "tie" * 50),
    (None, "q", "null" * 50), (None, "q", "null" * 50), (None, "r", "alone" * 50),
    (10, "http://crlf", "a\r\n\r\nb\r\n" * 40), (11, "http://sep", A.EMPTY_FRAME.decode() * 30), (12, "http://long", "long text é 漢 " * 300_000), (13, "e", "y" * 100), (14, "e", "y" * 100), (15, "e", "y" * 99), (16, "e", "y" * 99),
]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "d", 1, 2) for r in rows], SCHEMA)


@pytest.mark.parametrize("parts", (1, 5))
def test_edges_come_back(spark, parts):
    assert got(A.archived(frame(spark, EDGES).repartition(parts))) == brute(EDGES)


def test_all_pages_come_back(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    rows = [(r.page_id, r.url, r.html) for r in pages.select("page_id", "url", "html").collect()]
    copies = [(i + 10**6, u, h) for i, u, h in rows[::3]]
    assert got(A.archived(pages.select("page_id", "url", "html").unionAll(spark.createDataFrame(copies, "page_id long, url string, html string")))) == brute(rows + copies)


def test_many_rows_that_repeat_the_first_id(spark):
    rows = [(1, f"u{i % 3}", "same " * 30) for i in range(2 * A.RUN + 50)]
    assert got(A.archived(frame(spark, rows))) == brute(rows)


def test_empty_table(spark):
    assert A.archived(frame(spark, [])).collect() == []


def test_files_are_archives(spark, small, tmp_path):
    """Files hold their dictionary first, each record is a frame that plain Zstandard opens with it, and names agree."""
    pages = spark.read.parquet(f"{small}/pages.parquet").limit(300)
    typed = A.with_types(pages.unionAll(pages.select((F.col("page_id") + 10**6).alias("page_id"), "url", "html").where("page_id % 2 = 0")))
    A.write_archives(typed, f"file://{tmp_path}/out", archive_bytes=30_000)
    files = sorted((tmp_path / "out").glob("part-*"))
    assert len(files) > 2
    names, refers, plain, packed, trained = [], [], 0, 0, 0
    for f in files:
        content = f.read_bytes()
        assert content.endswith(A.EMPTY_FRAME)
        magic, size = struct.unpack_from("<II", content)
        opener, rest = zstandard.ZstdDecompressor(), content
        if magic == A.DICTIONARY_FRAME:
            opener, rest = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content[8 : 8 + size])), content[8 + size :]
            trained += 1
        else:  # the last archive of a task may have few records
            assert len(list(A.frames(content))) < 12
        kinds = []
        for record in A.frames(content):
            head, body = A.parsed(record)
            assert body[int(head["content-length"]) :] == b"\r\n\r\n"
            one = opener.decompressobj()
            assert one.decompress(rest) == record
            plain, packed, rest = plain + len(record), packed + len(rest) - len(one.unused_data), one.unused_data
            kinds.append(head["warc-type"])
            names.append(head["warc-record-id"])
            refers += [head["warc-refers-to"]] if "warc-refers-to" in head else []
        assert kinds[0] == "warcinfo" and set(kinds[1:]) <= {"response", "revisit"} and rest == A.EMPTY_FRAME
    assert len(set(names)) == len(names) and set(refers) <= set(names) and refers and packed < plain / 2 and trained > 2


def test_a_dictionary_helps():
    records = [A.record(i, f"http://h{i % 7}/x", (f"<html><head><title>t{i}</title><meta charset=utf-8></head><body class=page>{i * 7919 % 1000}</body></html>").encode(), 99, f"{i:064x}", "response", None, "") for i in range(2000)]
    alone = sum(len(zstandard.ZstdCompressor(level=A.LEVEL).compress(r)) for r in records)
    assert len(A.archive(records)) < alone / 2
    assert list(A.frames(A.archive(records)))[1:] == records and list(A.frames(A.archive(records[:1])))[1:] == records[:1]
    assert A.dictionary(records[:1]) is None


def test_a_changed_payload_is_noticed(spark, tmp_path):
    bad = A.record(1, "u", b"payload", 7, hashlib.sha256(b"other").hexdigest(), "response", None, "")
    (tmp_path / "a").write_bytes(A.archive([bad]))
    with pytest.raises(Exception, match="differs from its digest"):
        A.read_archives(spark, f"file://{tmp_path}").collect()
