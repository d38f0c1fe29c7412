"""WARC archives of pages, each record a Zstandard frame of its own under the archive's dictionary.

An archive is a file: a skippable frame that holds a dictionary trained on the
archive's own records, a record ``warcinfo``, and the records of pages, each
compressed by itself, so that one can be read without the others.  Of the pages
with equal payloads the one of smallest id is stored as a response; the others
are revisits, with the headers of the answer but without the payload.

Pages are shuffled once, by payload digest; what tells first pages from others
is one slim row for a payload that comes again, and a hot payload is a skewed
join that Spark splits.  Rows that repeat a first id with its payload are counted
apart, where there are any, before one of them is chosen.  Spark's text sink writes the files: a row is an archive,
and the separator after a row is an empty skippable frame, which readers of
Zstandard pass over.  So files appear when the write is committed, on any file
system that Spark reaches, and tasks that are lost or run twice leave nothing.

Defined cases: a null html is an empty payload; payloads under ``LEAST`` bytes are
responses even where they repeat; a null id counts as larger than any other, and
its revisits refer to null; of rows that repeat a first id with its payload one is the
response and the others revisit it; a null url gives ``about:blank``; characters that a
header cannot hold are percent-encoded there; a record longer than an archive
has one to itself; with too few records to train on, an archive has no
dictionary; an empty table gives no archive and an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.llm.frames import checkpointed, map_batches, shared_folder

#: Payload bytes from which equal payloads are stored once.
LEAST = 100
#: Bytes of the records of one archive before compression, about, and of its dictionary.
ARCHIVE_BYTES, DICTIONARY_BYTES = 16 << 20, 64 << 10
#: Bytes of records that a dictionary is trained on, spread over the archive, and of one of them, at most.
TRAIN_BYTES, TRAIN_RECORD = 4 << 20, 64 << 10
LEVEL = 3
#: Rows that repeat an id with its payload, of one task.
RUN = 1000
#: Payloads whose first id repeats, of some 100 bytes each, that are broadcast at most; more are joined by a shuffle.
TIES = 100_000
#: The time of all records: runs over the same pages write the same records.
DATE = "2026-01-01T00:00:00Z"

# Fixed values of the formats.
DICTIONARY_FRAME = 0x184D2A5D
EMPTY_FRAME = struct.pack("<II", 0x184D2A50, 0)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def with_types(pages: DataFrame, least: int = LEAST, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, payload, bytes, digest, record_type, refers_to) for each page; one response of each payload of ``least`` bytes.

    ``payload`` is null for revisits; ``bytes`` and ``digest`` are those of the whole payload for all.
    """
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload")).withColumns({"digest": F.sha2("payload", 256), "bytes": F.octet_length("payload").cast("long")})
    # slim rows: of payloads that come again, the smallest id and how many rows have it; nulls are the largest id
    ids = base.where(F.col("bytes") >= least).groupBy("digest", "page_id").agg(F.count("*").alias("n"))
    smallest = F.min(F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", "n"))
    again = checkpointed(ids.groupBy("digest").agg(F.sum("n").alias("n"), smallest.alias("first")).where("n > 1").select(F.col("digest").alias("_key"), F.col("first.page_id").alias("first_id"), F.col("first.n").alias("tied")))
    # short payloads get keys of their rows, so that a hot one is no key of the join
    key = F.when(F.col("bytes") >= least, F.col("digest")).otherwise(F.concat(F.lit("short "), F.xxhash64("page_id", "url").cast("string")))
    base = base.withColumn("_key", key)
    is_first = F.col("page_id").eqNullSafe(F.col("first_id"))

    def typed(df: DataFrame, first: Column) -> DataFrame:
        known = df.withColumn("_first", first)
        kept = F.when(F.col("_first"), F.col("payload")).alias("payload")
        return known.select("page_id", "url", kept, "bytes", "digest", F.when(F.col("_first"), "response").otherwise("revisit").alias("record_type"), F.when(~F.col("_first"), F.col("first_id")).alias("refers_to"))

    once = base.join(again, "_key", "left")
    once = typed(once.where(F.col("tied").isNull() | ~is_first | (F.col("tied") == 1)), F.col("tied").isNull() | is_first)
    ties = again.where("tied > 1")
    known = ties.count()
    if not known:
        return once
    # rows that repeat the first id with its payload: the first of them by url is the response
    tied = base.join(F.broadcast(ties) if known <= TIES else ties, "_key").where(is_first).groupBy("page_id", "digest", "url", "bytes").agg(F.count("*").alias("n"), F.first("payload").alias("payload"))
    urls = tied.groupBy("digest").agg(F.min(F.struct(F.col("url").isNull().alias("no_url"), "url"))["url"].alias("first_url"))
    runs = tied.join(urls, "digest").withColumn("first_id", F.col("page_id")).select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / RUN))).alias("run"))
    runs = runs.withColumn("payload", F.when(F.col("run") == 0, F.col("payload"))).repartition("digest", "run")
    turns = F.sequence(F.col("run") * RUN, F.least(F.col("n"), (F.col("run") + 1) * RUN) - 1)
    return once.unionAll(typed(runs.select("*", F.explode(turns).alias("turn")), (F.col("turn") == 0) & F.col("url").eqNullSafe(F.col("first_url"))))


def _headers(*lines: tuple[str, object]) -> bytes:
    return ("\r\n".join(["WARC/1.1", *(f"{k}: {v}" for k, v in lines)]) + "\r\n\r\n").encode()


def response_id(page_id: int | None, digest: str) -> str:
    """The name that revisits of a payload know its response by."""
    return f"<urn:page:{'' if page_id is None else page_id}:{digest}>"


def record(page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, record_type: str, refers_to: int | None, named: str) -> bytes:
    """One record; ``named`` is a part of the name of records that no other refers to."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + payload if record_type == "response" else http
    own = response_id(page_id, digest)
    lines = [("WARC-Type", record_type), ("WARC-Record-ID", own if named == "" else f"{own[:-1]}:{named}>"), ("WARC-Date", DATE), ("WARC-Target-URI", quote(url, safe=":/?#[]@!$&'()*+,;=%~") if url else "about:blank")]
    if page_id is not None:
        lines.append(("X-Page-ID", page_id))
    lines.append(("WARC-Payload-Digest", f"sha256:{digest}"))
    if record_type == "revisit":
        lines += [("WARC-Profile", PROFILE), ("WARC-Refers-To", response_id(refers_to, digest))]
    lines += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    return _headers(*lines) + block + b"\r\n\r\n"


def dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """A dictionary of records spread evenly over the archive; None where they are too few to train on."""
    sizes = [min(len(r), TRAIN_RECORD) for r in records]
    step = max(1, -(-sum(sizes) // TRAIN_BYTES))
    samples = [r[:TRAIN_RECORD] for r in records[::step]]
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, sum(map(len, samples)) // 10)), samples, k=256, d=8)
    except zstandard.ZstdError:
        return None


def archive(records: list[bytes]) -> bytes:
    """The bytes of an archive of records."""
    trained = dictionary(records)
    packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=trained)
    head = b""
    if trained is not None:
        body = trained.as_bytes()
        head = struct.pack("<II", DICTIONARY_FRAME, len(body)) + body
    about = b"software: pointloom\r\nformat: WARC File Format 1.1\r\n"
    info = _headers(("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:archive:{hashlib.sha256(b''.join(records)).hexdigest()}>"), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields"), ("Content-Length", len(about)))
    return head + b"".join(packer.compress(r) for r in [info + about + b"\r\n\r\n", *records])


def archives(typed: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """(content) of archives, as rows of ``with_types`` come in tasks; a task holds one archive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, count, task = [], 0, 0, TaskContext.get().partitionId()
        made = lambda: pa.RecordBatch.from_pydict({"content": pa.array([archive(held)], pa.binary())})
        for batch in batches:
            for row in zip(*(batch[c] for c in ("page_id", "url", "payload", "bytes", "digest", "record_type", "refers_to", "_first"))):
                *values, first = (v.as_py() for v in row)
                count += 1
                own = record(*values, "" if first else f"{task}-{count}")
                if held and size + len(own) > archive_bytes:
                    yield made()
                    held, size = [], 0
                held.append(own)
                size += len(own)
        if held:
            yield made()

    # short payloads may repeat with an id: their records are named by task and place, too
    first = (F.col("record_type") == "response") & (F.col("bytes") >= LEAST)
    return typed.withColumn("_first", first).mapInArrow(run, "content binary")


def write_archives(typed: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """A file for each archive in a new folder, by Spark's text sink: the bytes of a row, then an empty frame."""
    rows = archives(typed, archive_bytes).select(F.col("content").cast("string").alias("value"))
    rows.write.option("maxRecordsPerFile", 1).option("lineSep", EMPTY_FRAME.decode("ascii")).text(folder)


def frames(content: bytes) -> Iterator[bytes]:
    """The records of an archive, frame after frame, under the dictionary of its leading skippable frame."""
    view, at, unpacker = memoryview(content), 0, zstandard.ZstdDecompressor()
    while at < len(content):
        (magic,) = struct.unpack_from("<I", content, at)
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            (size,) = struct.unpack_from("<I", content, at + 4)
            if magic == DICTIONARY_FRAME:
                unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content[at + 8 : at + 8 + size]))
            at += 8 + size
            continue
        one = unpacker.decompressobj()
        yield one.decompress(view[at:])
        at = len(content) - len(one.unused_data)


def parsed(block: bytes) -> tuple[dict[str, str], bytes]:
    """Headers by lower-case name, and what follows them."""
    head, _, rest = block.partition(b"\r\n\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode().split("\r\n")[1:])}, rest


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, archive string"


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each response and revisit in a folder's archives; a response's payload has to have its digest."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "content")

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        for path, content in zip(batch["path"].to_pylist(), batch["content"]):
            out: dict[str, list] = {k: [] for k in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")}
            for content_of in frames(content.as_py()):
                head, rest = parsed(content_of)
                if head["warc-type"] not in ("response", "revisit"):
                    continue
                block = rest[: int(head["content-length"])]
                http, payload = parsed(block)
                digest = head["warc-payload-digest"].removeprefix("sha256:")
                if head["warc-type"] == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != int(http["content-length"])):
                    raise ValueError(f"{path}: a payload differs from its digest")
                before = head.get("warc-refers-to", "<urn:page::>").split(":")[2]
                for k, v in zip(out, (int(head["x-page-id"]) if "x-page-id" in head else None, int(http["content-length"]), digest, head["warc-type"], int(before) if before else None, head["warc-target-uri"])):
                    out[k].append(v)
            yield out | {"archive": [path] * len(out["url"])}

    # files are large rows: a few at a time in a batch
    return map_batches(files, run, READ)


def archived(pages: DataFrame, folder: str | None = None, least: int = LEAST) -> DataFrame:
    """Archives of ``pages`` in ``folder`` (a new one in the shared folder), and what reading them back gives."""
    folder = folder or f"{shared_folder(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    write_archives(with_types(pages, least), folder)
    return read_archives(pages.sparkSession, folder)


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, row_number() OVER (PARTITION BY payload_digest ORDER BY page_id NULLS LAST) AS turn, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes < 100 OR turn = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN payload_bytes >= 100 AND turn > 1 THEN first_id END AS refers_to FROM f
"""
