"""Byte-level BPE over a corpus: every distinct word is encoded once.

Texts are cut into pre-tokens.  Rows travel in chunks, which are packed and
shuffled once: a chunk keeps its texts compressed, lists its distinct pre-tokens
once, and sends them, dealt over buckets by hash, to the tasks that encode words.
There a word of any number of chunks is merged once (a task that meets more than
``SEEN_WORDS`` words forgets and begins anew); the ids go back to the chunks that
asked, in the order in which they asked, and the chunk puts its documents together
by position.  So the shuffle carries distinct words of chunks instead of words of
documents, a very frequent word costs one entry for each chunk, and nothing about
the vocabulary of the corpus is held by the driver.  Questions are read as a stream,
so a task holds one batch of them and its words, however much it is sent.  A chunk
asks each bucket once at most, and never asks about more than its own words, so the
rows follow the number of chunks for any number of buckets.  Decoding looks the ids
up in the token-byte table, which is as large as the vocabulary and is broadcast.

Defined cases: null is the empty text and gives no ids; repeated rows are
encoded one by one; chunks with the same content share a key and get the same
answers; texts may come in any order; an empty table gives an empty result; columns other than id and text
are ignored.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.llm.chunks import CHUNK_BYTES, bucket_of, id_array, opened, pack, parts, unzipped, zipped
from pointloom.llm.frames import map_batches, shuffle_width
from pointloom.llm.textkernel import LEAD_BYTE, Texts, span_hashes

LETTER, NUMBER, OTHER, SPACE = 0, 1, 2, 3
#: Distinct words whose ids a task remembers.
SEEN_WORDS = 1_000_000
#: Endings that the public pattern splits off after an apostrophe (fixed values of that pattern).
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file with a base64 token and a rank on each line; read by the driver."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


@lru_cache(1)
def _classes() -> np.ndarray:
    """Class of every code point."""
    out = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, range(0x110000)))
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\p{White_Space}+", SPACE)):
        for m in regex.finditer(pattern, every):
            out[m.start() : m.end()] = kind
    return out


def pretoken_spans(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and pointer by document of the matches of the public byte-level pattern.

    A run of one class is a token; a space before a run of another class belongs to it; of several
    white-space characters before a run, all but the last are one token; an apostrophe of its own
    takes a contraction's letters.
    """
    data, offsets = texts.data, texts.offsets
    lead = np.flatnonzero(LEAD_BYTE[data])
    m = len(lead)
    if not m:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    b = data[lead].astype(np.int64)
    wide = np.flatnonzero(b >= 0x80)
    point = b.copy()
    if len(wide):
        padded = np.concatenate([data, np.zeros(4, np.uint8)])
        w, at = b[wide], lead[wide]
        c1, c2, c3 = ((padded[at + j] & 0x3F).astype(np.int64) for j in (1, 2, 3))
        point[wide] = np.where(w < 0xE0, (w & 0x1F) << 6 | c1, np.where(w < 0xF0, (w & 0x0F) << 12 | c1 << 6 | c2, (w & 0x07) << 18 | c1 << 12 | c2 << 6 | c3))
    kind = _classes()[point]
    first = np.zeros(m + 1, bool)  # first character of a document
    doc_at = np.searchsorted(lead, offsets)
    first[doc_at] = True
    change = np.ones(m, bool)
    change[1:] = kind[1:] != kind[:-1]
    run = np.flatnonzero(change | first[:-1])  # first character of each run
    run_end = np.append(run[1:], m)
    space = kind[run] == SPACE
    begin = np.zeros(m + 1, bool)
    # a run that is no white space begins at the single blank before it, or by itself
    plain = run[~space]
    blank = np.zeros(len(plain), bool)
    has = ~first[plain]
    blank[has] = point[plain[has] - 1] == 0x20
    begin[plain - blank] = True
    # white space before a run of the same document: all but the last, then the last where it is no blank
    gap, gap_end = run[space], run_end[space]
    inner = (gap_end < m) & ~first[gap_end]
    begin[gap[~inner | (gap_end - gap > 1)]] = True
    begin[gap_end[inner] - 1] = True
    # contractions
    mark = plain[(point[plain] == 0x27) & ~blank]
    if len(mark):
        mark = mark[(mark + 1 < m)]
        mark = mark[(kind[mark + 1] == LETTER) & ~first[mark + 1]]
        ahead = np.concatenate([point, [0, 0]])
        inside = np.concatenate([(kind == LETTER) & ~first[:-1], [False, False]])
        one, two = ahead[mark + 1], np.where(inside[mark + 2], ahead[mark + 2], 0)
        short = np.isin(one, [ord(c) for c in CONTRACTIONS if len(c) == 1])
        long = np.zeros(len(mark), bool)
        for c in CONTRACTIONS:
            if len(c) == 2:
                long |= (one == ord(c[0])) & (two == ord(c[1]))
        length = np.where(short, 1, np.where(long, 2, 0))
        mark, length = mark[length > 0], length[length > 0]
        begin[mark + 1] = False
        begin[np.minimum(mark + 1 + length, m)] = True
    begin[m] = False
    tokens = np.flatnonzero(begin[:m])
    starts = lead[tokens]
    ends = np.append(starts[1:], len(data))
    return starts, ends, np.searchsorted(starts, offsets)


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: merge the neighbours of lowest rank, leftmost first, until none has a rank."""
    known = ranks.get(word)
    if known is not None:
        return [known]
    parts = [word[i : i + 1] for i in range(len(word))]
    if len(parts) <= 48:
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]
    # long words: a heap of pairs over a linked list
    right = list(range(1, len(parts) + 1))
    left = list(range(-1, len(parts) - 1))
    heap: list[tuple[int, int, bytes]] = []

    def offer(i: int) -> None:
        if i >= 0 and right[i] < len(parts):
            pair = parts[i] + parts[right[i]]
            if pair in ranks:
                heapq.heappush(heap, (ranks[pair], i, pair))

    for i in range(len(parts) - 1):
        offer(i)
    while heap:
        _, i, pair = heapq.heappop(heap)
        j = right[i] if parts[i] else len(parts)
        if j >= len(parts) or not parts[i] or parts[i] + parts[j] != pair:
            continue
        parts[i], parts[j] = pair, b""
        right[i] = right[j]
        if right[j] < len(parts):
            left[right[j]] = i
        offer(left[i])
        offer(i)
    return [ranks[p] for p in parts if p]


def _distinct_words(texts: Texts) -> tuple[np.ndarray, list[bytes]]:
    """Hashes, ascending, and bytes of the distinct pre-tokens of a chunk."""
    hashes, words = [], []
    for _, part in parts(texts):
        starts, ends, _ = pretoken_spans(part)
        own, at = np.unique(span_hashes(part.data, starts, ends), return_index=True)
        body = part.data.tobytes()
        hashes.append(own)
        words += [body[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist())]
    if not hashes:
        return np.zeros(0, np.uint64), []
    own, at = np.unique(np.concatenate(hashes), return_index=True)
    return own, [words[i] for i in at.tolist()]


def encode(docs: DataFrame, ranks: dict[bytes, int], chunk_bytes: int = CHUNK_BYTES, buckets: int | None = None) -> DataFrame:
    """(doc_id, ids): token ids of every text as little-endian unsigned 32-bit integers."""
    spark = docs.sparkSession
    buckets = buckets or 2 * shuffle_width(spark)
    shared = spark.sparkContext.broadcast(ranks)
    # one shuffle, read for the questions and for the texts
    chunks = pack(docs, chunk_bytes).repartition("chunk")

    def words_of(batch: pa.RecordBatch) -> Iterator[dict]:
        for chunk, blob in zip(batch["chunk"].to_pylist(), batch["blob"].to_pylist()):
            hashes, words = _distinct_words(opened(blob)[2])
            edges = np.searchsorted(bucket_of(hashes, buckets), np.arange(buckets + 1))
            some = np.flatnonzero(np.diff(edges))
            rows = [words[edges[k] : edges[k + 1]] for k in some]
            yield {
                "bucket": pa.array(some, pa.int32()),
                "chunk": [chunk] * len(rows),
                "words": [zipped(np.array([len(w) for w in row], np.uint32), np.frombuffer(b"".join(row), np.uint8)) for row in rows],
            }

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, seen = shared.value, {}
        for batch in batches:
            blobs = []
            for blob in batch["words"]:
                lens, body = unzipped(blob.as_py(), np.uint32, np.uint8)
                body, ends = body.tobytes(), np.cumsum(lens, dtype=np.int64)
                ids = []
                for a, b in zip((ends - lens).tolist(), ends.tolist()):
                    word = body[a:b]
                    own = seen.get(word)
                    if own is None:
                        if len(seen) >= SEEN_WORDS:
                            seen.clear()
                        own = seen[word] = merge_word(word, ranks)
                    ids.append(own)
                flat = np.array([i for own in ids for i in own], np.uint32)
                blobs.append(zipped(np.array([len(own) for own in ids], np.uint32), flat))
            yield pa.RecordBatch.from_arrays([batch["chunk"], batch["bucket"], pa.array(blobs, pa.binary())], names=["chunk", "bucket", "ids"])

    asked = map_batches(chunks, words_of, "bucket int, chunk long, words binary")
    answers = asked.repartition("bucket").mapInArrow(answer, "chunk long, bucket int, ids binary")

    def assemble(key: tuple[pa.Scalar, ...], chunk: pa.Table, answers: pa.Table) -> pa.Table:
        first = {}  # chunks with the same content have asked the same: one answer for each bucket is enough
        for bucket, blob in zip(answers["bucket"].to_pylist(), answers["ids"]):
            first.setdefault(bucket, blob)
        lens, flat = [np.zeros(0, np.uint32)], [np.zeros(0, np.uint32)]
        for bucket in sorted(first):
            a, b = unzipped(first[bucket].as_py(), np.uint32, np.uint32)
            lens.append(a)
            flat.append(b)
        lens, flat = np.concatenate(lens).astype(np.int64), np.concatenate(flat)
        begin = np.cumsum(lens) - lens
        out = []
        hashes = None
        for blob in chunk["blob"]:
            ids, null, texts = opened(blob.as_py())
            spans, keys = [], []
            for lo, part in parts(texts):
                starts, ends, ptr = pretoken_spans(part)
                spans.append((lo, part, ptr))
                keys.append(span_hashes(part.data, starts, ends))
            if hashes is None:
                hashes = np.unique(np.concatenate([np.unique(k) for k in keys])) if keys else np.zeros(0, np.uint64)
                if len(hashes) != len(lens):
                    raise ValueError("the answers do not fit the words of the chunk")
            for (lo, part, ptr), own in zip(spans, keys):
                word = np.searchsorted(hashes, own)
                n = lens[word]
                first_id = np.cumsum(n) - n
                total = int(n.sum())
                stream = flat[np.arange(total) - np.repeat(first_id, n) + np.repeat(begin[word], n)]
                at = np.append(first_id, total)[ptr] * 4
                rows = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(part), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(stream.astype("<u4"))])
                out.append(pa.table({"doc_id": id_array(ids[lo : lo + len(part)], null[lo : lo + len(part)]), "ids": rows.cast(pa.binary())}))
        return pa.concat_tables(out) if out else pa.table({"doc_id": pa.array([], pa.int64()), "ids": pa.array([], pa.binary())})

    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(assemble, "doc_id long, ids binary")


def decode(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """``encoded`` with a column ``bytes``: the ids looked up in the token-byte table."""
    size = max(ranks.values(), default=-1) + 1
    tokens = [b""] * size
    for token, rank in ranks.items():
        tokens[rank] = token
    shared = encoded.sparkSession.sparkContext.broadcast((np.frombuffer(b"".join(tokens), np.uint8), np.array([len(t) for t in tokens], np.int64)))

    def look_up(batch: pa.RecordBatch) -> Iterator[dict]:
        flat, lens = shared.value
        begin = np.cumsum(lens) - lens
        column = batch["ids"].cast(pa.large_binary())
        _, offsets, data = column.buffers()
        offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        lo = 0
        while lo < len(column):  # some ids at a time
            hi = min(max(int(np.searchsorted(offsets, offsets[lo] + (1 << 20), side="right")) - 1, lo + 1), len(column))
            ids = data[offsets[lo] : offsets[hi]].view("<u4") if offsets[hi] > offsets[lo] else np.zeros(0, np.uint32)
            n = lens[ids]
            first = np.cumsum(n) - n
            total = int(n.sum())
            body = flat[np.arange(total) - np.repeat(first, n) + np.repeat(begin[ids], n)]
            at = np.append(first, total)[(offsets[lo : hi + 1] - offsets[lo]) // 4]
            rows = pa.LargeBinaryArray.from_buffers(pa.large_binary(), hi - lo, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(body)])
            yield {"doc_id": batch["doc_id"][lo:hi], "ids": batch["ids"][lo:hi], "bytes": rows.cast(pa.binary())}
            lo = hi

    return map_batches(encoded, look_up, "doc_id long, ids binary, bytes binary")


def digests(docs: DataFrame, ranks: dict[bytes, int], chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and of decoded bytes."""
    return decode(encode(docs, ranks, chunk_bytes), ranks).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )
