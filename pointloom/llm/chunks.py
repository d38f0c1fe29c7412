"""Chunks of documents: texts travel compressed, keyed by a digest of their content.

An operator that needs answers about pieces of many texts sends the pieces of a
chunk to buckets by hash and gets the answers back by chunk, so that texts
themselves are shuffled once, compressed, and nothing is gathered for a whole
corpus.  Two chunks with the same content share their key and their answers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pointloom.llm.frames import id_and_text, map_batches
from pointloom.llm.textkernel import SLICE_BYTES, Texts, slices

#: Text bytes of one chunk, about; large executors take larger chunks, for fewer repeated pieces.
CHUNK_BYTES = 8 << 20


def zipped(*arrays: np.ndarray) -> bytes:
    """Arrays in one compressed byte string."""
    body = b"".join(np.ascontiguousarray(a).view(np.uint8).tobytes() for a in arrays)
    head = np.array([len(body), *[a.nbytes for a in arrays]], np.int64).tobytes()
    return head + pa.compress(body, codec="zstd", asbytes=True)


def unzipped(blob: bytes, *kinds: type) -> list[np.ndarray]:
    head = np.frombuffer(blob, np.int64, len(kinds) + 1)
    body = pa.decompress(blob[8 * len(head) :], int(head[0]), codec="zstd", asbytes=True)
    at = np.concatenate([[0], np.cumsum(head[1:])])
    return [np.frombuffer(body[a:b], k) for a, b, k in zip(at[:-1], at[1:], kinds)]


def pack(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (chunk, blob): ids and texts of about ``chunk_bytes``, under a digest of them."""

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        for lo, texts in slices(batch["text"], chunk_bytes):
            own = batch["doc_id"].slice(lo, len(texts))
            blob = zipped(np.asarray(own.fill_null(0), np.int64), own.is_null().to_numpy(zero_copy_only=False).astype(np.uint8), texts.offsets, texts.data)
            yield {"chunk": [int.from_bytes(hashlib.blake2b(blob, digest_size=8).digest(), "little", signed=True)], "blob": [blob]}

    return map_batches(id_and_text(docs, id_col, text_col), run, "chunk long, blob binary")


def opened(blob: bytes) -> tuple[np.ndarray, np.ndarray, Texts]:
    """Ids, whether an id is null, and texts of a chunk."""
    ids, null, offsets, data = unzipped(blob, np.int64, np.uint8, np.int64, np.uint8)
    return ids, null, Texts(data, offsets)


def id_array(ids: np.ndarray, null: np.ndarray) -> pa.Array:
    return pa.array(ids, mask=null.astype(bool))


def parts(texts: Texts, limit: int = SLICE_BYTES) -> Iterator[tuple[int, Texts]]:
    """The texts of a chunk in slices that numpy passes can hold."""
    return slices(pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(texts.offsets), pa.py_buffer(texts.data)), limit)


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of a hash; ascending hashes have ascending buckets."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
