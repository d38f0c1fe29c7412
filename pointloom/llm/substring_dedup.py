"""Substring dedup: windows of 50 words that an earlier document holds are removed.

Every window of every text gets Rabin-Karp hashes.  Counting all of them in one
shuffle would move more bytes than the texts have, so windows are counted by
units first.  The anchor of a window is its phrase of 25 words with the smallest
hash; equal windows have equal anchors, and the windows of one anchor follow each
other: together they are a unit, about thirteen windows.

1. Units are counted by anchor: document and hash of the words that the unit spans.
   An anchor of one document is settled, as no other document has its windows.
2. Where all units of an anchor agree, all but the smallest document lose them.  Where
   they differ (at the ends of shared passages) all but the smallest document of each
   distinct unit lose it, and the windows of those smallest documents are counted
   one by one.
3. What a document loses goes back to it by its id, and removed windows merge into
   maximal intervals of words.

All steps are aggregations with partial results and joins on keys, one row for a unit,
so a passage of a third of all documents is counted like any other and nothing is held
whole but a document.  A unit is known by two hashes of 64 bits, and so is a window:
among the 10**13 windows of 100 TB two different ones agree with probability 10**-13.

Defined cases: a word is a run of anything but ASCII white space; null is the
empty text; a text of fewer than ``window`` words is never touched; documents
with the same id do not remove each other's words; a null id is never smaller
than another, and its document stays whole; an empty table gives an empty
result; other columns are carried by ``remove_repeats`` and ignored otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from pointloom.llm.frames import as_batch, checkpointed, id_and_text, map_batches
from pointloom.llm.textkernel import Texts, Words, gram_starts, mix64, slices, sums_by

WINDOW = 50
#: Base of each of the two polynomials, and what sets the word hashes of the second apart from those of the first.
_BASES = (0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F)
_APART = np.uint64(0x5851F42D4C957F2D)


class Polynomial:
    """Rabin-Karp hashes of runs of words, from prefix sums of a polynomial modulo 2**64."""

    def __init__(self, hashes: np.ndarray, which: int) -> None:
        base, n = _BASES[which], len(hashes)
        powers, self.back = np.empty(n, np.uint64), np.empty(n, np.uint64)
        for out, b in ((powers, base), (self.back, pow(base, -1, 1 << 64))):
            out[:1], out[1:] = 1, np.uint64(b)
            np.multiply.accumulate(out, out=out)
        own = hashes if which == 0 else mix64(hashes ^ _APART)
        self.prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(own * powers, dtype=np.uint64)])

    def of(self, starts: np.ndarray, lens: np.ndarray | int) -> np.ndarray:
        if not len(starts):
            return np.zeros(0, np.uint64)
        return mix64((self.prefix[starts + lens] - self.prefix[starts]) * self.back[starts] + np.asarray(lens).astype(np.uint64))


def first_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the first smallest of the values from each place on; the last width - 1 places are left out."""
    place, step = np.arange(len(values)), 1
    while step < width:  # the minimum of twice as many, or of what is left to the width
        ahead = min(step, width - step)
        near, far = place[: len(place) - ahead], place[ahead:]
        place = np.where(values[far] < values[near], far, near)
        step += ahead
    return place


@dataclass
class Units:
    """Windows of a slice of texts, and the units that they fall into."""

    words: Words
    k: int
    starts: np.ndarray  # first word of each window
    ptr: np.ndarray  # windows of unit i: ptr[i] up to ptr[i + 1]
    doc: np.ndarray  # document of each unit
    anchors: np.ndarray
    hashes: np.ndarray

    @classmethod
    def of(cls, texts: Texts, k: int) -> Units:
        words = texts.words()
        starts = gram_starts(words.ptr, k)
        none = np.zeros(0, np.uint64)
        if not len(starts):
            return cls(words, k, starts, np.zeros(1, np.int64), np.zeros(0, np.int64), none, none)
        h = words.hashes()
        phrase = max(1, k // 2)
        phrases = Polynomial(h, 0).of(np.arange(len(h) - phrase + 1), phrase)
        anchor = first_minimum(phrases, k - phrase + 1)[starts]
        first = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
        ptr = np.append(first, len(starts))
        begin, end = starts[first], starts[ptr[1:] - 1] + k
        return cls(words, k, starts, ptr, np.searchsorted(words.ptr, begin, side="right") - 1, phrases[anchor[first]], Polynomial(h, 1).of(begin, end - begin))

    def keys(self) -> np.ndarray:
        return joined(self.anchors, self.hashes)

    def window_hashes(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Both hashes of some windows."""
        return tuple(Polynomial(self.words.hashes(), which).of(self.starts[windows], self.k) for which in (0, 1))

    def windows(self, units: np.ndarray) -> np.ndarray:
        """Windows of the units that are marked."""
        return np.flatnonzero(np.repeat(units, np.diff(self.ptr)))


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One number for two hashes, to find what they stand for again inside its document."""
    return mix64(a * np.uint64(_BASES[1]) + b)


def _marked(keys: np.ndarray, doc: np.ndarray, lists: pa.Array) -> np.ndarray:
    """Whether each key is in the list of its document; ``doc`` ascends."""
    out = np.zeros(len(keys), bool)
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    some = np.flatnonzero(sizes)
    for d, lo, hi in zip(some.tolist(), np.searchsorted(doc, some).tolist(), np.searchsorted(doc, some, side="right").tolist()):
        out[lo:hi] = np.isin(keys[lo:hi], lists[d].values.to_numpy().view(np.uint64))
    return out


def _units(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, anchor, unit) of every distinct unit of a document; among equal anchors, unit stands for the unit's hash."""

    def emit(batch: pa.RecordBatch) -> Iterator[dict]:
        for lo, texts in slices(batch["text"]):
            units = Units.of(texts, k)
            keys = units.keys()
            order = np.lexsort((keys, units.doc))
            new = np.ones(len(order), bool)
            new[1:] = (keys[order[1:]] != keys[order[:-1]]) | (units.doc[order[1:]] != units.doc[order[:-1]])
            own = order[new]
            yield {"doc_id": batch["doc_id"].take(pa.array(lo + units.doc[own])), "anchor": units.anchors[own].view(np.int64), "unit": keys[own].view(np.int64)}

    return map_batches(docs, emit, "doc_id long, anchor long, unit long")


def _windows(docs: DataFrame, opened: DataFrame, k: int) -> DataFrame:
    """(doc_id, h1, h2, window) of the windows in the units that ``opened`` (doc_id, keys) lists."""

    def emit(batch: pa.RecordBatch) -> Iterator[dict]:
        batch = batch.filter(batch["keys"].is_valid())
        for lo, texts in slices(batch["text"]):
            units = Units.of(texts, k)
            asked = _marked(units.keys(), units.doc, batch["keys"].slice(lo, len(texts)))
            at = units.windows(asked)
            doc = np.repeat(units.doc, np.diff(units.ptr))[at]
            h1, h2 = units.window_hashes(at)
            yield {"doc_id": batch["doc_id"].take(pa.array(lo + doc)), "h1": h1.view(np.int64), "h2": h2.view(np.int64), "window": joined(h1, h2).view(np.int64)}

    # the join of the result, too, is one of all documents with a list: both read one shuffle of the texts
    return map_batches(docs.join(opened, "doc_id", "left"), emit, "doc_id long, h1 long, h2 long, window long")


def _repeats(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, units, windows): what each document loses, keys of units and of windows."""
    known = docs.where("doc_id IS NOT NULL AND text IS NOT NULL")
    units = _units(known, k)
    bounds = [F.min("doc_id").alias("first"), F.max("doc_id").alias("last")]
    shared = units.groupBy("anchor").agg(*bounds, F.min("unit").alias("low"), F.max("unit").alias("high")).where("first < last").select("anchor", "first", (F.col("low") != F.col("high")).alias("differ"))
    held = checkpointed(units.join(shared, "anchor"))
    plain = held.where("NOT differ AND doc_id > first").select("doc_id", "unit")
    differing = held.where("differ").select("doc_id", "anchor", "unit")
    firsts = differing.groupBy("anchor", "unit").agg(F.min("doc_id").alias("first"))
    later = differing.join(firsts, ["anchor", "unit"]).where("doc_id > first").select("doc_id", "unit")
    opened = firsts.groupBy(F.col("first").alias("doc_id")).agg(F.collect_list("unit").alias("keys"))
    windows = _windows(docs, opened, k)
    repeated = windows.groupBy("h1", "h2").agg(*bounds).where("first < last").select("h1", "h2", "first")
    gone = windows.join(repeated, ["h1", "h2"]).where("doc_id > first").select("doc_id", "window").distinct()
    none = F.lit(None).cast("long")
    every = plain.unionAll(later).select("doc_id", "unit", none.alias("window")).unionAll(gone.select("doc_id", none, "window"))
    return every.groupBy("doc_id").agg(F.collect_list("unit").alias("units"), F.collect_list("window").alias("windows"))


def _removed(texts: Texts, units: pa.Array, windows: pa.Array, k: int) -> tuple[Words, np.ndarray]:
    """Words of a slice of texts, and which of them go."""
    own = Units.of(texts, k)
    gone = np.repeat(_marked(own.keys(), own.doc, units), np.diff(own.ptr))
    doc = np.repeat(own.doc, np.diff(own.ptr))
    some = np.flatnonzero(windows.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)[doc] > 0)
    gone[some] |= _marked(joined(*own.window_hashes(some)), doc[some], windows)
    cover = np.zeros(len(own.words) + 1, np.int64)
    at = own.starts[gone]
    np.add.at(cover, at, 1)
    np.subtract.at(cover, at + k, 1)
    return own.words, np.cumsum(cover[:-1]) > 0


def _kept_texts(words: Words, gone: np.ndarray) -> pa.LargeBinaryArray:
    """By document, the words that are left, joined by one space."""
    n = len(words.ptr) - 1
    kept = np.flatnonzero(~gone)
    lens = words.ends[kept] - words.starts[kept] + 1  # with a space, then dropped after the last word of a document
    first = np.cumsum(lens) - lens
    total = int(lens.sum())
    at = np.arange(total) - np.repeat(first, lens) + np.repeat(words.starts[kept], lens)
    body = words.texts.data[np.minimum(at, max(0, len(words.texts.data) - 1))] if total else np.zeros(0, np.uint8)
    body = body.copy()
    body[first + lens - 1] = 0x20
    ptr = np.searchsorted(kept, words.ptr)
    begin = np.append(first, total)[ptr[:-1]]
    end = np.maximum(begin, np.append(first, total)[ptr[1:]] - 1)
    # LargeBinary needs adjacent values: the spaces between documents go out
    keep = np.ones(total, bool)
    keep[end[end > begin]] = False
    sizes = end - begin
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(np.append(0, np.cumsum(sizes)).astype(np.int64)), pa.py_buffer(body[keep])])


def _intervals(gone: np.ndarray, ptr: np.ndarray) -> list[list[int]]:
    """By document, begin and end of the maximal runs of removed words, one after another, counted in its words."""
    n = len(gone)
    edge = np.zeros(n + 1, bool)
    edge[ptr[:-1]] = True
    begin = np.flatnonzero(gone & (edge[:-1] | ~np.append(False, gone[:-1]))) if n else np.zeros(0, np.int64)
    end = np.flatnonzero(gone & (edge[1:] | ~np.append(gone[1:], False) | np.isin(np.arange(1, n + 1), ptr))) + 1 if n else begin
    doc = np.searchsorted(ptr, begin, side="right") - 1
    out: list[list[int]] = [[] for _ in range(len(ptr) - 1)]
    for i, a, b in zip(doc.tolist(), begin.tolist(), end.tolist()):
        out[i] += [a - int(ptr[i]), b - int(ptr[i])]
    return out


RESULT = "doc_id long, n_words long, n_removed long, kept_text binary, intervals array<long>"


def substring_dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text (binary, UTF-8) and the removed intervals [begin, end) in words, flattened."""
    known = id_and_text(docs)

    def assemble(batch: pa.RecordBatch) -> Iterator[dict]:
        for lo, texts in slices(batch["text"]):
            rows = slice(lo, lo + len(texts))
            words, gone = _removed(texts, batch["units"][rows], batch["windows"][rows], window)
            yield {
                "doc_id": batch["doc_id"][rows],
                "n_words": words.counts(),
                "n_removed": sums_by(gone, words.ptr),
                "kept_text": _kept_texts(words, gone).cast(pa.binary()),
                "intervals": pa.array(_intervals(gone, words.ptr), pa.list_(pa.int64())),
            }

    return map_batches(known.join(_repeats(known, window), "doc_id", "left"), assemble, RESULT)


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated words taken out of the text; a text with nothing to remove stays as it is.

    Columns and their order stay; a column ``n_chars`` is set to the length of a changed text.
    """
    names, schema = docs.columns, docs.schema
    repeats = _repeats(id_and_text(docs, id_col, text_col), window)
    # positions, not names, so that columns of ``docs`` may be called anything
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), *[F.col(c).alias(f"_{i}") for i, c in enumerate(names)])
    text_at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        for batch in batches:
            for lo, texts in slices(batch[f"_{text_at}"]):
                rows = slice(lo, lo + len(texts))
                words, gone = _removed(texts, batch["units"][rows], batch["windows"][rows], window)
                changed = pa.array(sums_by(gone, words.ptr) > 0)
                left = _kept_texts(words, gone).cast(pa.large_string())
                columns = {c: batch[f"_{i}"][rows] for i, c in enumerate(names)}
                columns[text_col] = pa.compute.if_else(changed, left, columns[text_col].cast(pa.large_string()))
                if "n_chars" in columns and pa.types.is_integer(columns["n_chars"].type):
                    columns["n_chars"] = pa.compute.if_else(changed, pa.compute.utf8_length(left), columns["n_chars"])
                yield as_batch({c: columns[c].cast(arrow.field(c).type) for c in names}, arrow)

    return source.join(repeats, "doc_id", "left").mapInArrow(run, schema)


def digests(docs: DataFrame) -> DataFrame:
    return substring_dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
windows AS (SELECT doc_id, p, array_to_string(words[p:p + 49], ' ') AS k FROM w, unnest(range(1, len(words) - 48)) t(p)),
firsts AS (SELECT k, min(doc_id) AS first FROM windows GROUP BY k),
gone AS (SELECT DISTINCT doc_id, p + o AS q FROM windows JOIN firsts USING (k), range(0, 50) t(o) WHERE doc_id > first),
placed AS (SELECT doc_id, q, words[q] AS word FROM w, unnest(range(1, len(words) + 1)) t(q)),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY q) AS text FROM placed ANTI JOIN gone USING (doc_id, q) GROUP BY doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""
