"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact similarity.

A benchmark item gives its multiset of 5-word shingles and a 64-bit SimHash of
them.  A window of a document has as many words as an item; a window without a
single shingle of an item has similarity 0 to it, so windows around shared shingles
are fingerprinted, and of these the ones with shared shingles enough for the
threshold.  The fingerprints are looked up in six tables over six blocks of bits: two
fingerprints that differ in at most RADIUS = 22 bits differ in at most three bits of
some block, so looking up every key within three bits finds all items within the
radius.  The tables alone say which items a window is compared with: each that they
find and that has the window's size is compared exactly, and the sum of smaller over
the sum of larger multiplicities decides.

Fingerprints of similar windows can be further apart than the radius where an item
has few distinct shingles.  Items of fewer than FEW_DISTINCT of them are therefore
compared at any distance with the windows that their shingles bring up.  For others a
window of similarity 0.75 lies beyond the radius about once in 10,000 (angle 0.54,
so 11 of 64 bits differ on average, with a deviation of 3), and a passage has windows nearer than that.

The items are a stated query set, held as flat arrays of about 40 bytes a shingle.
ITEMS_PER_PASS bounds what a broadcast holds, and more items take more passes.

Defined cases: words are runs of anything but ASCII white space after A-Z are
lower-cased; items of fewer than five words have no shingle and are never
reported; null texts are empty; items with the same text are reported each;
repeated rows are judged one by one; empty tables give empty results.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.llm.frames import id_and_text, map_batches
from pointloom.llm.textkernel import Texts, gram_starts, grams, mix64, slices

SHINGLE_WORDS = 5
SIMILARITY = 0.75
RADIUS = 22
#: First bit and width of the blocks of a fingerprint.
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
#: Distinct shingles below which an item is compared at any distance.
FEW_DISTINCT = 40
ITEMS_PER_PASS = 100_000
#: Shingles whose bits, and fingerprints whose keys, are held at a time.
RUN, LOOKUPS = 1 << 14, 1 << 10
_FILTER_BITS = 20


def _flips(width: int) -> np.ndarray:
    """All masks of up to RADIUS // len(BLOCKS) bits."""
    most = RADIUS // len(BLOCKS)
    return np.array([sum(1 << b for b in bits) for k in range(most + 1) for bits in combinations(range(width), k)], np.int64)


_BIT = np.arange(64, dtype=np.uint64)


def simhash(signs: np.ndarray) -> np.ndarray:
    """Fingerprints from sums of signs by bit (rows of 64)."""
    return np.packbits(signs > 0, axis=-1, bitorder="little").view(np.uint64)[..., 0]


def window_prints(hashes: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Fingerprints of the ``width`` shingles from each of ascending starts on; bits of some shingles at a time."""
    out, lo = np.zeros(len(starts), np.uint64), 0
    while lo < len(starts):
        hi = int(np.searchsorted(starts, starts[lo] + RUN, side="right"))
        own = hashes[starts[lo] : starts[hi - 1] + width]
        ones = np.zeros((len(own) + 1, 64), np.int32)
        np.cumsum((own[:, None] >> _BIT) & np.uint64(1), axis=0, out=ones[1:])
        at = starts[lo:hi] - starts[lo]
        out[lo:hi] = simhash(2 * (ones[at + width] - ones[at]) - width)
        lo = hi
    return out


@dataclass
class Items:
    """Benchmark items and their tables, as flat arrays."""

    ids: np.ndarray
    words: np.ndarray
    fingerprints: np.ndarray
    ptr: np.ndarray  # shingles of item i: ptr[i] up to ptr[i + 1], ascending
    shingles: np.ndarray
    counts: np.ndarray
    known: np.ndarray  # all shingles, ascending
    owners: np.ndarray
    owner_ptr: np.ndarray
    maybe: np.ndarray
    tables: list[tuple[np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, rows: list[tuple[int, str]]) -> Items:
        ids, sizes, prints, shingles, counts = [], [], [], [], []
        for item, text in sorted(rows, key=lambda r: (r[0], r[1] or "")):
            for _, texts in slices(pa.array([text], pa.string())):
                h = texts.lowered().words().hashes()
                g = grams(h, SHINGLE_WORDS)
                if len(g):
                    ids.append(item)
                    sizes.append(len(h))
                    prints.append(window_prints(g, np.zeros(1, np.int64), len(g))[0])
                    own, n = np.unique(g, return_counts=True)
                    shingles.append(own)
                    counts.append(n)
        ptr = np.append(0, np.cumsum([len(x) for x in shingles])).astype(np.int64)
        flat = np.concatenate([np.zeros(0, np.uint64), *shingles])
        owner = np.repeat(np.arange(len(ids)), np.diff(ptr))
        order = np.argsort(flat, kind="stable")
        first = np.flatnonzero(np.append(True, flat[order[1:]] != flat[order[:-1]])) if len(flat) else np.zeros(0, np.int64)
        known = flat[order[first]]
        maybe = np.zeros(1 << _FILTER_BITS, bool)
        maybe[(known >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
        prints = np.array(prints, np.uint64)
        tables = []
        for begin, width in BLOCKS:
            keys = _block(prints, begin, width)
            by_key = np.argsort(keys, kind="stable")
            tables.append((by_key, np.searchsorted(keys[by_key], np.arange((1 << width) + 1))))
        return cls(np.array(ids, np.int64), np.array(sizes, np.int64), prints, ptr, flat, np.concatenate([np.zeros(0, np.int64), *counts]), known, owner[order], np.append(first, len(flat)), maybe, tables)

    def within(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, item, distance) of all items within the radius of each fingerprint."""
        found = []
        for lo in range(0, len(prints), LOOKUPS):
            pairs = []
            for (begin, width), (items, ptr) in zip(BLOCKS, self.tables):
                flips = _flips(width)
                key = (_block(prints[lo : lo + LOOKUPS], begin, width)[:, None] ^ flips).ravel()
                at, which = _ranges(ptr[key], ptr[key + 1])
                pairs.append((lo + which // len(flips)) * len(self.ids) + items[at])
            pair = np.unique(np.concatenate(pairs))
            place, item = pair // max(1, len(self.ids)), pair % max(1, len(self.ids))
            distance = np.bitwise_count(prints[place] ^ self.fingerprints[item])
            near = distance <= RADIUS
            found.append((place[near], item[near], distance[near]))
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3

    def similarity(self, item: int, window: np.ndarray) -> float:
        own, n = np.unique(window, return_counts=True)
        a, b = self.ptr[item], self.ptr[item + 1]
        at = np.minimum(np.searchsorted(self.shingles[a:b], own), b - a - 1)
        same = self.shingles[a:b][at] == own
        both = int(np.minimum(n, self.counts[a:b][at])[same].sum())
        return both / (len(window) + int(self.counts[a:b].sum()) - both)


def _block(prints: np.ndarray, begin: int, width: int) -> np.ndarray:
    return ((prints >> np.uint64(begin)) & np.uint64((1 << width) - 1)).astype(np.int64)


def _ranges(first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of every range, one range after another, and the range of each."""
    n = end - first
    which = np.repeat(np.arange(len(n)), n)
    return np.arange(len(which)) - (np.cumsum(n) - n)[which] + first[which], which


def find_leaks(texts: Texts, items: Items, similarity: float = SIMILARITY) -> list[tuple[int, int, int, int, float, int]]:
    """(document, item id, first word, end word, similarity, distance) of every leak in a slice of texts."""
    if not len(items.ids):
        return []
    words = texts.lowered().words()
    g = grams(words.hashes(), SHINGLE_WORDS)
    at = gram_starts(words.ptr, SHINGLE_WORDS)
    at = at[items.maybe[(g[at] >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)]]
    place = np.searchsorted(items.known, g[at])
    hit = items.known[np.minimum(place, len(items.known) - 1)] == g[at]
    at, place = at[hit], place[hit]
    owner_at, which = _ranges(items.owner_ptr[place], items.owner_ptr[place + 1])
    owner, at = items.owners[owner_at], at[which]
    doc = np.searchsorted(words.ptr, at, side="right") - 1
    order = np.lexsort((at, owner, doc))
    at, owner, doc = at[order], owner[order], doc[order]
    size = items.words[owner]
    # hits of one item that are further apart than an item-sized window are looked at one by one
    new = np.ones(len(at), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (owner[1:] != owner[:-1]) | (at[1:] - at[:-1] > size[1:])
    edges = np.append(np.flatnonzero(new), len(at))
    runs, prints = [], []
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        item, d, k = int(owner[a]), int(doc[a]), int(size[a])
        lo = max(int(words.ptr[d]), int(at[a]) - k + SHINGLE_WORDS)
        hi = min(int(words.ptr[d + 1]), int(at[b - 1]) + k)
        whole = k - SHINGLE_WORDS + 1
        k = min(k, hi - lo)
        width = k - SHINGLE_WORDS + 1
        # no more shingles agree than are any of the item's: windows with too few of those are no candidates
        shared = np.zeros(hi - lo - SHINGLE_WORDS + 2, np.int64)
        shared[at[a:b] - lo + 1] = 1
        shared = np.cumsum(shared)
        most = shared[width:] - shared[:-width]
        windows = lo + np.flatnonzero(most / (width + whole - most) >= similarity)
        if len(windows):
            runs.append((d, item, k, windows))
            prints.append(window_prints(g, windows, width))
    if not runs:
        return []
    prints = np.concatenate(prints)
    run = np.repeat(np.arange(len(runs)), [len(r[3]) for r in runs])
    starts = np.concatenate([r[3] for r in runs])
    # equal fingerprints are looked up once; an item that is found has to have the size that the window was cut for
    each, same = np.unique(prints, return_inverse=True)
    place, near, _ = items.within(each)
    by_print = np.searchsorted(place, np.arange(len(each) + 1))
    at, window = _ranges(by_print[same], by_print[same + 1])
    own, cut = (np.array([r[c] for r in runs])[run] for c in (1, 2))
    fits = items.words[near[at]] == items.words[own[window]]
    few = np.flatnonzero(np.diff(items.ptr)[own] < FEW_DISTINCT)
    window, item = np.concatenate([window[fits], few]), np.concatenate([near[at][fits], own[few]])
    # windows that hold the same shingles as often are as similar to an item
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(g))])
    held = total[starts + cut - SHINGLE_WORDS + 1] - total[starts]
    known: dict[tuple[int, int, int], float] = {}
    found: dict[tuple[int, int], dict[int, tuple[float, int, int]]] = {}
    for w, i, s, k, h in zip(window.tolist(), item.tolist(), starts[window].tolist(), cut[window].tolist(), held[window].tolist()):
        kept = found.setdefault((runs[run[w]][0], i), {})
        if s not in kept:
            sim = known.get((i, k, h))
            if sim is None:
                sim = known[i, k, h] = items.similarity(i, g[s : s + k - SHINGLE_WORDS + 1])
            if sim >= similarity:
                kept[s] = (sim, w, k)
    out = []
    for (d, item), windows in found.items():
        taken: list[int] = []  # ascending starts and ends of passages that do not meet, one after another
        for s, (sim, w, k) in sorted(windows.items(), key=lambda x: (-x[1][0], x[0])):
            place = bisect_right(taken, s)
            if place % 2 == 0 and (place == len(taken) or s + k <= taken[place]):
                taken[place:place] = (s, s + k)
                first = s - int(words.ptr[d])
                out.append((d, int(items.ids[item]), first, first + k, sim, int(np.bitwise_count(prints[w] ^ items.fingerprints[item]))))
    return out


def _passes(benchmark: DataFrame, item_col: str, text_col: str, most: int) -> Iterator[Items]:
    """The items in parts of about ``most``, the bound on what the driver and a broadcast hold."""
    known = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL AND item_id IS NOT NULL")
    n = max(1, -(-known.count() // most))
    for k in range(n):
        yield Items.of([(r.item_id, r.text) for r in known.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()])


LEAKS = "doc_id long, item_id long, first_word long, end_word long, similarity double, distance int"


def leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, items_per_pass: int = ITEMS_PER_PASS) -> DataFrame:
    """One row for each passage of a document that is a benchmark item, or nearly one."""
    out = None
    for items in _passes(benchmark, "item_id", "text", items_per_pass):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def search(batch: pa.RecordBatch, shared=shared) -> Iterator[dict]:
            for lo, texts in slices(batch["text"]):
                rows = find_leaks(texts, shared.value, similarity)
                if rows:
                    d, item, first, end, sim, dist = zip(*rows)
                    yield {"doc_id": batch["doc_id"].take(pa.array([lo + x for x in d])), "item_id": list(item), "first_word": list(first), "end_word": list(end), "similarity": list(sim), "distance": list(dist)}

        found = map_batches(id_and_text(docs), search, LEAKS)
        out = found if out is None else out.unionAll(found)
    return out


def drop_leaking(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, items_per_pass: int = ITEMS_PER_PASS, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without a leak, with all their columns; no shuffle."""
    for items in _passes(benchmark, "item_id", "text", items_per_pass):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def keep(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(len(batch), bool)
                for lo, texts in slices(batch[text_col]):
                    for d, *_ in find_leaks(texts, shared.value, similarity):
                        clean[lo + d] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
