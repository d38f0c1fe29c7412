"""Near-duplicate documents: b-bit MinHash, band candidates, exact confirmation, components.

1. Each text gives its set of 5-word shingles, 128 minima, the low four bits of
   each minimum (packed into eight longs) and 32 band keys of four minima.
2. Documents with the same set form a class; the smallest id stands for it.
3. Stars: each band key has a hub, the smallest representative that holds it.  A
   representative asks the hub of best corrected estimate (bit counts of the
   packed signatures), and an exact comparison of whole sets confirms the link.
   That is one comparison for each document, so a group of near copies of any
   size falls into one tree, or few, with as many rows as it has members.
4. The rest: only band keys whose members still lie in several trees go on.  Their
   members are dealt to cells, estimates are taken between trees, and documents
   with a partner of near enough estimate are compared exactly, again in cells.

A cell holds two blocks of bounded size.  The largest tree of a group is never
compared with itself: a member of it goes to as many cells as the other members
fill blocks, so rows grow with a group's size while one tree holds most of it.
They grow with the size times the number of blocks in a group of many thousands
whose estimates are near the threshold and which are not near copies: a block of
whole sets has BLOCK_DOCS documents and BLOCK_SHINGLES shingles at most, so that
32,768 such documents of 100 shingles go to eight or nine cells each.  A pair of similarity 0.75 shares no band with probability 5e-6 and
falls below the estimate's margin with 3e-7.

Defined cases: words are runs of anything but ASCII white space after A-Z are
lower-cased; a text of one to four words is one shingle of all its words; a
null text or one without words has the empty set and is linked with nothing;
rows with the same id are one node, but for rows without words, which stand
alone; a null id is linked with nothing and kept; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pointloom.llm.components import connected_components, forest, roots
from pointloom.llm.frames import as_batch, checkpointed, id_and_text, map_batches
from pointloom.llm.textkernel import Texts, gram_starts, grams, mix64, slices

SHINGLE_WORDS = 5
#: A link: 100 * intersection >= THRESHOLD * union.
THRESHOLD = 75
BANDS, ROWS = 32, 4
LOW_BITS = 4
#: Margin of the estimate: five standard errors of 128 four-bit comparisons at the threshold.
MARGIN = 0.2
#: Documents of a block of signatures (80 bytes each), and documents and shingles of a block of whole sets.
BLOCK_SIGNATURES, BLOCK_DOCS, BLOCK_SHINGLES = 16_384, 4096, 1_000_000
#: Sets of one product of incidence matrices with all others of a cell.
LINK_ROWS = 1024

_FACTORS = (mix64(np.arange(BANDS * ROWS, dtype=np.uint64) + np.uint64(77)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_MASKS = (mix64(np.arange(BANDS * ROWS, dtype=np.uint64) + np.uint64(7777)) >> np.uint64(32)).astype(np.uint32)
#: Lowest bit of each group of LOW_BITS bits.
_LOWEST = np.uint64(0x1111111111111111)


def shingle_sets(texts: Texts, k: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, pointer by document) of the distinct shingles, ascending inside a document."""
    words = texts.lowered().words()
    h, counts = words.hashes(), words.counts()
    at = gram_starts(words.ptr, k)
    every, doc = [grams(h, k)[at] if len(at) else np.zeros(0, np.uint64)], [np.repeat(np.arange(len(texts)), counts)[at]]
    for n in range(1, k):
        short = np.flatnonzero(counts == n)
        if len(short):
            value = np.zeros(len(short), np.uint64)
            for j in range(n):
                value = value * np.uint64(0x9FB21C651E98DF25) + h[words.ptr[short] + j]
            every.append(mix64(value + np.uint64(n)))
            doc.append(short)
    g, d = np.concatenate(every), np.concatenate(doc)
    order = np.argsort(g)
    order = order[np.argsort(d[order].astype(np.uint16 if len(texts) < 65536 else np.int64), kind="stable")]
    g, d = g[order], d[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (d[1:] != d[:-1])
    g, d = g[new], d[new]
    return g, np.searchsorted(d, np.arange(len(texts) + 1))


def sketch(texts: Texts) -> dict:
    """Set size, set key, packed low bits and band keys of each text; the lists are empty where the set is."""
    g, ptr = shingle_sets(texts)
    n = np.diff(ptr)
    some = np.flatnonzero(n)
    first = ptr[some]
    k1, k2 = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
    minima = np.zeros((BANDS * ROWS, len(some)), np.uint32)
    if len(some):
        k1[some] = np.add.reduceat(g, first)
        k2[some] = np.add.reduceat(mix64(g ^ np.uint64(0x5851F42D4C957F2D)), first)
        g32 = (g >> np.uint64(32)).astype(np.uint32)
        value = np.empty_like(g32)
        for k in range(BANDS * ROWS):
            np.bitwise_xor(g32, _MASKS[k], out=value)
            np.multiply(value, _FACTORS[k], out=value)
            minima[k] = np.minimum.reduceat(value, first)
    low = (minima & np.uint32((1 << LOW_BITS) - 1)).astype(np.uint8)
    packed = np.ascontiguousarray((low[0::2] | low[1::2] << 4).T)
    m = minima.astype(np.uint64).reshape(BANDS, ROWS, len(some))
    keys = np.zeros((BANDS, len(some)), np.uint64)
    for r in range(ROWS):
        keys = mix64(keys * np.uint64(0x9FB21C651E98DF25) + m[:, r] + np.arange(1, BANDS + 1, dtype=np.uint64)[:, None] * np.uint64(1 << 40))
    some = n > 0
    lists = lambda width, values: pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.where(some, width, 0))).astype(np.int32)), pa.array(np.ascontiguousarray(values).view(np.int64).ravel()))
    return {"n_shingles": n, "k1": k1.view(np.int64), "k2": k2.view(np.int64), "sig": lists(BANDS * ROWS * LOW_BITS // 64, packed), "bands": lists(BANDS, keys.T)}


SKETCH = "doc_id long, n_shingles long, k1 long, k2 long, sig array<long>, bands array<long>"


def sketches(docs: DataFrame) -> DataFrame:
    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        for lo, texts in slices(batch["text"]):
            yield sketch(texts) | {"doc_id": batch["doc_id"][lo : lo + len(texts)]}

    return map_batches(id_and_text(docs), run, SKETCH)


def _corrected(differ, whole=BANDS * ROWS, chance=1 / (1 << LOW_BITS)):
    """Similarity from the number of minima whose low bits differ, corrected for those that agree by chance."""
    return (1 - differ / whole - chance) / (1 - chance)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Corrected similarity from packed signatures, rows of unsigned longs."""
    x = a ^ b
    for shift in (1, 2):  # the lowest bit of each group gets the union of its bits
        x |= x >> np.uint64(shift)
    return _corrected(np.bitwise_count(x & _LOWEST).sum(-1, dtype=np.int32))


def estimate_column(a: Column, b: Column) -> Column:
    """The same of two columns of signatures."""

    def differ(k: int) -> Column:
        x = F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))
        for shift in (1, 2):
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
        return F.bit_count(x.bitwiseAND(F.lit(int(_LOWEST))))

    return _corrected(reduce(lambda x, y: x + y, map(differ, range(BANDS * ROWS * LOW_BITS // 64))))


def _sizes_fit(a, b):
    """Whether sets of these sizes can be as similar as the threshold: the smaller may have no fewer than its share."""
    return (100 * a >= THRESHOLD * b) & (100 * b >= THRESHOLD * a)


LEAST = THRESHOLD / 100 - MARGIN


def _sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, hashes): whole shingle sets of the documents in ``ids`` (doc_id)."""

    def sets_of(batch: pa.RecordBatch) -> Iterator[dict]:
        for lo, texts in slices(batch["text"]):
            g, ptr = shingle_sets(texts)
            yield {"doc_id": batch["doc_id"][lo : lo + len(texts)], "hashes": pa.ListArray.from_arrays(pa.array(ptr.astype(np.int32)), pa.array(g.view(np.int64)))}

    return map_batches(id_and_text(docs).where("text IS NOT NULL").join(ids, "doc_id", "left_semi"), sets_of, "doc_id long, hashes array<long>")


def _stars(docs: DataFrame, reps: DataFrame, members: DataFrame) -> DataFrame:
    """(node, parent): confirmed links of representatives to the hub of best estimate among those of their band keys."""
    about = reps.select("doc_id", "sig", "n_shingles")
    of_hub = about.select(F.col("doc_id").alias("hub"), F.col("sig").alias("hub_sig"), F.col("n_shingles").alias("hub_shingles"))
    asked = members.where("doc_id > hub").select("doc_id", "hub").distinct().join(about, "doc_id").join(of_hub, "hub")
    likely = asked.where(_sizes_fit(F.col("n_shingles"), F.col("hub_shingles"))).select("doc_id", "hub", estimate_column(F.col("sig"), F.col("hub_sig")).alias("estimate")).where(F.col("estimate") >= LEAST)
    best = checkpointed(likely.groupBy("doc_id").agg(F.max(F.struct("estimate", (-F.col("hub")).alias("hub"))).alias("best")).select("doc_id", (-F.col("best.hub")).alias("hub")))
    sets = _sets(docs, best.select("doc_id").union(best.select("hub")).distinct())
    whole = best.join(sets.withColumnRenamed("hashes", "own"), "doc_id").join(sets.select(F.col("doc_id").alias("hub"), "hashes"), "hub")
    both = F.size(F.array_intersect("own", "hashes"))
    linked = whole.select("doc_id", "hub", both.alias("both"), (F.size("own") + F.size("hashes")).alias("sizes")).where(100 * F.col("both") >= THRESHOLD * (F.col("sizes") - F.col("both")))
    return linked.select(F.col("doc_id").alias("node"), F.col("hub").alias("parent")).distinct()


def _mixed(members: DataFrame, key: str, most_docs: int, most_shingles: int | None = None) -> DataFrame:
    """``members`` (key, doc_id, tree, n_shingles) of the keys with several trees, with ``main``, the tree of most
    members, and the blocks that it and the other members fill: none and one where a single block holds all."""
    sums = [F.count("*").alias("n"), F.sum("n_shingles").alias("shingles")]
    trees = members.groupBy(key, "tree").agg(*sums)
    groups = trees.groupBy(key).agg(F.max(F.struct("n", (-F.col("tree")).alias("tree"), "shingles")).alias("main"), F.sum("n").alias("n"), F.sum("shingles").alias("shingles"), F.count("*").alias("trees")).where("trees > 1")

    def blocks(n: Column, shingles: Column) -> Column:
        by_docs = F.ceil(n / most_docs)
        return by_docs if most_shingles is None else F.greatest(by_docs, F.ceil(shingles / most_shingles))

    single = blocks(F.col("n"), F.col("shingles")) <= 1
    sized = groups.select(
        key,
        (-F.col("main.tree")).alias("main"),
        F.when(single, 0).otherwise(blocks(F.col("main.n"), F.col("main.shingles"))).cast("int").alias("main_blocks"),
        F.when(single, 1).otherwise(blocks(F.col("n") - F.col("main.n"), F.col("shingles") - F.col("main.shingles"))).cast("int").alias("other_blocks"),
    )
    return members.join(sized, key)


def _in_cells(mixed: DataFrame, key: str) -> DataFrame:
    """Rows of ``_mixed`` dealt to cells: columns one and two are its blocks, side says of which of them a row is.

    A block of the main tree meets every block of the others, and those meet each other and themselves.
    """
    hashed = F.xxhash64("doc_id")
    of_main = (F.col("tree") == F.col("main")) & (F.col("main_blocks") > 0)
    own = F.when(of_main, F.pmod(hashed, F.greatest("main_blocks", F.lit(1)))).otherwise(F.col("main_blocks") + F.pmod(hashed, F.col("other_blocks"))).cast("int")
    first = F.when(of_main, F.col("main_blocks")).otherwise(F.lit(0))
    placed = mixed.withColumn("own", own).withColumn("partner", F.explode(F.sequence(first, F.col("main_blocks") + F.col("other_blocks") - 1)))
    cells = placed.withColumn("one", F.least("own", "partner")).withColumn("two", F.greatest("own", "partner")).withColumn("side", F.when(F.col("own") > F.col("partner"), 1).otherwise(0))
    return cells.drop("own", "partner", "main", "main_blocks", "other_blocks").repartition(key, "one", "two").sortWithinPartitions(key, "one", "two", "side", "doc_id")


def _by_cell(cells: DataFrame, key: str, settle: Callable[[pa.RecordBatch, np.ndarray], dict], schema: str) -> DataFrame:
    """What ``settle(rows, pointer by cell)`` gives for runs of whole cells in sorted partitions.

    A cell that an Arrow batch cuts is carried over to the next; a cell is two blocks at most.
    """
    place = (key, "one", "two")
    fields = T._parse_datatype_string(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(fields)
        held: list[pa.RecordBatch] = []

        def settled() -> pa.RecordBatch:
            rows = _together(held)
            new = np.ones(len(rows) + 1, bool)
            new[1:-1] = np.any([c[1:] != c[:-1] for c in (rows[c].to_numpy() for c in place)], axis=0)
            held.clear()
            return as_batch(settle(rows, np.flatnonzero(new)), arrow)

        for batch in batches:
            if not len(batch):
                continue
            last = [batch[c][-1].as_py() for c in place]
            apart = np.any([batch[c].to_numpy() != x for c, x in zip(place, last)], axis=0)
            cut = int(np.flatnonzero(apart)[-1]) + 1 if apart.any() else 0
            if cut:
                held.append(batch.slice(0, cut))
                yield settled()
            elif held and any(held[-1][c][-1].as_py() != x for c, x in zip(place, last)):
                yield settled()
            held.append(batch.slice(cut))
        if held:
            yield settled()

    return cells.mapInArrow(run, fields)


def _together(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0] if len(batches) > 1 else batches[0]


def _pairs(ptr: np.ndarray, side: np.ndarray, most: int = 1 << 17) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of cells: all of a cell of one side, those between the sides of a cell of two; some at a time."""
    sizes = np.diff(ptr)
    small = (sizes <= 16) & (side[ptr[:-1]] == side[ptr[1:] - 1])
    for s in range(2, 17):
        first = ptr[:-1][small & (sizes == s)]
        a, b = np.triu_indices(s, 1)
        step = max(1, most // len(a))
        for k in range(0, len(first), step):
            yield (first[k : k + step, None] + a).ravel(), (first[k : k + step, None] + b).ravel()
    for r in np.flatnonzero(~small & (sizes > 1)):
        lo, hi = int(ptr[r]), int(ptr[r + 1])
        middle = lo + int(np.searchsorted(side[lo:hi], 1))
        crossing = lo < middle < hi
        step = max(1, most // (hi - lo))
        for k in range(lo, middle if crossing else hi, step):
            a, b = np.meshgrid(np.arange(k, min(k + step, middle if crossing else hi)), np.arange(middle if crossing else k + 1, hi), indexing="ij")
            keep = a < b
            yield a[keep], b[keep]


def _smallest_trees(tree: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """By row, the smallest tree that its own reaches over links of rows."""
    known, own = np.unique(tree, return_inverse=True)
    return known[forest(len(known), own[i], own[j])][own]


def _candidates(cells: DataFrame) -> DataFrame:
    """(doc_id, tree, low): documents with a partner of near enough estimate in another tree; low joins their trees."""

    def settle(rows: pa.RecordBatch, ptr: np.ndarray) -> dict:
        tree, n, side = (rows[c].to_numpy() for c in ("tree", "n_shingles", "side"))
        sig = rows["sig"].flatten().to_numpy().view(np.uint64).reshape(len(rows), -1)
        some = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for i, j in _pairs(ptr, side):
            other = (tree[i] != tree[j]) & _sizes_fit(n[i], n[j])
            i, j = i[other], j[other]
            near = estimate(sig[i], sig[j]) >= LEAST
            some.append((i[near], j[near]))
        i, j = (np.concatenate(x) for x in zip(*some))
        at = np.unique(np.concatenate([i, j]))
        return {"doc_id": rows["doc_id"].to_numpy()[at], "tree": tree[at], "low": _smallest_trees(tree, i, j)[at]}

    return _by_cell(cells, "band", settle, "doc_id long, tree long, low long").distinct()


def exact_links(sets: list[np.ndarray], others: list[np.ndarray] | None = None, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of sets, or of sets and others, with 100 * intersection >= threshold * union, from products of incidence matrices."""
    every = sets + (others or [])
    n, m = len(sets), len(every)
    sizes = np.array([len(s) for s in every], np.int64)
    flat = np.concatenate(every)
    row = np.repeat(np.arange(m), sizes)
    _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count[column] > 1
    number = np.cumsum(count > 1) - 1
    row, column = row[shared], number[column[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    # shingles that the same sets hold, as those of a template, are one column with a weight
    begin = np.flatnonzero(np.append(True, column[1:] != column[:-1])) if len(column) else np.zeros(0, np.int64)
    holders = np.add.reduceat(mix64(row.astype(np.uint64)), begin) if len(column) else np.zeros(0, np.uint64)
    _, first_of, weight = np.unique(holders, return_index=True, return_counts=True)
    renumbered = np.full(len(begin), -1)
    renumbered[first_of] = np.arange(len(first_of))
    column = renumbered[column]
    row, column = row[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    # sums of whole numbers stay exact
    kind = np.float32 if len(flat) < 1 << 24 else np.float64
    width = max(256, (1 << 22) // m)
    begin_others = n if others else 0
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for top in range(0, n, LINK_ROWS):
        own = slice(top, min(top + LINK_ROWS, n))
        second = slice(begin_others if others else top, m)
        common = np.zeros((own.stop - own.start, second.stop - second.start), kind)
        for lo in range(0, len(weight), width):
            a, b = np.searchsorted(column, [lo, lo + width])
            x = np.zeros((m, min(width, len(weight) - lo)), kind)
            x[row[a:b], column[a:b] - lo] = 1
            common += (x[own] * weight[lo : lo + width].astype(kind)) @ x[second].T
        both = common.astype(np.int64)
        linked = 100 * both >= threshold * (sizes[own, None] + sizes[None, second] - both)
        i, j = np.nonzero(linked if others else np.triu(linked, 1))
        found.append((i + own.start, j + second.start))
    i, j = (np.concatenate(x) for x in zip(*found))
    return i, j


def _confirmed(cells: DataFrame) -> DataFrame:
    """(a, b): trees that an exact link of two documents joins, from whole sets."""

    def settle(rows: pa.RecordBatch, ptr: np.ndarray) -> dict:
        tree, side = rows["tree"].to_numpy(), rows["side"].to_numpy()
        ends = rows["hashes"].offsets.to_numpy()
        flat = rows["hashes"].values.to_numpy().view(np.uint64)
        some = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for lo, hi in zip(ptr[:-1].tolist(), ptr[1:].tolist()):
            middle = lo + int(np.searchsorted(side[lo:hi], 1))
            if hi - lo > 1 and middle > lo:
                sets = [flat[ends[k] : ends[k + 1]] for k in range(lo, hi)]
                i, j = exact_links(sets[: middle - lo], sets[middle - lo :])
                some.append((i + lo, j + lo))
        i, j = (np.concatenate(x) for x in zip(*some))
        low = _smallest_trees(tree, i, j)
        joined = low != tree
        return {"a": tree[joined], "b": low[joined]}

    return _by_cell(cells, "low", settle, "a long, b long").distinct()


def _rest(docs: DataFrame, reps: DataFrame, members: DataFrame, tree_of: DataFrame) -> DataFrame:
    """(a, b): trees that links between documents of different trees join."""
    about = reps.select("doc_id", "sig", "n_shingles")
    placed = members.select("band", "doc_id").join(tree_of, "doc_id", "left").join(about, "doc_id").withColumn("tree", F.coalesce("tree", "doc_id"))
    found = checkpointed(_candidates(_in_cells(_mixed(placed, "band", BLOCK_SIGNATURES), "band")))
    if found.isEmpty():
        return found.select(F.col("tree").alias("a"), F.col("tree").alias("b"))
    near = connected_components(found.select(F.col("tree").alias("a"), F.col("low").alias("b"))).select(F.col("node").alias("tree"), F.col("component").alias("low"))
    asked = found.select("doc_id", "tree").distinct().join(near, "tree").join(about.select("doc_id", "n_shingles"), "doc_id")
    dealt = checkpointed(_mixed(asked, "low", BLOCK_DOCS, BLOCK_SHINGLES))
    return _confirmed(_in_cells(dealt.join(_sets(docs, dealt.select("doc_id").distinct()), "doc_id"), "low"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept (the smallest id of its component) for each row of ``docs``."""
    every = checkpointed(sketches(docs))
    known = every.where("n_shingles > 0 AND doc_id IS NOT NULL")
    best = F.min(F.struct("doc_id", "n_shingles", "sig", "bands")).alias("rep")
    reps = checkpointed(known.groupBy("k1", "k2").agg(best).select("k1", "k2", "rep.*"))
    banded = reps.select("doc_id", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.min("doc_id").alias("hub"), F.max("doc_id").alias("last")).where("hub < last").drop("last")
    members = checkpointed(banded.join(shared, "band"))
    tree_of = roots(_stars(docs, reps, members)).select(F.col("node").alias("doc_id"), F.col("component").alias("tree"))
    placed = reps.select("k1", "k2", "doc_id").join(tree_of, "doc_id", "left").select("k1", "k2", "doc_id", F.coalesce("tree", "doc_id").alias("tree"))
    # an id with rows of several sets is a node beside their classes
    torn = known.groupBy("doc_id").agg(F.min(F.struct("k1", "k2")).alias("low"), F.max(F.struct("k1", "k2")).alias("high")).where("low <> high").select("doc_id")
    own = known.join(torn, "doc_id", "left_semi").select("doc_id", "k1", "k2").join(placed.select("k1", "k2", "tree"), ["k1", "k2"]).join(tree_of.withColumnRenamed("tree", "own"), "doc_id", "left")
    joined = connected_components(_rest(docs, reps, members, tree_of).unionAll(own.select("tree", F.coalesce("own", "doc_id"))))
    classes = placed.join(joined.withColumnRenamed("node", "tree"), "tree", "left").select("k1", "k2", F.coalesce("component", "tree").alias("component"))
    linked = every.select("doc_id", "n_shingles", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("k1")).alias("k1"), "k2").join(classes, ["k1", "k2"], "left")
    component = F.coalesce("component", "doc_id")
    return linked.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all columns, whose id is the smallest of its component."""
    gone = near_duplicates(id_and_text(docs, id_col, text_col)).where("NOT kept").select(F.col("doc_id").alias("_gone_id"))
    return docs.join(gone, docs[id_col].cast("long") == gone["_gone_id"], "left_anti")


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(words[p:p + 4], ' ') AS shingle FROM w, unnest(range(1, greatest(len(words) - 3, 2))) t(p) WHERE len(words) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b USING (shingle) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached(id, node) AS (SELECT doc_id, doc_id FROM w UNION SELECT id, ways.b FROM reached JOIN ways ON node = ways.a),
lowest AS (SELECT id AS doc_id, min(node) AS component_id FROM reached GROUP BY id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM lowest LEFT JOIN n USING (doc_id)
"""
