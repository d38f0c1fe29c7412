import random
import re

import numpy as np
from pyspark.sql import functions as F

from pointloom.llm import minhash as M
from pointloom.llm.components import connected_components, forest, roots
from tests.llm.conftest import EDGES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    sets = []
    for i, t in rows:
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append(frozenset(tuple(w[p : p + 5]) for p in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else []))
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and rows[a][0] is not None and rows[b][0] is not None and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(rows[a][0]), find(rows[b][0])
                root[max(x, y)] = min(x, y)
    return sorted(((i, len(s), find(i), find(i) == i) for (i, _), s in zip(rows, sets)), key=str)


def got(df):
    return sorted(map(tuple, M.near_duplicates(df).collect()), key=str)


def test_equals_brute_force(spark, documents, rows, edges):
    assert got(documents) == brute(rows)
    assert got(edges) == brute(EDGES)
    assert got(edges.limit(0)) == []


def test_a_large_group_at_the_threshold(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK_DOCS", 50)
    monkeypatch.setattr(M, "BLOCK_SIGNATURES", 40)
    rng = random.Random(3)
    base = [f"w{i}" for i in range(150)]
    made = []
    for i in range(260):
        w = list(base)
        for _ in range(rng.randint(1, 6)):
            w[rng.randrange(150)] = f"z{rng.randrange(10**6)}"
        made.append((i + 5, " ".join(w)))
    made += [(i, " ".join(base)) for i in (1000, 1001, 1001)]
    docs = spark.createDataFrame(made, "doc_id long, text string").repartition(5)
    assert got(docs) == brute(made)
    kept = {r.doc_id for r in M.keep_one(docs).collect()}
    assert kept == {r[0] for r in brute(made) if r[3]}


def test_estimates_are_corrected(spark):
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 64, (1, 8), np.uint64)
    assert M.estimate(a, a)[0] == 1
    b = rng.integers(0, 1 << 64, (4000, 8), np.uint64)
    assert abs(M.estimate(a, b).mean()) < 0.01
    frame = spark.createDataFrame([(i, x.tolist(), a.view(np.int64)[0].tolist()) for i, x in enumerate(b.view(np.int64)[:200])], "i long, x array<long>, y array<long>")
    found = [r.e for r in frame.select("i", M.estimate_column(F.col("x"), F.col("y")).alias("e")).orderBy("i").collect()]
    assert np.allclose(found, M.estimate(b[:200], a))


def test_rows_in_cells_follow_the_size_of_a_group(spark):
    """A tree of 30,000 members and a few others: each member is in one cell or few, whatever the number of blocks."""
    for n in (3_000, 30_000):
        members = spark.range(n).selectExpr("7L AS band", "id AS doc_id", "IF(id % 1000 = 1, id, 0L) AS tree", "100L AS n_shingles")
        mixed = M._mixed(members, "band", 1000)
        cells = M._in_cells(mixed, "band")
        assert cells.count() <= n + (n // 1000 + 2) * (n // 1000)
        meets = cells.where("one = two OR side = 0").groupBy("one", "two").count().count()
        assert meets == n // 1000 + 1
    even = spark.range(1200).selectExpr("7L AS band", "id AS doc_id", "id AS tree", "100L AS n_shingles")
    met = set()
    for r in M._in_cells(M._mixed(even, "band", 150), "band").groupBy("one", "two").agg(F.collect_list(F.struct("side", "doc_id")).alias("rows")).collect():
        left, right = [d for s, d in r["rows"] if s == 0], [d for s, d in r["rows"] if s == 1]
        new = {(min(a, b), max(a, b)) for a in left for b in (right or left) if a != b}
        assert not met & new
        met |= new
    assert len(met) == 1200 * 1199 // 2


def test_rows_of_one_id_are_one_node(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    docs = spark.createDataFrame([(3, a), (9, a), (9, b), (4, b), (5, "z")], "doc_id long, text string")
    assert got(docs) == brute([(3, a), (9, a), (9, b), (4, b), (5, "z")])


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (3, 4), (20, 20)] + [(100 + i, 101 + i) for i in range(40)]
    frame = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.component for r in connected_components(frame).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 8: 8, 9: 8} | {100 + i: 100 for i in range(41)}
    assert connected_components(frame.limit(0)).count() == 0
    assert forest(5, np.array([3, 4]), np.array([4, 1])).tolist() == [0, 1, 2, 1, 1]
    chain = spark.createDataFrame([(i + 1, i) for i in range(30)] + [(50, 3)], "node long, parent long")
    assert {r.node: r.component for r in roots(chain).collect()} == {i + 1: 0 for i in range(30)} | {50: 0}


def test_exact_links_equal_brute_force(monkeypatch):
    """Templates with words of their own, copies and strangers, also where products are cut into small blocks."""
    rng = np.random.default_rng(5)
    template = rng.integers(0, 1 << 60, 300).astype(np.uint64)
    sets = [np.unique(np.concatenate([template[: rng.integers(150, 300)], rng.integers(0, 1 << 60, rng.integers(1, 90)).astype(np.uint64)])) for _ in range(70)]
    sets += [sets[3], sets[3][:-2], rng.integers(0, 1 << 60, 40).astype(np.uint64)]
    similar = lambda a, b: 100 * len(np.intersect1d(a, b)) >= 75 * len(np.union1d(a, b))
    want = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if similar(sets[i], sets[j])}
    for rows in (1024, 20):
        monkeypatch.setattr(M, "LINK_ROWS", rows)
        assert set(zip(*(x.tolist() for x in M.exact_links(sets)))) == want and 0 < len(want) < len(sets) ** 2 / 2
        across = set(zip(*(x.tolist() for x in M.exact_links(sets[:30], sets[30:]))))
        assert across == {(i, j) for i, j in want if i < 30 <= j}


def test_whole_sets_of_a_template_go_to_few_cells(spark):
    """32,768 documents near the threshold and not linked, with the sizes of blocks as they are."""
    n = 32_768
    members = spark.range(n).selectExpr("7L AS low", "id AS doc_id", "id AS tree", "100L AS n_shingles")
    cells = M._in_cells(M._mixed(members, "low", M.BLOCK_DOCS, M.BLOCK_SHINGLES), "low")
    assert cells.count() <= 20 * n
    largest = cells.groupBy("one", "two").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    assert largest <= 2.3 * M.BLOCK_DOCS
