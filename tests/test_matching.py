import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from pointloom.operators import matching
from pointloom.plans import strata


def largest(edges):
    """Size of a maximum matching by one augmenting path after another."""
    near, mate = {}, {}
    for u, v in edges:
        near.setdefault(u, set()).add(v)

    def path(u, seen):
        for v in near[u] - seen:
            seen.add(v)
            if v not in mate or path(mate[v], seen):
                mate[v] = u
                return True
        return False

    return sum(path(u, set()) for u in near)


def frame(spark, edges):
    return spark.createDataFrame(edges, "left long, right long")


def graph(seed, n, m, k):
    rng = random.Random(seed)
    return [(rng.randrange(n), rng.randrange(m)) for _ in range(k)]


@pytest.mark.parametrize("start", matching.STARTS)
@pytest.mark.parametrize("edges", [graph(1, 40, 40, 70), graph(2, 60, 20, 80), [(i, i) for i in range(12)] + [(i, i + 1) for i in range(11)]], ids=["sparse", "wide", "chain"])
def test_size_and_independent_set(spark, edges, start):
    found = matching.bipartite_match(frame(spark, edges), start, 3)
    assert found.size == largest(edges)
    pairs = [(r.left, r.right) for r in found.pairs.collect()]
    assert set(pairs) <= set(edges) and len({u for u, _ in pairs}) == len({v for _, v in pairs}) == len(pairs) == found.size
    left, right = {r.left for r in found.left.collect()}, {r.right for r in found.right.collect()}
    assert not any(u in left and v in right for u, v in edges)
    # no independent set is larger than the vertices less a matching
    assert len(left) + len(right) == len({u for u, _ in edges}) + len({v for _, v in edges}) - found.size
    assert tuple(matching.certificate(frame(spark, edges), found).first()) == (found.size, True, True)


def test_a_start_is_augmented(spark):
    """A start that blocks every pair but the last is turned over along one path through all of it."""
    n = 9
    edges = [(i, i) for i in range(n)] + [(i, i + 1) for i in range(n - 1)]
    start = frame(spark, [(i, i + 1) for i in range(n - 1)])
    found = matching.bipartite_match(frame(spark, edges), start)
    assert sorted((r.left, r.right) for r in found.pairs.collect()) == [(i, i) for i in range(n)]
    for bad in ([(0, 5)], [(0, 1), (1, 1)], [(0, 0), (0, 1)]):
        with pytest.raises(ValueError):
            matching.bipartite_match(frame(spark, edges), frame(spark, bad))


def test_groups_nulls_repeats_and_hot_vertices(spark):
    rows = [(g, u, v) for g, s in ((0, 5), (1, 6)) for u, v in graph(s, 25, 25, 40)] + [(2, 7, i) for i in range(400)] + [(3, i, 7) for i in range(400)]
    frame = spark.createDataFrame(rows * 2 + [(0, None, 1), (1, 1, None)], "group int, left long, right long")
    found = matching.bipartite_match(frame)
    sizes = {r.group: r["count"] for r in found.pairs.groupBy("group").count().collect()}
    assert sizes == {g: largest([(u, v) for h, u, v in rows if h == g]) for g in range(4)}
    assert matching.bipartite_match(frame.limit(0)).size == 0
    with pytest.raises(ValueError):
        matching.greedy_match(frame, "none")


@pytest.mark.parametrize("start", ("approx", "greedy-rand"))
def test_strata_get_bins_of_their_own(spark, start):
    boxes = strata.stratify_generalized(spark, 40, 2, 5)
    rows = strata.stratified_sampling(boxes, 9, 1, "matching", start).join(boxes.withColumnRenamed("stratum_id", "point_id"), "point_id").collect()
    assert len(rows) == 40 and not any(r.error for r in rows)
    for j in (0, 1):
        assert len({int(r.coords[j] * 40) for r in rows}) == 40 and all(r.lo[j] <= r.coords[j] <= r.hi[j] for r in rows)
    with pytest.raises(ValueError):
        strata.stratified_sampling(boxes, 9, 1, "matching", "none").collect()


def test_no_perfect_matching_is_refused(spark):
    boxes = strata.stratify_conventional(spark, 4, 1).select("stratum_id", F.array(F.lit(0.0)).alias("lo"), F.array(F.lit(0.25)).alias("hi"))
    with pytest.raises(ValueError, match="no perfect matching"):
        strata.stratified_sampling(boxes, 9, 1, "matching").collect()


def test_edges_are_sent_whole_to_no_task(spark, monkeypatch):
    # a row that is exploded counts as before, so that any number of edges looked small enough to be broadcast
    plans, kept = [], matching.stored

    def stored(df, **how):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return kept(df, **how)

    monkeypatch.setattr(matching, "stored", stored)
    edges = kept(spark.range(60).select(F.col("id").alias("left"), F.explode(F.sequence(F.floor(F.col("id") / 2), F.floor(F.col("id") / 2) + 9)).alias("right")))
    found = matching.bipartite_match(edges)
    assert matching.certificate(edges, found).first() == (found.size, True, True)
    assert len(plans) > 3 and not any("Broadcast" in plan for plan in plans)


def test_stored_edges_stay_where_they_lie(spark):
    # a literal group and an adaptive plan both made a checkpoint forget how it was dealt, and each join shuffled all edges
    edges = matching.stored_edges(matching._vertices(frame(spark, graph(7, 50, 50, 90))))
    some = matching._kept(edges.limit(5))
    plan = edges.join(matching._by_left(some.select("group", "left")), ["group", "left"])._jdf.queryExecution().executedPlan()
    assert "hashpartitioning" in edges._jdf.queryExecution().executedPlan().outputPartitioning().toString()
    found = [line for line in plan.toString().splitlines() if "Exchange hashpartitioning" in line]
    assert len(found) == 1  # of the other side
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"


@pytest.mark.parametrize("start", (*matching.STARTS, "given"))
def test_trees_grow_from_the_smaller_side(spark, monkeypatch, start):
    # 300 left vertices cannot all be matched with 20 right ones; a search from those left over read nearly all edges
    fronts, kept = [], matching._kept

    def counted(df):
        rows = kept(df)
        if rows.columns == ["group", "left", "root", "path"]:
            fronts.append(rows.count())
        return rows

    monkeypatch.setattr(matching, "_kept", counted)
    edges = [(u, v) for u, v in graph(8, 300, 20, 700)]
    found = matching.bipartite_match(frame(spark, edges), frame(spark, edges[:1]) if start == "given" else start)
    pairs = {(r.left, r.right) for r in found.pairs.collect()}
    assert found.size == len(pairs) == 20 and pairs <= set(edges)
    assert fronts[0] <= 20
    assert {r.right for r in found.cover_right.collect()} | {r.left for r in found.cover_left.collect()} == set(range(20)) and found.right.isEmpty()
    assert {r.left for r in found.left.collect()} == {u for u, _ in edges}
    assert tuple(matching.certificate(frame(spark, edges), found).first()) == (20, True, True)


def test_a_certificate_refuses(spark):
    edges = frame(spark, [(1, 1), (1, 2), (2, 2), (3, 3)])
    found = matching.bipartite_match(edges)
    assert tuple(matching.certificate(edges, found).first()) == (3, True, True)
    two = found.pairs.where("left < 3")
    cover = {"cover_left": found.cover_left.where("left < 3"), "cover_right": found.cover_right.where("right < 3")}
    assert tuple(matching.certificate(edges, replace(found, pairs=two, size=2)).first()) == (2, True, False)
    assert tuple(matching.certificate(edges, replace(found, pairs=two, size=2, **cover)).first()) == (2, True, False)  # (3, 3) is bare
    none = spark.createDataFrame([(0, 1, 1), (0, 2, 2), (0, 3, 2)], found.pairs.schema)
    assert tuple(matching.certificate(edges, replace(found, pairs=none)).first()) == (3, False, True)
