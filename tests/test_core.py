"""Goldens, properties and identities of the library's own operators."""

import math
import os
import random
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pointloom import catalog
from pointloom.functions import numbers, transforms
from pointloom.functions.metrics import EUCLIDEAN, MANHATTAN, Metric, boundary_distance
from pointloom.functions.rng import letters, permuted, uniform
from pointloom.operators import distances, indicators, refine, selection
from pointloom.operators.pairs import packed_blocks, pair_partials
from pointloom.plans import designs, randomizer, ranks, sequences, strata
from pointloom.schema import points_from, unitcube, vector


def point_set(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(rows)], "point_id long, coords array<double>")


def value(df):
    return df.first()["value"]


TWO = [(0.25, 0.25), (0.75, 0.75)]


def test_index_goldens(spark):
    r = randomizer.Randomizer(spark, 8, 8)
    assert [x.value for x in r.sobol().orderBy("pos").collect()] == [6, 7, 2, 3, 0, 5, 1, 4]
    assert [x.value for x in r.halton().orderBy("pos").collect()] == [3, 7, 5, 1, 4, 0, 6, 2]


def test_sequence_goldens(spark):
    first = lambda df: [x.coords[0] for x in df.orderBy("point_id").collect()]
    assert first(sequences.sobol(spark, 1, 8)) == [0.5, 0.75, 0.25, 0.375, 0.875, 0.625, 0.125, 0.1875]
    assert first(sequences.halton(spark, 8, 1, 5)) == [0.625, 0.375, 0.875, 0.0625, 0.5625, 0.3125, 0.8125, 0.1875]
    assert [x.bins[1] for x in sequences.korobov(spark, 16, 2, 3).orderBy("point_id").collect()] == [0, 3, 6, 9, 12, 15, 2, 5, 8, 11, 14, 1, 4, 7, 10, 13]
    assert first(designs.sukharev_grid(spark, 4, 2)) == [0.25, 0.25, 0.75, 0.75]


def test_sobol_blocks_are_stratified(spark):
    rows = sequences.sobol(spark, 40, 64, 0).collect()
    for d in range(40):
        assert sorted(int(r.coords[d] * 64) for r in rows) == list(range(64))
    with pytest.raises(ValueError):
        sequences.sobol(spark, 41, 4)


def test_direction_numbers_follow_their_recurrence():
    assert [v >> (29 - k) for k, v in enumerate(sequences.direction_numbers(2)[:4])] == [1, 3, 5, 15]
    assert all(len(sequences.direction_numbers(d)) == 30 and all((v >> (29 - k)) % 2 for k, v in enumerate(sequences.direction_numbers(d))) for d in range(1, 41))


def test_bits_and_primes(spark):
    rows = spark.createDataFrame([(n,) for n in (0, 1, 3, 7, 15, 17, 1023, 1024, 1025)], "n long").select("n", numbers.high_bit(F.col("n")).alias("h"), numbers.low_zero_bit(F.col("n")).alias("l")).collect()
    assert [r.l for r in rows] == [1, 2, 3, 4, 5, 2, 11, 1, 2] and [r.h for r in rows][:8] == [0, 1, 2, 3, 4, 5, 10, 11]
    assert numbers.first_primes(8) == [2, 3, 5, 7, 11, 13, 17, 19]
    got = spark.createDataFrame([(n,) for n in (-10, 1, 2, 4, 9, 24)], "n long").select(numbers.prime_from(F.col("n")).alias("p")).collect()
    assert [r.p for r in got] == [2, 2, 2, 5, 11, 29]
    assert numbers.binomial(5, 2) == 10 and numbers.binomial(2, 5) == 0


def test_primes_are_found_in_a_gap_and_not_up_to_the_double(spark):
    """Every number below 30,000 by a sieve, and numbers whose range up to the double no row holds."""
    sieve = np.ones(30_100, bool)
    sieve[:2] = False
    for p in range(2, 174):
        sieve[p * p :: p] &= not sieve[p]
    assert (numbers.primes_among(np.arange(30_100)) == sieve).all()
    big = {4294967291: True, 4294967297: False, 3215031751: False, 2**31 - 1: True, 3825123056546413051: False, 2**61 - 1: True, 999999999989 * 9: False, 65521 * 65519: False}
    assert numbers.primes_among(np.array(list(big))).tolist() == list(big.values())
    rows = spark.createDataFrame([(n,) for n in (None, 24, 10**12, 10**15, 2**31, 2**63 - 30)], "n long").select("n", numbers.is_prime(F.col("n")).alias("is"), numbers.prime_from(F.col("n")).alias("p")).collect()
    assert [r["is"] for r in rows] == [None, False, False, False, False, False]
    assert [r.p for r in rows] == [2, 29, 10**12 + 39, 10**15 + 37, 2**31 + 11, 2**63 - 25]


def test_lcg_jumps_equal_steps(spark):
    state = 42
    for r in sequences.lcg(spark, 5, -5, 42, 30).orderBy("pos").collect():
        state = state * 16807 % 2147483647
        x = state * 4.656612875e-10
        assert r.state == state and r.value == max(min(round((1 - x) * -5.5 + x * 5.5), 5), -5)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 100, 1000, 4099])
def test_permutations(spark, n):
    image = lambda s: [r.v for r in spark.range(n).select(permuted(F.col("id"), n, F.lit(s).cast("long")).alias("v"), "id").orderBy("id").collect()]
    assert sorted(image(1)) == list(range(n))
    assert n < 7 or image(1) != image(2)


def test_rows_do_not_depend_on_partitions(spark):
    frame = lambda k: sorted(map(tuple, spark.range(0, 200, 1, k).select("id", uniform(5, F.col("id")).alias("u"), permuted(F.col("id"), 200, F.lit(3).cast("long"))).collect()))
    assert frame(1) == frame(4) == frame(7)
    assert all(0 <= r[1] < 1 for r in frame(2))


def test_transforms(spark):
    design = spark.createDataFrame([(i, [i]) for i in range(4)], "point_id long, bins array<int>")
    column = lambda df: [r.coords[0] for r in df.orderBy("point_id").collect()]
    assert column(transforms.cell_centered(design)) == [0.125, 0.375, 0.625, 0.875]
    assert column(transforms.spread_out(design)) == pytest.approx([0, 1 / 3, 2 / 3, 1])
    assert column(transforms.anchored(design, 4)) == [0, 0.25, 0.5, 0.75]
    with pytest.raises(Exception, match="two points"):
        transforms.spread_out(design.limit(1)).collect()
    with pytest.raises(ValueError):
        transforms.scaled(point_set(spark, TWO), ([0.0, 0.0], [1.0, 0.0]), unitcube(2))
    assert column(transforms.scaled(point_set(spark, TWO), unitcube(2), ([0.0, 0.0], [2.0, 4.0]))) == [0.5, 1.5]
    moved = transforms.shifted_randomly(point_set(spark, TWO), 3, 2).collect()
    assert all(0 <= x < 1 for r in moved for x in r.coords)
    lhd = lambda a: transforms.has_lhd_property(sequences.korobov(spark, 16, 2, a)).first().is_lhd
    assert lhd(3) and not lhd(4) and not transforms.has_lhd_property(design.limit(0)).first().is_lhd


def test_grids(spark):
    for n in (64, 125, 216, 1000):
        assert designs.grid(spark, n, 3).count() == n
    for bad in (lambda: designs.grid(spark, 10, 2), lambda: designs.grid(spark, 1, 2), lambda: designs.sukharev_grid(spark, 0, 1)):
        with pytest.raises(ValueError):
            bad()


def test_metrics(spark):
    rng = random.Random(2)
    a, b = ([[rng.random() for _ in range(3)] for _ in range(12)] for _ in range(2))
    for metric in (EUCLIDEAN, MANHATTAN, Metric(3.0), Metric(math.inf), Metric(1.0, (1.0,) * 3), Metric(2.5, (1.0, 2.0, 3.0))):
        got = distances.distance_matrix(point_set(spark, a), point_set(spark, b), metric).collect()
        frame = spark.createDataFrame([(x, y) for x, y in zip(a, b)], "x array<double>, y array<double>")
        columns = [r.d for r in frame.select(metric.column(F.col("x"), F.col("y")).alias("d")).collect()]
        assert len(got) == 144
        assert columns == pytest.approx([{(r.a, r.b): r.dist for r in got}[i, i] for i in range(12)])
    assert value(indicators.separation_dist(point_set(spark, [[0.1], [0.9]]), Metric(1.0, (1.0,)))) == pytest.approx(0.2)
    for bad in (lambda: Metric(0), lambda: Metric(1, (0.0,))):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(Exception, match="outside"):
        point_set(spark, [[1.5]]).select(boundary_distance(F.col("coords"), vector([0]), vector([1]))).collect()


def test_quick_distances_keep_their_digits():
    """Products instead of differences: near and equal places, far origins and not finite coordinates give the same distances."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 64))
    x[100:150] = x[:50]
    x[150:200] = x[:50] + rng.normal(size=(50, 64)) * 1e-7
    for shift in (0.0, 1e6):
        a, b = x + shift, x[::-1] + shift
        got, want = EUCLIDEAN.quick(a, b), EUCLIDEAN.matrix(a, b)
        assert np.allclose(got, want, rtol=1e-10, atol=0) and ((want == 0) == (got == 0)).all()
    x[3, 5] = np.inf
    assert np.array_equal(EUCLIDEAN.quick(x, x), EUCLIDEAN.matrix(x, x), equal_nan=True)
    began = time.perf_counter()
    EUCLIDEAN.matrix(y := rng.random((1024, 64)), y)
    plain, began = time.perf_counter() - began, time.perf_counter()
    EUCLIDEAN.quick(y, y)
    assert time.perf_counter() - began < plain / 2


def test_indicator_goldens(spark):
    p = point_set(spark, TWO)
    assert value(indicators.separation_dist(p)) == pytest.approx(0.7071068)
    assert value(indicators.sum_of_nn_dists(p)) == pytest.approx(1.4142136)
    assert value(indicators.sum_of_dists(p)) == pytest.approx(0.8408964)
    assert value(indicators.average_inverse_dist(p, 2)) == pytest.approx(1.4142136)
    assert value(indicators.solow_polasky_diversity(p)) == pytest.approx(1.3395231)
    assert value(indicators.weitzman_diversity(p)) == pytest.approx(1.7071068)
    assert value(indicators.unanchored_l2_discrepancy(p, 2)) == pytest.approx(0.0943269)
    assert value(indicators.unanchored_l2_discrepancy(point_set(spark, [[0.5]]), 1)) == pytest.approx(0.2886751)
    assert value(indicators.expected_unanchored_l2_discrepancy(spark, 1, 1)) == pytest.approx(0.2886751)
    assert value(indicators.expected_dist_to_boundary(spark, 1)) == 0.25
    assert value(indicators.mean_dist_to_boundary(p, 2)) == 0.25
    a, b = point_set(spark, [(0, 0), (1, 0)]), point_set(spark, [(0, 1), (1, 0)])
    assert value(indicators.hausdorff_dist(a, b)) == 1 and value(indicators.averaged_hausdorff_dist(a, b)) == 0.5
    assert value(indicators.averaged_hausdorff_dist(point_set(spark, [(0, 0)]), point_set(spark, [(0, 2)]), 2)) == 4
    assert value(indicators.averaged_hausdorff_dist(a, b, math.inf)) == 1


def test_indicators_of_few_points(spark):
    none, one, same = point_set(spark, []), point_set(spark, [(0.5, 0.5)]), point_set(spark, [(0.5, 0.5)] * 2)
    for few in (none, one):
        assert value(indicators.separation_dist(few)) == value(indicators.sum_of_nn_dists(few)) == value(indicators.average_inverse_dist(few, 2)) == 0
    assert value(indicators.separation_dist(same)) == 0 and math.isinf(value(indicators.average_inverse_dist(same, 2)))
    assert value(indicators.unanchored_l2_discrepancy(none, 2)) == value(indicators.mean_dist_to_boundary(none, 2)) == 0
    assert value(indicators.weitzman_diversity(one)) == 1
    with pytest.raises(Exception, match="at most"):
        indicators.weitzman_diversity(point_set(spark, [(i / 20, 0.5) for i in range(20)])).collect()


def test_blocks_do_not_change_results(spark):
    rng = random.Random(4)
    points = point_set(spark, [(rng.random(), rng.random()) for _ in range(70)])
    count = lambda size: pair_partials(points, None, lambda i, x, j, y, same: {"n": len(x) * (len(x) - 1) // 2 if same else len(x) * len(y)}, "n long", size).agg(F.sum("n")).first()[0]
    assert count(1000) == count(9) == 70 * 69 // 2


def test_covering_radius_in_one_dimension_is_dealt_by_ranges(spark):
    rng = random.Random(8)
    for n in (1, 2, 3, 500):
        xs = sorted(rng.choice([rng.random(), 0.5]) for _ in range(n))
        got = indicators.covering_radius_1d(point_set(spark, [[x] for x in xs]))
        assert value(got) == pytest.approx(max([xs[0], 1 - xs[-1]] + [(b - a) / 2 for a, b in zip(xs, xs[1:])]))
        assert "rangepartitioning" in got._jdf.queryExecution().toString()
    assert math.isinf(value(indicators.covering_radius_1d(point_set(spark, [[0.5]]).limit(0))))


def test_covering_radius(spark):
    assert value(indicators.covering_radius(point_set(spark, [[0.1], [0.5]]), 1)) == pytest.approx(0.5)
    grid = designs.sukharev_grid(spark, 4, 2)
    exact = value(indicators.covering_radius(grid, 2))
    low = value(indicators.covering_radius_lower_bound(grid, sequences.halton(spark, 300, 2, 1)))
    high = value(indicators.covering_radius_upper_bound(grid, strata.stratify_conventional(spark, 4, 2)))
    assert exact == pytest.approx(math.sqrt(2) / 4) and low <= exact + 1e-9 <= high + 2e-9
    assert math.isinf(value(indicators.covering_radius_upper_bound(point_set(spark, []), strata.stratify_conventional(spark, 4, 2))))


def test_wmh(spark):
    values = indicators.wmh_values(0.1, 1.0, 2, 1, ("polynomials",))
    assert values[0] == pytest.approx(math.log10(1 - (0.2 - 0.01)))
    assert len(indicators.wmh_values(0.1, 2.0, 30, 3)) == 4 and indicators.wmh_values(0.1, 2.0, 30, 3, ("gumbel",))
    assert indicators.wmh_index(spark, 0.1, 2.0, 1, 2).first()["value"] == 0
    with pytest.raises(ValueError):
        indicators.wmh_values(0.1, math.inf, 30, 3)
    with pytest.raises(ValueError):
        indicators.wmh_values(0.1, 2.0, 2, 3, ("gumbel",))


def test_wmh_of_so_many_pairs_that_probabilities_vanish():
    """60,000 points with two at one place: the logarithms are large numbers, not infinite."""
    polynomials, gauss, gumbel, weibull = indicators.wmh_values(0.0, 2.0, 60_000, 1)
    assert polynomials == weibull == 0
    score = (0 - 1 / 6) / math.sqrt(1 / 15 - 1 / 36)
    pairs = math.comb(60_000, 2)
    assert gauss == pytest.approx(pairs * math.log10(math.erfc(score / math.sqrt(2)) / 2), rel=1e-12)
    alpha = math.sqrt(2 * math.log(pairs))
    beta = (math.log(math.log(pairs)) + math.log(4 * math.pi)) / (2 * alpha) - alpha
    assert gumbel == pytest.approx(-math.exp(alpha * (score - beta)) / math.log(10), rel=1e-12)
    assert math.isfinite(indicators.wmh_values(0.9, 2.0, 10_000_000, 1, ("polynomials",))[0])


def test_selection(spark):
    rng = random.Random(6)
    rows = [(rng.random(), rng.random()) for _ in range(60)]
    points, origin = point_set(spark, rows), point_set(spark, [(0, 0)])
    near = [math.dist(p, (0, 0)) for p in rows]
    expected = []
    for _ in range(12):
        i = max(range(60), key=lambda k: (near[k], -k))
        expected.append(i)
        near = [min(d, math.dist(p, rows[i])) for d, p in zip(near, rows)]
    seen = []
    got = selection.select_greedy_maximin(points, 12, origin, observer=lambda *a: seen.append(a[1]))
    assert [r.point_id for r in got.orderBy("pos").collect()] == expected == seen
    for select in (selection.select_greedy_maxisum, lambda p, k, e: selection.select_greedy_energy(p, k, 2, e, 0)):
        assert select(points, 60, origin).select("point_id").distinct().count() == 60
    assert selection.select_greedy_maximin(points, 3, seed=1).count() == 3
    with pytest.raises(ValueError):
        selection.select_greedy_maximin(points, 61)


def test_psa(spark):
    rng = random.Random(8)
    points = point_set(spark, [(rng.random(), rng.random()) for _ in range(90)])
    clusters = selection.psa_partition(points, 9, 2).cache()
    assert clusters.select("cluster_id").distinct().count() == 9 and clusters.count() == 90
    for target in selection.TARGETS:
        assert selection.representatives(clusters, 2, target).join(clusters, ["cluster_id", "point_id"]).count() == 9
    assert selection.representatives(clusters, 2, tournament_size=1).count() == 9
    with pytest.raises(ValueError):
        selection.psa_partition(point_set(spark, [(0.5, 0.5)] * 3), 2, 2)
    with pytest.raises(ValueError):
        selection.representatives(clusters, 2, "elsewhere")


def test_designs_are_latin(spark):
    def latin(df, n, dims):
        rows = df.collect()
        return len(rows) == n and all(sorted(r.bins[d] for r in rows) == list(range(n)) for d in range(dims))

    assert latin(designs.lhd(spark, 50, 3, 1), 50, 3)
    assert latin(designs.lhd(spark, 20, 2, 1, identity_first=True), 20, 2)
    assert latin(designs.improved_lhd(spark, 1, 2, 1), 1, 2) and latin(designs.improved_lhd(spark, 15, 2, 1, target=3.0), 15, 2)
    for d, k, m in ((2, 3, 4), (3, 2, 3), (1, 1, 5)):
        design = designs.sudoku(spark, d, k, m, 2).cache()
        size = m * k ** (d - 1)
        assert latin(design, k * size, d)
        boxes = {}
        for r in design.collect():
            box = tuple(x // size for x in r.bins)
            boxes[box] = boxes.get(box, 0) + 1
        assert set(boxes.values()) == {m} and len(boxes) == k**d


def test_strata(spark):
    for n, d, special in ((1, 2, True), (7, 3, True), (64, 2, True), (64, 2, False), (50, 1, True)):
        rows = strata.stratify_generalized(spark, n, d, 3, detect_special_case=special).collect()
        volumes = [math.prod(h - l for l, h in zip(r.lo, r.hi)) for r in rows]
        assert len(rows) == n and volumes == pytest.approx([1 / n] * n)
        for i, a in enumerate(rows):
            for b in rows[:i]:
                assert any(a.hi[j] <= b.lo[j] + 1e-12 or b.hi[j] <= a.lo[j] + 1e-12 for j in range(d))
    boxes = strata.stratify_generalized(spark, 37, 2, 4)
    got = strata.stratified_sampling(boxes, 2, latin="matching").collect()
    for j in (0, 1):
        assert sorted(min(36, int(r.coords[j] * 37)) for r in got) == list(range(37))
    for bad in (lambda: strata.stratified_sampling(boxes, 1, 0), lambda: strata.stratified_sampling(boxes, 1, latin="other")):
        with pytest.raises(ValueError):
            bad()


def test_strata_around_points(spark):
    rng = random.Random(5)
    rows = [(rng.random(), rng.choice([0.0, 0.5, 1.0])) for _ in range(25)]
    boxes = {r.stratum_id: r for r in strata.reconstruct_strata_from_points(point_set(spark, rows), 2, 1).collect()}
    assert sum(math.prod(h - l for l, h in zip(b.lo, b.hi)) for b in boxes.values()) == pytest.approx(1)
    assert all(all(l <= x <= h for l, x, h in zip(boxes[i].lo, p, boxes[i].hi)) for i, p in enumerate(rows))
    with pytest.raises(Exception, match="equal points"):
        strata.reconstruct_strata_from_points(point_set(spark, [(0.5, 0.5)] * 2), 2, 1)


def test_strata_around_all_part_points(spark):
    tables = "/root/testdata/sf0.01"
    if not os.path.isdir(tables):
        pytest.skip("the tables are not there")
    points = catalog.part_points(spark, tables).count()
    row = catalog.QUERIES["strata_from_all_points_audit"](spark, tables).first()
    assert points > 199 and (row.n, row.inside, row.total) == (points, True, 1.0)


def test_refinement(spark):
    start = sequences.random_uniform(spark, 12, 2, 1)
    for seed in (1, 2):
        better = refine.maximin_reconstruction(start, seed, 200, restarts=2, existing=[[0.5, 0.5]], reflect=seed == 1)
        assert better.count() == 24 and better.groupBy("restart").count().count() == 2
    again = [sorted(map(str, refine.random_k_means(start.repartition(k), 3, 100, metric=Metric(2.0, (1.0, 1.0))).collect())) for k in (1, 4)]
    assert again[0] == again[1]


def test_facade(spark):
    r = randomizer.Randomizer(spark, 30, 12, 5)
    for method in (r.uniform_mersenne, r.uniform_crypto, r.latin_matrix, r.latin_improved, r.korobov_matrix):
        rows = method().collect()
        assert len(rows) == 12 and all(0 <= x.value < 30 for x in rows) and sorted(x.pos for x in rows) == list(range(12))
    assert r.latin_sudoku(2, 3).count() == 12
    for bad in (lambda: r.latin_sudoku(2, 7), lambda: randomizer.Randomizer(spark, 3, 5).uniform_crypto(), lambda: randomizer.Randomizer(spark, 2, 1).korobov_matrix(), lambda: randomizer.Randomizer(spark, 0, 1)):
        with pytest.raises(ValueError):
            bad()
    assert len(randomizer.random_alpha(spark, 7, 1).first().letters) == 7 and randomizer.random_alpha(spark, 0, 1, as_list=True).first().letters == []
    twice = [spark.range(3).select(letters(seed, F.col("id"), 5).alias("l")).collect() for seed in (1, 1, 2)]
    assert twice[0] == twice[1] != twice[2] and all(len(r.l) == 5 and all("a" <= c <= "z" for c in r.l) for r in twice[0])


def test_ranks(spark):
    rng = random.Random(9)
    rows = [(rng.randrange(50), i) for i in range(500)]
    got = ranks.ranked(spark.createDataFrame(rows, "k int, i int"), F.col("k"), F.col("i")).orderBy("pos").collect()
    assert [(r.k, r.i) for r in got] == sorted(rows) and [r.pos for r in got] == list(range(500))


def test_estimates_do_not_grow_with_stored_steps(spark):
    """A loop of joins of stored tables keeps its rows, and the size that Spark expects of them stays a number of a few words."""
    rows = spark.range(5).withColumn("v", F.array(F.lit(1.5)))
    for _ in range(8):
        rows = ranks.stored(rows.join(rows.select("id"), "id").join(rows.select("id"), "id"))
        assert ranks.estimated_bits(rows) <= 64
    assert sorted((r.id, r.v) for r in rows.collect()) == [(i, [1.5]) for i in range(5)]


def test_points_from_columns(spark):
    frame = spark.createDataFrame([(1, 2, 3.5)], "id int, a int, b double")
    assert points_from(frame, "id", "a", "b").first().coords == [2.0, 3.5]


def test_cells_meet_every_pair_once(spark):
    rng = random.Random(8)
    rows = [(i, i % 3, [rng.random(), rng.random()]) for i in range(700)]
    frame = spark.createDataFrame(rows, "point_id long, g int, coords array<double>")

    def kernel(ids, x, other, y, same):
        pairs = [(a, b) for i, a in enumerate(ids.tolist()) for j, b in enumerate(other.tolist()) if not same or i < j]
        return {"a": [min(p) for p in pairs], "b": [max(p) for p in pairs]}

    for lane in (60, 16_384):
        found = sorted((r.a, r.b) for r in pair_partials(frame, None, kernel, "a long, b long", lane=lane).collect())
        assert found == [(a, b) for a in range(700) for b in range(a + 1, 700)]
        found = sorted((r.g, r.a, r.b) for r in pair_partials(frame, None, kernel, "a long, b long", lane=lane, by="g").collect())
        assert found == sorted((a % 3, a, b) for a in range(700) for b in range(a + 1, 700) if a % 3 == b % 3)
        others = frame.where("point_id < 90").withColumn("point_id", F.col("point_id") + 1000)
        found = sorted((r.a, r.b) for r in pair_partials(frame, others, kernel, "a long, b long", lane=lane).collect())
        assert found == [(a, 1000 + b) for a in range(700) for b in range(90)]


def test_points_of_all_pairs_travel_once(spark):
    rng = random.Random(12)
    frame = spark.createDataFrame([(i, [rng.random(), rng.random()]) for i in range(700)], "point_id long, coords array<double>")
    for others in (None, frame):
        met = pair_partials(frame, others, lambda i, x, j, y, same: {"n": len(x)}, "n long", lane=60)
        assert "Exchange" not in met._jdf.queryExecution().executedPlan().toString()
    assert packed_blocks(frame, 60).agg(F.sum(F.size("ids"))).first()[0] == 700


def test_files_of_all_distances_are_small(spark, tmp_path):
    """Pairs come by distance, block by block, so that files hold equal rounded distances as runs."""
    rng = np.random.default_rng(13)
    x, y = (v / np.linalg.norm(v, axis=1)[:, None] for v in (rng.normal(size=(n, 256)) for n in (1800, 2000)))
    frames = [spark.createDataFrame(pd.DataFrame({"point_id": range(len(v)), "coords": v.tolist()}), "point_id long, coords array<double>") for v in (x, y)]
    distances.distance_matrix(*frames).withColumn("dist", F.round("dist", 6)).write.parquet(str(tmp_path / "met"))
    assert sum(f.stat().st_size for f in (tmp_path / "met").glob("*.parquet")) < 6.5 * 1800 * 2000
    rows = pd.read_parquet(tmp_path / "met")
    assert len(rows) == 1800 * 2000
    got = np.full((1800, 2000), np.nan)
    got[rows["a"], rows["b"]] = rows["dist"]
    assert np.abs(got - np.sqrt(2 - 2 * x @ y.T)).max() < 1e-6


def test_covering_radius_by_boxes(spark):
    rng = random.Random(9)
    few = point_set(spark, [(rng.random(), rng.random()) for _ in range(9)])
    found = indicators.covering_radius_by_boxes(few, 2, 1e-6).first()
    assert abs(found.value - value(indicators.covering_radius(few, 2))) < 2e-6
    there = spark.createDataFrame([(0, found.place)], "point_id long, coords array<double>")
    assert abs(value(indicators.covering_radius_lower_bound(few, there)) - found.value) < 1e-9
    assert math.isinf(value(indicators.covering_radius_by_boxes(few.limit(0), 2)))


def test_boxes_with_few_points_around_end_in_tasks(spark, monkeypatch):
    # each round over all boxes was several shuffles, down to the tolerance
    rounds, ask = [], indicators.nearest
    monkeypatch.setattr(indicators, "nearest", lambda *a, **k: rounds.append(1) or ask(*a, **k))
    grid = designs.sukharev_grid(spark, 36, 2)
    assert abs(indicators.covering_radius_by_boxes(grid, 2).first().value - math.sqrt(2) / 12) < 2e-7 and len(rounds) <= 3
    rng = random.Random(10)
    crowd = point_set(spark, [(rng.random() / 50, rng.random() / 50) for _ in range(300)] + [(rng.random(), rng.random()) for _ in range(9)])
    want = value(indicators.covering_radius(crowd, 2))
    for around in (0, 20, 256):  # crowded boxes are divided round by round
        monkeypatch.setattr(indicators, "AROUND", around)
        assert abs(indicators.covering_radius_by_boxes(crowd, 2, 1e-4).first().value - want) < 2e-4


def test_default_start_and_observer(spark, tmp_path):
    start = refine.default_start(spark, 12, 2, 3)
    assert start.count() == 12 and start.columns == ["point_id", "coords"]

    def observe(restart, step, points):
        with open(tmp_path / f"{restart}-{step}", "w") as out:
            out.write(str(points.shape))

    refine.random_k_means(start, 1, 5, restarts=2, observer=observe).collect()
    assert len(os.listdir(tmp_path)) == 10
    refine.maximin_reconstruction(start, 1, 3, observer=observe).collect()
    assert len(os.listdir(tmp_path)) == 10


def test_normal_shares_undo_the_inverse(spark):
    back = {r.point_id: r.coords for r in sequences.normal_shares(sequences.sobol_normal(spark, 3, 50)).collect()}
    plain = {r.point_id: r.coords for r in sequences.sobol(spark, 3, 50).collect()}
    assert all(abs(a - b) < 1e-12 for i in plain for a, b in zip(back[i], plain[i]))
