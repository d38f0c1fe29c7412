"""Registered queries over the test tables, and the SQL that must give the same rows.

Doubles are rounded to six places on both sides.  Seeded random operators give
audit rows, whose values follow from their definition whatever the seed.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.functions import numbers, transforms
from pointloom.functions.metrics import Metric, unit_torus
from pointloom.operators import distances, indicators, matching, neighbours, refine, selection, tessellation
from pointloom.plans import designs, randomizer, sequences, strata, tablefunctions
from pointloom.plans.ranks import ranked, shared_folder
from pointloom.schema import points_from
from pointloom.sources import entropy
from pointloom.streaming import means

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

PART_BOX = ([1.0, 900.0], [50.0, 1000.0])


def query(name: str, oracle: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _count(spark: SparkSession, sf_dir: str, name: str) -> int:
    """Rows of a table: the size of what a query derives from it."""
    return _table(spark, sf_dir, name).count()


def _side(spark: SparkSession, sf_dir: str, name: str = "customer") -> int:
    """The side of the largest square of as many cells as a table has rows."""
    return math.isqrt(_count(spark, sf_dir, name))


def _of_rows(points: DataFrame, spark: SparkSession, sf_dir: str, name: str, key: str, first: int) -> DataFrame:
    """The points that belong to rows of a table, by a key from 0 on."""
    return points.join(_table(spark, sf_dir, name).select((F.col(key) + first).alias("point_id")), "point_id", "left_semi")


def _facade(spark: SparkSession, sf_dir: str, name: str) -> randomizer.Randomizer:
    n = _count(spark, sf_dir, name)
    return randomizer.Randomizer(spark, n, n, 3)


def part_points(spark: SparkSession, sf_dir: str, distinct: bool = True) -> DataFrame:
    """Parts as points (size, price) of the unit square; equal points once, under their smallest key."""
    part = _table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    if distinct:
        part = part.groupBy("p_size", "p_retailprice").agg(F.min("p_partkey").alias("p_partkey"))
    return transforms.scaled(points_from(part, "p_partkey", "p_size", "p_retailprice"), PART_BOX, ([0.0, 0.0], [1.0, 1.0]))


def embedding_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("point_id"), F.col("embedding").cast("array<double>").alias("coords"))


def _half(spark: SparkSession, sf_dir: str, low: bool) -> DataFrame:
    """Embeddings of the first five labels, or of the others."""
    return labelled_points(spark, sf_dir).where((F.col("label") < 5) == low).select("point_id", "coords")


def brand_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    brands = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("point_id"), F.col("p_brand").alias("brand"))
    return part_points(spark, sf_dir, distinct=False).join(brands, "point_id")


def _together(spark: SparkSession, sf_dir: str, size: int) -> DataFrame:
    """Parts in groups of a few, by key."""
    return part_points(spark, sf_dir, distinct=False).withColumn("g", F.floor(F.col("point_id") / size))


def labelled_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").select("label", F.col("vec_id").alias("point_id"), F.col("embedding").cast("array<double>").alias("coords"))


def by_coordinate(points: DataFrame, column: str = "coords") -> DataFrame:
    value = F.round("v", 6).alias("v") if column == "coords" else F.col("v").cast("long").alias("v")
    return points.select("point_id", F.posexplode(column).alias("dim", "v")).select("point_id", F.col("dim").cast("long").alias("dim"), value)


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    for c in cols or ("value",):
        df = df.withColumn(c, F.round(c, 6))
    return df


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten parts picked far apart, with the least distance among them."""
    points = part_points(spark, sf_dir)
    picks = selection.select_greedy_maximin(points, 10, _origin(spark))
    return picks.crossJoin(F.broadcast(indicators.separation_dist(picks.select("point_id", "coords")))).select("pos", "point_id", F.get("coords", 0).alias("x"), F.get("coords", 1).alias("y"), F.col("value").alias("separation"))


def _origin(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(-1, [0.0, 0.0])], "point_id long, coords array<double>")


P2 = "p2 AS (SELECT min(p_partkey) AS id, (p_size - 1) / 49.0::DOUBLE AS x, (p_retailprice - 900) / 100.0::DOUBLE AS y FROM part GROUP BY p_size, p_retailprice)"
E64 = "e AS (SELECT vec_id AS id, list_transform(embedding, lambda v: v::DOUBLE) AS c, label FROM embeddings)"
D2 = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))"
VDC = "(SELECT sum(((i // pow({b}, k)::BIGINT) % {b}) / pow({b}, k + 1)) FROM range(0, {n}) t(k))"

_SQUARE = "WITH k AS (SELECT floor(sqrt(count(*)))::BIGINT AS k FROM customer), g AS (SELECT k, unnest(range(k * k)) AS i FROM k)"
_CUSTOMERS = "(SELECT count(*) AS n FROM customer) n"
_PAIRED = f"p AS (SELECT p_partkey AS id, p_partkey // {{size}} AS g, (p_size - 1) / 49.0::DOUBLE AS x, (p_retailprice - 900) / 100.0::DOUBLE AS y FROM part), m AS (SELECT g, {D2} AS d FROM p a JOIN p b USING (g) WHERE a.id < b.id)"
_GRID_OF_PARTS = "b AS (SELECT x, y, least(floor(x * 16), 15) / 16 AS lx, least(floor(y * 16), 15) / 16 AS ly FROM p2)"
_CORNER = "sqrt(pow(greatest(x - lx, lx + 0.0625 - x), 2) + pow(greatest(y - ly, ly + 0.0625 - y), 2))"

# sequences and lattices

query("index_sobol", """
WITH g AS (SELECT c_custkey AS id, xor(c_custkey + 1, (c_custkey + 1) >> 1) AS gray FROM customer),
q AS (SELECT id, (SELECT sum(((gray >> k) & 1) / pow(2, k + 1)) FROM range(0, 30) t(k)) AS q FROM g)
SELECT row_number() OVER (ORDER BY q, id) - 1 AS pos, id AS value FROM q
""")(lambda spark, d: _facade(spark, d, "customer").sobol())

query("index_halton", f"""
WITH q AS (SELECT i - 5 AS id, {VDC.format(b=2, n=30)} AS q FROM (SELECT c_custkey + 5 AS i FROM customer) t)
SELECT row_number() OVER (ORDER BY q, id) - 1 AS pos, id AS value FROM q
""")(lambda spark, d: _facade(spark, d, "customer").halton())

query("index_korobov_g3", "SELECT c_custkey AS pos, (c_custkey * 3) % (SELECT count(*) FROM customer) AS value FROM customer")(lambda spark, d: _facade(spark, d, "customer").korobov_matrix(3))

query("seq_halton_3d", " UNION ALL ".join(f"SELECT i AS point_id, {d}::BIGINT AS dim, round({VDC.format(b=b, n=20)}, 6) AS v FROM (SELECT p_partkey + 5 AS i FROM part) t" for d, b in enumerate((2, 3, 5))))(lambda spark, d: by_coordinate(_of_rows(sequences.halton(spark, _count(spark, d, "part"), 3, 5), spark, d, "part", "p_partkey", 5)))


def _directions_sql(dims: int) -> str:
    return ", ".join(f"({d}, {k}, {v})" for d in range(dims) for k, v in enumerate(sequences.direction_numbers(d + 1)))


query("seq_sobol_5d", f"""
WITH v(dim, k, n) AS (VALUES {_directions_sql(5)})
SELECT i AS point_id, dim::BIGINT AS dim, round(bit_xor(CASE WHEN (xor(i, i >> 1) >> k) & 1 = 1 THEN n ELSE 0 END) / pow(2, 30), 6) AS v
FROM (SELECT c_custkey + 1 AS i FROM customer) t, v GROUP BY i, dim
""")(lambda spark, d: by_coordinate(_of_rows(sequences.sobol(spark, 5, _count(spark, d, "customer")), spark, d, "customer", "c_custkey", 1)))

query("seq_sobol_40d", f"""
WITH v(dim, k, n) AS (VALUES {_directions_sql(40)})
SELECT i AS point_id, dim::BIGINT AS dim, round(bit_xor(CASE WHEN (xor(i, i >> 1) >> k) & 1 = 1 THEN n ELSE 0 END) / pow(2, 30), 6) AS v
FROM (SELECT s_suppkey + 1 AS i FROM supplier) t, v GROUP BY i, dim
""")(lambda spark, d: by_coordinate(_of_rows(sequences.sobol(spark, 40, _count(spark, d, "supplier")), spark, d, "supplier", "s_suppkey", 1)))

# five places: shares of 128ths are halfway between two numbers of six
query("seq_sobol_normal_back", f"""
WITH v(dim, k, n) AS (VALUES {_directions_sql(2)})
SELECT i AS point_id, dim::BIGINT AS dim, round(bit_xor(CASE WHEN (xor(i, i >> 1) >> k) & 1 = 1 THEN n ELSE 0 END) / pow(2, 30), 5) AS v
FROM (SELECT s_suppkey + 1 AS i FROM supplier) t, v GROUP BY i, dim
""")(lambda spark, d: sequences.normal_shares(_normals(spark, d)).select("point_id", F.posexplode("coords").alias("dim", "v")).select("point_id", F.col("dim").cast("long").alias("dim"), F.round("v", 5).alias("v")))

query("seq_sobol_normal")(lambda spark, d: by_coordinate(_normals(spark, d)))


def _normals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _of_rows(sequences.sobol_normal(spark, 2, _count(spark, sf_dir, "supplier")), spark, sf_dir, "supplier", "s_suppkey", 1)



query("seq_lcg", """
WITH RECURSIVE n AS (SELECT count(*) AS n FROM supplier), s AS (SELECT 0::BIGINT AS pos, ((12345::BIGINT * 16807) % 2147483647)::BIGINT AS state UNION ALL SELECT pos + 1, (state * 16807) % 2147483647 FROM s, n WHERE pos < n - 1)
SELECT pos, greatest(least(round_even((1 - state * 4.656612875e-10::DOUBLE) * 0.5 + state * 4.656612875e-10::DOUBLE * 100.5, 0)::BIGINT, 100), 1)::BIGINT AS value, state::BIGINT AS state FROM s
""")(lambda spark, d: sequences.lcg(spark, 1, 100, 12345, _count(spark, d, "supplier")))

query("bit_helpers", """
SELECT o_orderkey AS n, CASE WHEN o_orderkey > 0 THEN length(bin(o_orderkey)) ELSE 0 END::BIGINT AS high, bit_count(xor(o_orderkey, o_orderkey + 1))::BIGINT AS low_zero FROM orders
""")(lambda spark, d: _table(spark, d, "orders").select(F.col("o_orderkey").alias("n"), numbers.high_bit(F.col("o_orderkey")).cast("long").alias("high"), numbers.low_zero_bit(F.col("o_orderkey")).cast("long").alias("low_zero")))

query("primes", """
WITH m AS (SELECT max(p_partkey) + 200 AS m FROM part), i AS (SELECT unnest(range(0, m)) AS n FROM m),
p AS (SELECT n FROM i WHERE n >= 2 AND NOT EXISTS (SELECT 1 FROM range(2, 160) t(d) WHERE d < n AND n % d = 0))
SELECT p_partkey AS n, p_partkey IN (SELECT n FROM p) AS is_prime, (SELECT min(p.n) FROM p WHERE p.n >= p_partkey) AS prime_ge FROM part
""")(lambda spark, d: _table(spark, d, "part").select(F.col("p_partkey").alias("n"), numbers.is_prime(F.col("p_partkey")).alias("is_prime"), numbers.prime_from(F.col("p_partkey")).alias("prime_ge")))

query("grid_2d", f"{_SQUARE} SELECT i AS point_id, 0::BIGINT AS dim, round((i // k) / (k - 1)::DOUBLE, 6) AS v FROM g UNION ALL SELECT i, 1, round((i % k) / (k - 1)::DOUBLE, 6) FROM g")(lambda spark, d: by_coordinate(designs.grid(spark, _side(spark, d) ** 2, 2)))

query("grid_3d", "WITH k AS (SELECT floor(cbrt(count(*)) + 1e-9)::BIGINT AS k FROM customer), g AS (SELECT k, unnest(range(k * k * k)) AS i FROM k) " + " UNION ALL ".join(f"SELECT i AS point_id, {j}::BIGINT AS dim, round(((i // pow(k, {2 - j})::BIGINT) % k) / (k - 1)::DOUBLE, 6) AS v FROM g" for j in range(3)))(lambda spark, d: by_coordinate(designs.grid(spark, math.floor(math.cbrt(_count(spark, d, "customer")) + 1e-9) ** 3, 3)))

query("sukharev_2d", f"{_SQUARE} SELECT i AS point_id, 0::BIGINT AS dim, round((i // k + 0.5::DOUBLE) / k, 6) AS v FROM g UNION ALL SELECT i, 1, round((i % k + 0.5::DOUBLE) / k, 6) FROM g")(lambda spark, d: by_coordinate(designs.sukharev_grid(spark, _side(spark, d) ** 2, 2)))

query("lattice_rank1", f"SELECT c_custkey AS point_id, d::BIGINT AS dim, (c_custkey * g) % n AS v FROM customer, {_CUSTOMERS}, (VALUES (0, 5), (1, 17), (2, 60)) g(d, g)")(lambda spark, d: by_coordinate(sequences.rank1_lattice(spark, _count(spark, d, "customer"), [5, 17, 60]), "bins"))

query("lattice_korobov", f"SELECT c_custkey AS point_id, d::BIGINT AS dim, (c_custkey * (g % n)) % n AS v FROM customer, {_CUSTOMERS}, (VALUES (0, 1), (1, 12), (2, 144)) g(d, g)")(lambda spark, d: by_coordinate(sequences.korobov(spark, _count(spark, d, "customer"), 3, 12), "bins"))

# transforms

query("scaled_part", f"WITH {P2} SELECT id AS point_id, 0::BIGINT AS dim, round(x, 6) AS v FROM p2 UNION ALL SELECT id, 1, round(y, 6) FROM p2")(lambda spark, d: by_coordinate(part_points(spark, d)))

for _name, _how, _cell in (("centered", transforms.cell_centered, "(b + 0.5::DOUBLE) / n"), ("spread", transforms.spread_out, "b / (n - 1)::DOUBLE"), ("anchored", transforms.anchored, "b / n::DOUBLE")):
    query(f"transform_{_name}", f"""
    WITH l AS (SELECT c_custkey AS point_id, d::BIGINT AS dim, (c_custkey * g) % n AS b, n FROM customer, {_CUSTOMERS}, (VALUES (0, 1), (1, 3)) g(d, g)) SELECT point_id, dim, round({_cell}, 6) AS v FROM l
    """)(lambda spark, d, how=_how: by_coordinate(how(sequences.korobov(spark, _count(spark, d, "customer"), 2, 3))))

query("transform_perturbed_audit", "SELECT count(*) AS n, true AS in_cells FROM customer")(lambda spark, d: _perturbed(sequences.korobov(spark, _count(spark, d, "customer"), 2, 3), _count(spark, d, "customer")))


def _perturbed(lattice: DataFrame, n: int) -> DataFrame:
    inside = F.forall(F.zip_with("coords", "bins", lambda x, b: F.abs(x * n - b - 0.5) <= 0.5 + 1e-9), lambda ok: ok)
    return transforms.perturbed(lattice, 7).join(lattice, "point_id").agg(F.count("*").alias("n"), F.bool_and(inside).alias("in_cells"))



query("shift_fixed", f"WITH {P2} SELECT id AS point_id, 0::BIGINT AS dim, round((x + 0.3::DOUBLE) % 1.0, 6) AS v FROM p2 UNION ALL SELECT id, 1, round((y + 0.75::DOUBLE) % 1.0, 6) FROM p2")(lambda spark, d: by_coordinate(transforms.shifted(part_points(spark, d), [0.3, 0.75])))

query("lhd_check", f"SELECT a::BIGINT AS a, gcd(a, n) = 1 AS is_lhd FROM (VALUES (3), (4), (7), (11)) a(a), {_CUSTOMERS}")(
    lambda spark, d: reduce(DataFrame.unionAll, [transforms.has_lhd_property(sequences.korobov(spark, _count(spark, d, "customer"), 2, a)).select(F.lit(a).cast("long").alias("a"), "is_lhd") for a in (3, 4, 7, 11)])
)

# distances

_GAPS = "list_transform(list_zip(a.c, b.c), lambda p: abs(p[1] - p[2]))"
for _name, _metric, _sql in (
    ("l2", Metric(2.0), f"sqrt(list_sum(list_transform({_GAPS}, lambda g: g * g)))"),
    ("l1", Metric(1.0), f"list_sum({_GAPS})"),
    ("linf", Metric(math.inf), f"list_max({_GAPS})"),
    ("lp3", Metric(3.0), f"pow(list_sum(list_transform({_GAPS}, lambda g: pow(g, 3))), 1 / 3.0::DOUBLE)"),
    ("torus", Metric(1.0, (2.0,) * 64), f"list_sum(list_transform({_GAPS}, lambda g: least(g, 2 - g)))"),
):
    query(f"dist_{_name}", f"WITH {E64} SELECT a.id AS a, b.id AS b, round({_sql}, 6) AS dist FROM e a, e b WHERE a.label < 5 AND b.label >= 5")(lambda spark, d, m=_metric: rounded(distances.distance_matrix(_half(spark, d, True), _half(spark, d, False), m), "dist"))

query("dist_boundary", f"WITH {P2} SELECT id AS point_id, round(least(x, 1 - x, y, 1 - y), 6) AS dist FROM p2")(lambda spark, d: rounded(distances.dists_to_boundary(part_points(spark, d), 2), "dist"))

# indicators

_PAIRS = f"WITH {E64}, d AS (SELECT a.id AS a, b.id AS b, sqrt(list_sum(list_transform({_GAPS}, lambda g: g * g))) AS d FROM e a, e b WHERE a.id < b.id)"
query("separation", f"{_PAIRS} SELECT round(min(d), 6) AS value FROM d")(lambda spark, d: rounded(indicators.separation_dist(embedding_points(spark, d))))
query("sum_dists", f"{_PAIRS} SELECT round(sqrt(sum(d)), 6) AS value FROM d")(lambda spark, d: rounded(indicators.sum_of_dists(embedding_points(spark, d))))
query("avg_inv_dist", f"{_PAIRS} SELECT round(pow(sum(pow(1 / d, 3)), 1 / 3.0::DOUBLE) / count(*), 9) AS value FROM d")(lambda spark, d: indicators.average_inverse_dist(embedding_points(spark, d), 64, 3).withColumn("value", F.round("value", 9)))
query("sum_nn", f"{_PAIRS}, n AS (SELECT a AS id, d FROM d UNION ALL SELECT b, d FROM d), m AS (SELECT id, min(d) AS d FROM n GROUP BY id) SELECT round(sum(d), 6) AS value FROM m")(lambda spark, d: rounded(indicators.sum_of_nn_dists(embedding_points(spark, d))))
_BY_LABEL = f"WITH {E64}, d AS (SELECT a.label, a.id AS a, b.id AS b, sqrt(list_sum(list_transform({_GAPS}, lambda g: g * g))) AS d FROM e a, e b WHERE a.id < b.id AND a.label = b.label)"
query("separation_by_label", f"{_BY_LABEL} SELECT label, round(min(d), 6) AS value FROM d GROUP BY label")(lambda spark, d: rounded(indicators.separation_dist(labelled_points(spark, d), by="label")))
query("sum_nn_by_label", f"{_BY_LABEL}, n AS (SELECT label, a AS id, d FROM d UNION ALL SELECT label, b, d FROM d), m AS (SELECT label, id, min(d) AS d FROM n GROUP BY 1, 2) SELECT label, round(sum(d), 6) AS value FROM m GROUP BY label")(lambda spark, d: rounded(indicators.sum_of_nn_dists(labelled_points(spark, d), by="label")))
_SIDES = f"WITH {E64}, d AS (SELECT a.id AS a, b.id AS b, sqrt(list_sum(list_transform({_GAPS}, lambda g: g * g))) AS d FROM e a, e b WHERE a.label < 5 AND b.label >= 5), x AS (SELECT a, min(d) AS d FROM d GROUP BY a), y AS (SELECT b, min(d) AS d FROM d GROUP BY b)"
query("hausdorff", f"{_SIDES} SELECT round(greatest((SELECT max(d) FROM x), (SELECT max(d) FROM y)), 6) AS value")(lambda spark, d: rounded(indicators.hausdorff_dist(_half(spark, d, True), _half(spark, d, False))))
for _e in (1, 2):
    query(f"avg_hausdorff_e{_e}", f"{_SIDES} SELECT round(greatest((SELECT sum(pow(d, {_e})) / pow(count(*), 1 / {_e}.0::DOUBLE) FROM x), (SELECT sum(pow(d, {_e})) / pow(count(*), 1 / {_e}.0::DOUBLE) FROM y)), 6) AS value")(lambda spark, d, e=_e: rounded(indicators.averaged_hausdorff_dist(_half(spark, d, True), _half(spark, d, False), e)))

query("nn_parts", f"WITH {P2.replace('SELECT min(p_partkey) AS id', 'SELECT min(p_partkey) AS id, count(*) AS n')}, m AS (SELECT a.id, min({D2}) AS d FROM p2 a JOIN p2 b ON a.id <> b.id GROUP BY a.id) SELECT id AS point_id, n, round(CASE WHEN n > 1 THEN 0 ELSE d END, 6) AS dist FROM p2 JOIN m USING (id)")(
    lambda spark, d: rounded(neighbours.nearest_places(part_points(spark, d, distinct=False)).select("point_id", "n", "dist"), "dist")
)
query("cr_lower", f"WITH {P2}, m AS (SELECT {VDC.format(b=2, n=20)} AS x, {VDC.format(b=3, n=14)} AS y, i FROM range(1, 201) t(i)), n AS (SELECT a.i, min({D2}) AS d FROM m a, p2 b GROUP BY a.i) SELECT round(max(d), 6) AS value FROM n")(lambda spark, d: rounded(indicators.covering_radius_lower_bound(part_points(spark, d), sequences.halton(spark, 200, 2, 1))))
query("cr_upper", f"{_SQUARE} SELECT round(sqrt(2.0::DOUBLE) / (2 * k), 6) AS value FROM k")(lambda spark, d: rounded(indicators.covering_radius_upper_bound(designs.sukharev_grid(spark, _side(spark, d) ** 2, 2), strata.stratify_conventional(spark, _side(spark, d) ** 2, 2))))
query("cr_upper_parts", f"WITH {P2}, {_GRID_OF_PARTS} SELECT round(max({_CORNER}), 6) AS value FROM b")(lambda spark, d: rounded(indicators.covering_radius_upper_bound(part_points(spark, d), _boxes_of_parts(spark, d))))


def _boxes_of_parts(spark: SparkSession, sf_dir: str, distinct: bool = True) -> DataFrame:
    """The cell of a grid of sixteen by sixteen that each part lies in."""
    low = F.transform("coords", lambda x: F.least(F.floor(x * 16), F.lit(15)) / 16.0)
    return part_points(spark, sf_dir, distinct).select(F.col("point_id").alias("stratum_id"), low.alias("lo"), F.transform(low, lambda x: x + 1 / 16).alias("hi"))


query("cr_exact_1d", "WITH p AS (SELECT (c_acctbal + 1000) / 11000.0::DOUBLE AS x FROM customer), g AS (SELECT x, (x - lag(x) OVER (ORDER BY x)) / 2 AS gap FROM p) SELECT round(greatest(max(gap), min(x), 1 - max(x)), 6) AS value FROM g")(
    lambda spark, d: rounded(indicators.covering_radius(transforms.scaled(points_from(_table(spark, d, "customer"), "c_custkey", "c_acctbal"), ([-1000.0], [10000.0]), ([0.0], [1.0])), 1))
)
query("cr_exact_2d", "SELECT round(sqrt(2.0::DOUBLE) / (2 * sqrt(count(*))), 6) AS value FROM nation")(lambda spark, d: rounded(indicators.covering_radius(designs.sukharev_grid(spark, _count(spark, d, "nation"), 2), 2)))
query("cr_boxes_2d", "WITH k AS (SELECT floor(sqrt(count(*))) AS k FROM supplier) SELECT round(sqrt(2.0::DOUBLE) / (2 * k), 6) AS value, true AS reached FROM k")(lambda spark, d: _farthest(spark, designs.sukharev_grid(spark, _side(spark, d, "supplier") ** 2, 2)))


def _farthest(spark: SparkSession, points: DataFrame) -> DataFrame:
    """The covering radius by boxes, and whether its place is that far from the points."""
    found = indicators.covering_radius_by_boxes(points, 2)
    probe = found.select(F.lit(0).cast("long").alias("point_id"), F.col("place").alias("coords"))
    gap = indicators.covering_radius_lower_bound(points, probe).withColumnRenamed("value", "gap")
    return found.crossJoin(F.broadcast(gap)).select(F.round("value", 6).alias("value"), (F.abs(F.col("gap") - F.col("value")) < 1e-9).alias("reached"))  # one row each


@query("voronoi_parts_audit", f"WITH {P2} SELECT count(*) AS n, 1.0::DOUBLE AS area, true AS reached FROM p2")
def _tessellated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of all part places: there is one for each, they fill the square once, and the farthest corner is that far from all places."""
    points = part_points(spark, sf_dir)
    cells = tessellation.voronoi_cells(points)
    whole = tessellation.areas_of(cells).agg(F.count("*").alias("n"), F.round(F.sum("area"), 6).alias("area"))
    corners = tessellation.vertices_of(cells)
    probes = corners.select(F.monotonically_increasing_id().alias("point_id"), "coords")
    widest = corners.agg(F.max("dist").alias("widest"))
    met = indicators.covering_radius_lower_bound(points, probes).crossJoin(F.broadcast(widest))  # one row each
    return whole.crossJoin(F.broadcast(met)).select("n", "area", (F.abs(F.col("value") - F.col("widest")) < 1e-9).alias("reached"))


@query("voronoi_supplier_halves", "WITH p AS (SELECT s_suppkey AS point_id, (s_acctbal + 1000) / 11000.0::DOUBLE AS x FROM supplier), c AS (SELECT x, min(point_id) AS point_id FROM p GROUP BY x), g AS (SELECT point_id, x, lag(x) OVER (ORDER BY x) AS below, lead(x) OVER (ORDER BY x) AS above FROM c) SELECT point_id, round(coalesce((x + above) / 2, 1) - coalesce((x + below) / 2, 0), 6) AS area FROM g")
def _strips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of the square next to each supplier by balance: strips, as all lie on one line."""
    points = points_from(_table(spark, sf_dir, "supplier").withColumn("half", F.lit(0.5)), "s_suppkey", "s_acctbal", "half")
    return rounded(tessellation.areas_of(tessellation.voronoi_cells(transforms.scaled(points, ([-1000.0, 0.0], [10000.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])))), "area")


query("l2_discrepancy", "WITH p AS (SELECT p_partkey AS id, (p_size - 1) / 49.0::DOUBLE AS x, (p_retailprice - 900) / 100.0::DOUBLE AS y FROM part), s AS (SELECT sum((1 - greatest(a.x, b.x)) * least(a.x, b.x) * (1 - greatest(a.y, b.y)) * least(a.y, b.y)) AS pairs FROM p a, p b), t AS (SELECT sum(x * (1 - x) * y * (1 - y)) AS singles, count(*)::DOUBLE AS n FROM p) SELECT round(sqrt(pairs / (n * n) - singles * 0.5::DOUBLE / n + 1 / 144.0::DOUBLE), 6) AS value FROM s, t")(
    lambda spark, d: rounded(indicators.unanchored_l2_discrepancy(part_points(spark, d, distinct=False), 2))
)
query("l2_discrepancy_expected", "SELECT round(sqrt(pow(6.0::DOUBLE, -2) * (1 - pow(2.0::DOUBLE, -2)) / count(*)), 6) AS value FROM part")(lambda spark, d: rounded(indicators.expected_unanchored_l2_discrepancy(spark, _count(spark, d, "part"), 2)))
_P_BRAND = "p AS (SELECT p_brand AS brand, (p_size - 1) / 49.0::DOUBLE AS x, (p_retailprice - 900) / 100.0::DOUBLE AS y FROM part)"
query("l2_discrepancy_by_brand", f"WITH {_P_BRAND}, s AS (SELECT a.brand, sum((1 - greatest(a.x, b.x)) * least(a.x, b.x) * (1 - greatest(a.y, b.y)) * least(a.y, b.y)) AS pairs FROM p a JOIN p b USING (brand) GROUP BY 1), t AS (SELECT brand, sum(x * (1 - x) * y * (1 - y)) AS singles, count(*)::DOUBLE AS n FROM p GROUP BY 1) SELECT brand, round(sqrt(pairs / (n * n) - singles * 0.5::DOUBLE / n + 1 / 144.0::DOUBLE), 6) AS value FROM s JOIN t USING (brand)")(
    lambda spark, d: rounded(indicators.unanchored_l2_discrepancy(brand_points(spark, d), 2, "brand"))
)
query("mean_dist_boundary", f"WITH {P2} SELECT round(avg(least(x, 1 - x, y, 1 - y)), 6) AS value FROM p2")(lambda spark, d: rounded(indicators.mean_dist_to_boundary(part_points(spark, d), 2)))
query("expected_dist_boundary", "SELECT 0.5::DOUBLE / (1 + max(len(embedding))) AS value FROM embeddings")(lambda spark, d: indicators.expected_dist_to_boundary(spark, _table(spark, d, "embeddings").agg(F.max(F.size("embedding"))).first()[0]))
query("solow_polasky", f"WITH {_PAIRED.format(size=2)}, g AS (SELECT g, max(d) AS d FROM m GROUP BY g) SELECT g, round(2 / (1 + exp(-d)), 6) AS value FROM g")(lambda spark, d: rounded(indicators.solow_polasky_diversity(_together(spark, d, 2), by="g")))
query("solow_polasky_all")(lambda spark, d: indicators.solow_polasky_diversity(embedding_points(spark, d)))
query("solow_polasky_by_label")(lambda spark, d: indicators.solow_polasky_diversity(labelled_points(spark, d), by="label"))
query("weitzman", f"WITH {_PAIRED.format(size=3)} SELECT g, round(CASE WHEN count(*) = 1 THEN 1 + min(d) WHEN count(*) = 3 THEN 1 + min(d) + max(d) END, 6) AS value FROM m GROUP BY g")(lambda spark, d: rounded(indicators.weitzman_diversity(_together(spark, d, 3), by="g")))
_WMH = """
WITH c AS (SELECT (SELECT min(abs(a.s_acctbal - b.s_acctbal)) / 11000.0::DOUBLE FROM supplier a JOIN supplier b ON a.s_suppkey < b.s_suppkey) AS t, 2.0::DOUBLE AS p, 1 AS d, (SELECT (count(*) * (count(*) - 1) // 2)::DOUBLE FROM supplier) AS pairs),
terms AS (SELECT l, (CASE WHEN (l - d) % 2 = 0 THEN 1 ELSE -1 END) * (gamma(d + 1) / (gamma(l - d + 1) * gamma(2 * d - l + 1))) * pow(2 / p, d) * pow(gamma(1 / p), 2 * d - l) * pow(gamma(2 / p), l - d) / gamma(l / p + 1) AS a FROM c, range(1, 3) r(l)),
scores AS (SELECT pairs, (pow(t, p) - d * 2 / ((p + 1) * (p + 2))) / sqrt(d * (2 / ((2 * p + 1) * (2 * p + 2)) - pow(2 / ((p + 1) * (p + 2)), 2))) AS score, sqrt(2 * ln(pairs)) AS alpha FROM c),
erfs AS (SELECT 2 / sqrt(pi()) * sum((CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END) * pow(score / sqrt(2.0::DOUBLE), 2 * k + 1) / (gamma(k + 1) * (2 * k + 1))) AS erf FROM scores, range(0, 60) r(k) GROUP BY score),
v AS (
    SELECT 'polynomials' AS approximation, pairs * log10(1 - (SELECT sum(a * pow(t, l)) FROM terms)) AS value FROM c
    UNION ALL SELECT 'gauss', pairs * log10(1 - (1 + erf) / 2) FROM scores, erfs
    UNION ALL SELECT 'gumbel', -exp(alpha * (score - ((ln(ln(pairs)) + ln(4 * pi())) / (2 * alpha) - alpha))) / ln(10.0::DOUBLE) FROM scores
    UNION ALL SELECT 'weibull', -(SELECT a FROM terms WHERE l = d) * pairs * pow(t, d) / ln(10.0::DOUBLE) FROM c)
SELECT approximation, round(value, 6) AS value FROM v UNION ALL SELECT 'max', round(max(value), 6) FROM v
"""
# scaled, rounded and scaled back as the SQL's round does, which shows in the last digit of very large values
query("wmh", _WMH)(lambda spark, d: indicators.wmh_index(spark, indicators.separation_dist(_supplier_points(spark, d)).first()[0], 2.0, _count(spark, d, "supplier"), 1).withColumn("value", F.round(F.col("value") * 1e6) / 1e6))


def _supplier_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transforms.scaled(points_from(_table(spark, sf_dir, "supplier"), "s_suppkey", "s_acctbal"), ([-1000.0], [10000.0]), ([0.0], [1.0]))



# table functions

_BRANDS = "b AS (SELECT p_brand AS brand, count(*) AS n FROM part GROUP BY 1)"
_HALTON_OF_BRANDS = f"h AS (SELECT brand, i AS point_id, {VDC.format(b=2, n=24)} AS x, {VDC.format(b=3, n=15)} AS y FROM (SELECT brand, unnest(range(1, n + 1)) AS i FROM b) t)"


def _sizes(spark: SparkSession, sf_dir: str, name: str, group: str, alias: str) -> DataFrame:
    """(group, n): rows of each value of a column."""
    return _table(spark, sf_dir, name).groupBy(F.col(group).alias(alias)).agg(F.count("*").alias("n"))


def _halton_of_brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many Halton points as a brand has parts, from index 1 on, for each brand."""
    return tablefunctions.generated(_sizes(spark, sf_dir, "part", "p_brand", "brand"), "halton_points({first}, {n}, 2)", 1).drop("n")


query("halton_by_brand", f"WITH {_BRANDS}, {_HALTON_OF_BRANDS} SELECT brand, point_id, round(x, 6) AS x0, round(y, 6) AS x1 FROM h")(lambda spark, d: rounded(_halton_of_brands(spark, d), "x0", "x1"))
query("cr_lower_by_brand", f"WITH {_BRANDS}, {_HALTON_OF_BRANDS}, {_P_BRAND}, m AS (SELECT a.brand, a.point_id, min({D2}) AS d FROM h a JOIN p b USING (brand) GROUP BY 1, 2) SELECT brand, round(max(d), 6) AS value FROM m GROUP BY 1")(
    lambda spark, d: rounded(indicators.covering_radius_lower_bound(brand_points(spark, d), _halton_of_brands(spark, d).select("brand", "point_id", F.array("x0", "x1").alias("coords")), by="brand"))
)
query("cr_upper_by_brand", f"WITH {_P_BRAND}, b AS (SELECT brand, x, y, least(floor(x * 16), 15) / 16 AS lx, least(floor(y * 16), 15) / 16 AS ly FROM p) SELECT brand, round(max({_CORNER}), 6) AS value FROM b GROUP BY 1")(
    lambda spark, d: rounded(indicators.covering_radius_upper_bound(brand_points(spark, d), _boxes_of_parts(spark, d, distinct=False), by="brand"))
)
query("sobol_by_nation", f"""
WITH v(dim, k, n) AS (VALUES {_directions_sql(3)}), s AS (SELECT s_nationkey AS nation, unnest(range(1, count(*) + 1)) AS i FROM supplier GROUP BY 1),
x AS (SELECT nation, i, dim, bit_xor(CASE WHEN (xor(i, i >> 1) >> k) & 1 = 1 THEN n ELSE 0 END) / pow(2, 30) AS x FROM s, v GROUP BY 1, 2, 3)
SELECT nation, i AS point_id, {", ".join(f"round(max(x) FILTER (dim = {j}), 6) AS x{j}" for j in range(3))} FROM x GROUP BY 1, 2
""")(lambda spark, d: rounded(tablefunctions.generated(_sizes(spark, d, "supplier", "s_nationkey", "nation"), "sobol_points({first}, {n}, 3)", 1).drop("n"), "x0", "x1", "x2"))
query("lattice_by_segment", "WITH s AS (SELECT c_mktsegment AS segment, count(*) AS n, unnest(range(count(*))) AS i FROM customer GROUP BY 1) SELECT segment, i AS point_id, round(i / n::DOUBLE, 6) AS x0, round(((i * 7) % n) / n::DOUBLE, 6) AS x1 FROM s")(
    lambda spark, d: rounded(tablefunctions.generated(_sizes(spark, d, "customer", "c_mktsegment", "segment"), "lattice_points({first}, {n}, n, array(1, 7))").drop("n"), "x0", "x1")
)


def _squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest square of as many cells as a priority has orders, for each priority."""
    side = F.floor(F.sqrt("n"))
    return _sizes(spark, sf_dir, "orders", "o_orderpriority", "priority").select("priority", side.alias("k"), (side * side).alias("n"))


_PRIORITIES = "k AS (SELECT o_orderpriority AS priority, floor(sqrt(count(*)))::BIGINT AS k FROM orders GROUP BY 1), g AS (SELECT priority, k, unnest(range(k * k)) AS i FROM k)"
query("strata_by_priority", f"WITH {_PRIORITIES} SELECT priority, i AS stratum_id, round((i // k) / k::DOUBLE, 6) AS lo0, round((i % k) / k::DOUBLE, 6) AS lo1, round((i // k + 1) / k::DOUBLE, 6) AS hi0, round((i % k + 1) / k::DOUBLE, 6) AS hi1 FROM g")(
    lambda spark, d: rounded(tablefunctions.generated(_squares(spark, d), "conventional_strata({first}, {n}, k, 2)").drop("n", "k"), "lo0", "lo1", "hi0", "hi1")
)
query("sukharev_by_priority", f"WITH {_PRIORITIES} SELECT priority, i AS point_id, round((i // k + 0.5::DOUBLE) / k, 6) AS x0, round((i % k + 0.5::DOUBLE) / k, 6) AS x1 FROM g")(
    lambda spark, d: rounded(tablefunctions.generated(_squares(spark, d), "sukharev_points({first}, {n}, k, 2)").drop("n", "k"), "x0", "x1")
)

# selection

_KINDS = {
    "maximin": ("least(s.crit, {d})", "{d}", "DESC", False),
    "maxisum": ("s.crit + {d}", "{d}", "DESC", True),
    "energy": ("s.crit + CASE WHEN {d} = 0 THEN 'inf'::DOUBLE ELSE 1 / pow({d}, 3) END", "CASE WHEN {d} = 0 THEN 'inf'::DOUBLE ELSE 1 / pow({d}, 3) END", "ASC", True),
}


def _greedy_sql(kind: str, k: int) -> str:
    step, start, order, mask = _KINDS[kind]
    gap = "sqrt((p2.x - {q}x) * (p2.x - {q}x) + (p2.y - {q}y) * (p2.y - {q}y))"
    zero = "sqrt(p2.x * p2.x + p2.y * p2.y)"
    ctes = [P2, f"s0 AS (SELECT id, x, y, {start.format(d=zero)} AS crit FROM p2)", f"k0 AS (SELECT * FROM s0 ORDER BY crit {order}, id LIMIT 1)"]
    for i in range(1, k):
        d = gap.replace("p2.", "s.").format(q=f"k{i - 1}.")
        moved = step.format(d=d)
        out = "'-inf'::DOUBLE" if order == "DESC" else "'inf'::DOUBLE"
        if mask:
            moved = f"CASE WHEN s.id = k{i - 1}.id OR s.crit = {out} THEN {out} ELSE {moved} END"
        ctes += [f"s{i} AS MATERIALIZED (SELECT s.id, s.x, s.y, {moved} AS crit FROM s{i - 1} s, k{i - 1})", f"k{i} AS MATERIALIZED (SELECT * FROM s{i} ORDER BY crit {order}, id LIMIT 1)"]
    return f"WITH {', '.join(ctes)} " + " UNION ALL ".join(f"SELECT {i}::BIGINT AS pos, id AS point_id FROM k{i}" for i in range(k))


query("greedy_maximin", _greedy_sql("maximin", 10))(lambda spark, d: selection.select_greedy_maximin(part_points(spark, d), 10, _origin(spark)).select("pos", "point_id"))
query("greedy_maximin_40", _greedy_sql("maximin", 40))(lambda spark, d: selection.select_greedy_maximin(part_points(spark, d), 40, _origin(spark)).select("pos", "point_id"))
query("greedy_maxisum", _greedy_sql("maxisum", 10))(lambda spark, d: selection.select_greedy_maxisum(part_points(spark, d), 10, _origin(spark)).select("pos", "point_id"))
query("greedy_energy", _greedy_sql("energy", 10))(lambda spark, d: selection.select_greedy_energy(part_points(spark, d), 10, 2, _origin(spark)).select("pos", "point_id"))


def _psa_sql(k: int) -> str:
    """Bisection as one common table after another: bounds, the widest cluster, and the points with their clusters."""
    ctes = [P2, "c1 AS (SELECT *, 0 AS c FROM p2)"]
    for i in range(1, k):
        ctes += [
            f"b{i} AS MATERIALIZED (SELECT c, min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy, greatest(max(x) - min(x), max(y) - min(y)) AS e FROM c{i} GROUP BY c)",
            f"w{i} AS MATERIALIZED (SELECT *, hx - lx >= hy - ly AS by_x FROM b{i} ORDER BY e DESC, c LIMIT 1)",
            f"c{i + 1} AS MATERIALIZED (SELECT p.id, p.x, p.y, CASE WHEN p.c = w.c AND CASE WHEN by_x THEN p.x >= (lx + hx) / 2 ELSE p.y >= (ly + hy) / 2 END THEN {i} ELSE p.c END AS c FROM c{i} p, w{i} w)",
        ]
    return f"WITH {', '.join(ctes)}"


_BOXES = "z AS (SELECT c, min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy, avg(x) AS mx, avg(y) AS my FROM c8 GROUP BY c)"
_FIRST = "SELECT c::BIGINT AS cluster_id, id AS point_id FROM (SELECT p.c, p.id, row_number() OVER (PARTITION BY p.c ORDER BY {score}, p.id) AS r FROM c8 p JOIN z USING (c)) q WHERE r = 1"
query("psa_assign", _psa_sql(8) + " SELECT c::BIGINT AS cluster_id, id AS point_id FROM c8")(lambda spark, d: selection.psa_partition(part_points(spark, d), 8, 2).select("cluster_id", "point_id"))
query("psa_assign_32", _psa_sql(32) + " SELECT c::BIGINT AS cluster_id, id AS point_id FROM c32")(lambda spark, d: selection.psa_partition(part_points(spark, d), 32, 2).select("cluster_id", "point_id"))
for _name, _target, _score in (
    ("centroid", "centroid_of_hypercube", "sqrt((p.x - (lx + hx) * 0.5) * (p.x - (lx + hx) * 0.5) + (p.y - (ly + hy) * 0.5) * (p.y - (ly + hy) * 0.5))"),
    ("boundary", "max_dist_from_boundary", "-least(p.x - lx, hx - p.x, p.y - ly, hy - p.y)"),
):
    query(f"psa_select_{_name}", f"{_psa_sql(8)}, {_BOXES} {_FIRST.format(score=_score)}")(lambda spark, d, t=_target: selection.psa_select(part_points(spark, d), 8, 2, t).select("cluster_id", "point_id"))
query("psa_select_mass", f"{_psa_sql(8)}, {_BOXES} {_FIRST.format(score='sqrt((p.x - mx) * (p.x - mx) + (p.y - my) * (p.y - my))')}")(lambda spark, d: selection.psa_select(part_points(spark, d), 8, 2, "center_of_mass").select("cluster_id", "point_id"))
query("closest_point", f"WITH {P2} SELECT id AS point_id, round(sqrt((x - 0.5) * (x - 0.5) + (y - 0.5) * (y - 0.5)), 6) AS dist FROM p2 ORDER BY sqrt((x - 0.5) * (x - 0.5) + (y - 0.5) * (y - 0.5)), id LIMIT 1")(lambda spark, d: rounded(selection.closest_point(part_points(spark, d), [0.5, 0.5]).select("point_id", "dist"), "dist"))

# strata, designs and sampling

query("strata_2d", f"""
{_SQUARE} SELECT i AS stratum_id, round((i // k) / k::DOUBLE, 6) AS lo0, round((i % k) / k::DOUBLE, 6) AS lo1, round((i // k + 1) / k::DOUBLE, 6) AS hi0, round((i % k + 1) / k::DOUBLE, 6) AS hi1 FROM g
""")(lambda spark, d: strata.stratify_conventional(spark, _side(spark, d) ** 2, 2).select("stratum_id", *[F.round(F.get(c, j), 6).alias(f"{c}{j}") for c in ("lo", "hi") for j in (0, 1)]))


def _volume() -> Column:
    return F.aggregate(F.zip_with("hi", "lo", lambda h, l: h - l), F.lit(1.0), lambda p, s: p * s)


query("strata_generalized_audit", f"SELECT n, round(1 / n::DOUBLE, 9) AS least, round(1 / n::DOUBLE, 9) AS most, 1.0::DOUBLE AS total FROM {_CUSTOMERS}")(
    lambda spark, d: strata.stratify_generalized(spark, _count(spark, d, "customer"), 3, 11).withColumn("v", _volume()).agg(F.count("*").alias("n"), F.round(F.min("v"), 9).alias("least"), F.round(F.max("v"), 9).alias("most"), F.round(F.sum("v"), 9).alias("total"))
)
query("stratified_centres", f"""
{_SQUARE} SELECT i AS point_id, d::BIGINT AS dim, round((CASE d WHEN 0 THEN i // k ELSE i % k END + 0.5::DOUBLE) / k, 6) AS v FROM g, range(0, 2) u(d)
""")(lambda spark, d: by_coordinate(strata.stratified_sampling(strata.stratify_conventional(spark, _side(spark, d) ** 2, 2), 1, math.inf)))


def _in_strata(spark: SparkSession, n: int, latin: str, bates: float = 1) -> DataFrame:
    boxes = strata.stratify_generalized(spark, n, 2, 5)
    inside = F.forall(F.arrays_zip("coords", "lo", "hi"), lambda s: (s["coords"] >= s["lo"]) & (s["coords"] <= s["hi"]))
    sampled = strata.stratified_sampling(boxes, 9, bates, latin).join(boxes.withColumnRenamed("stratum_id", "point_id"), "point_id")
    binned = [F.count_distinct(F.floor(F.get("coords", j) * n)) for j in (0, 1)]
    return sampled.agg(F.count("*").alias("n"), F.bool_and(inside).alias("inside"), (F.least(*binned) == n if latin == "matching" else F.lit(True)).alias("latin"))


for _latin, _bates in (("none", 1), ("none", 3), ("approx", 1), ("matching", 1)):
    query(f"stratified_{_latin}{'_bates' if _bates > 1 else ''}_audit", "SELECT count(*) AS n, true AS inside, true AS latin FROM supplier")(lambda spark, d, l=_latin, b=_bates: _in_strata(spark, _count(spark, d, "supplier"), l, b))

query("strata_from_points_audit", "SELECT count(*) AS n, true AS inside, 1.0::DOUBLE AS total FROM (SELECT DISTINCT s_acctbal, s_nationkey FROM supplier) s")(
    lambda spark, d: _around(_supplier_places(spark, d))
)
query("strata_from_all_points_audit", f"WITH {P2} SELECT count(*) AS n, true AS inside, 1.0::DOUBLE AS total FROM p2")(
    lambda spark, d: _around(part_points(spark, d))
)


def _supplier_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as points (balance, nation) of the unit square; equal points once."""
    places = _table(spark, sf_dir, "supplier").groupBy("s_acctbal", "s_nationkey").agg(F.min("s_suppkey").alias("s_suppkey"))
    return transforms.scaled(points_from(places, "s_suppkey", "s_acctbal", "s_nationkey"), ([-1000.0, 0.0], [10000.0, 24.0]), ([0.0, 0.0], [1.0, 1.0]))


def _around(points: DataFrame) -> DataFrame:
    boxes = strata.reconstruct_strata_from_points(points, 2, 3)
    inside = F.forall(F.arrays_zip("coords", "lo", "hi"), lambda s: (s["coords"] >= s["lo"]) & (s["coords"] <= s["hi"]))
    return boxes.join(points.withColumnRenamed("point_id", "stratum_id"), "stratum_id").agg(F.count("*").alias("n"), F.bool_and(inside).alias("inside"), F.round(F.sum(_volume()), 6).alias("total"))


def _columns(design: DataFrame) -> DataFrame:
    return design.select("point_id", F.posexplode("bins").alias("dim", "v")).groupBy(F.col("dim").cast("long").alias("dim")).agg(F.count("*").alias("n"), F.count_distinct("v").alias("distinct_values"), F.min("v").cast("long").alias("low"), F.max("v").cast("long").alias("high"))


def _permutations_sql(n: str, dims: int) -> str:
    return f"WITH n AS (SELECT {n} AS n) SELECT d AS dim, n, n AS distinct_values, 0::BIGINT AS low, n - 1 AS high FROM n, range(0, {dims}) t(d)"


query("lhd_random_audit", _permutations_sql("(SELECT count(*) FROM customer)", 3))(lambda spark, d: _columns(designs.lhd(spark, _count(spark, d, "customer"), 3, 4)))
query("lhd_plain_audit", _permutations_sql("(SELECT count(*) FROM supplier)", 2))(lambda spark, d: _columns(designs.lhd(spark, _count(spark, d, "supplier"), 2, 4, identity_first=True)))
query("lhd_sudoku_audit", _permutations_sql("(SELECT count(*) // 9 * 9 FROM customer)", 2))(lambda spark, d: _columns(designs.sudoku(spark, 2, 3, _count(spark, d, "customer") // 9, 8)))
query("lhd_sudoku_boxes_audit", "SELECT 9::BIGINT AS boxes, count(*) // 9 AS least, count(*) // 9 AS most FROM customer")(lambda spark, d: _per_box(designs.sudoku(spark, 2, 3, _count(spark, d, "customer") // 9, 8), _count(spark, d, "customer") // 9 * 3))


def _per_box(design: DataFrame, side: int) -> DataFrame:
    boxes = design.groupBy(F.floor(F.get("bins", 0) / side).alias("a"), F.floor(F.get("bins", 1) / side).alias("b")).count()
    return boxes.agg(F.count("*").alias("boxes"), F.min("count").alias("least"), F.max("count").alias("most"))


query("lhd_improved_audit", _permutations_sql("(SELECT count(*) FROM nation)", 2))(lambda spark, d: _columns(designs.improved_lhd(spark, _count(spark, d, "nation"), 2, 6)))
query("random_uniform_audit", "SELECT count(*) AS n, true AS in_cube, true AS centred FROM orders")(
    lambda spark, d: sequences.random_uniform(spark, _count(spark, d, "orders"), 2, 3).agg(F.count("*").alias("n"), F.bool_and(F.forall("coords", lambda x: (x >= 0) & (x < 1))).alias("in_cube"), (F.abs(F.avg(F.get("coords", 0)) - 0.5) < 0.03).alias("centred"))
)


def _values(df: DataFrame, below: int) -> DataFrame:
    return df.agg(F.count("*").alias("n"), F.count_distinct("value").alias("distinct_values"), ((F.min("value") >= 0) & (F.max("value") < below)).alias("in_range"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))


def _drawn(spark: SparkSession, sf_dir: str, method: str) -> DataFrame:
    """As many values as there are suppliers, below the number of customers; the quadratic design of one value for each nation."""
    below, n = (_count(spark, sf_dir, t) for t in (("nation", "nation") if method == "latin_improved" else ("customer", "supplier")))
    return _values(getattr(randomizer.Randomizer(spark, below, n, 3), method)(), below)


for _name in ("uniform_mersenne", "uniform_crypto", "latin_matrix", "latin_improved", "latin_sudoku"):
    query(f"{_name}_audit", f"SELECT count(*) AS n, count(*) AS distinct_values, true AS in_range, 0::BIGINT AS first_pos, count(*) - 1 AS last_pos FROM {'nation' if _name == 'latin_improved' else 'supplier'}")(lambda spark, d, m=_name: _drawn(spark, d, m))

query("random_alpha_audit", "SELECT count(*) AS n, true AS letters FROM supplier")(lambda spark, d: randomizer.random_alpha(spark, _count(spark, d, "supplier"), 5).select(F.length("letters").cast("long").alias("n"), F.col("letters").rlike("^[a-z]+$").alias("letters")))


def _improved(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """Points begun from the middles of brands, which lie close together."""
    middles = brand_points(spark, sf_dir).groupBy("brand").agg(*[F.avg(F.get("coords", j)).alias(f"x{j}") for j in (0, 1)])
    start = ranked(middles, F.col("brand")).select(F.col("pos").alias("point_id"), F.array("x0", "x1").alias("coords"))
    better = refine.random_k_means(start, 2, 400) if kind == "means" else refine.maximin_reconstruction(start, 2, 400)
    metric = Metric(2.0) if kind == "means" else unit_torus(2)
    before, after = indicators.separation_dist(start, metric), indicators.separation_dist(better.drop("restart"), metric)
    counted = better.agg(F.count("*").alias("n"), F.bool_and(F.forall("coords", lambda x: (x >= 0) & (x <= 1))).alias("in_cube"))
    gained = after.withColumnRenamed("value", "after").crossJoin(F.broadcast(before)).select((F.col("after") >= F.col("value")).alias("not_lower"))
    if kind != "means":
        return counted.crossJoin(F.broadcast(gained))
    # means move towards what is nearest to them, so that a grid of probes lies nearer to them than to the start
    probes = designs.sukharev_grid(spark, 400, 2)
    spread = lambda centres: indicators.nearest(probes, centres).agg(F.avg(F.col("dist") * F.col("dist")).alias("spread"))
    nearer = spread(start).crossJoin(F.broadcast(spread(better.drop("restart")).withColumnRenamed("spread", "after"))).select((F.col("after") < F.col("spread")).alias("nearer"))
    return counted.crossJoin(F.broadcast(nearer))  # one row each


query("random_k_means_audit", "SELECT count(DISTINCT p_brand) AS n, true AS in_cube, true AS nearer FROM part")(lambda spark, d: _improved(spark, d, "means"))
query("maximin_reconstruction_audit", "SELECT count(DISTINCT p_brand) AS n, true AS in_cube, true AS not_lower FROM part")(lambda spark, d: _improved(spark, d, "maximin"))

# entropy

_WORDS = "w AS (SELECT event_id AS pos, (event_id * 40503 + user_id * 257) % 65536 AS word FROM events)"


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of 16 bits, one of each event, in the shape that the entropy source has."""
    return _table(spark, sf_dir, "events").select(F.col("event_id").alias("pos"), ((F.col("event_id") * 40503 + F.col("user_id") * 257) % 65536).alias("word"))


query("entropy_randint", f"WITH {_WORDS} SELECT pos, round(word / (65535 / 100.0::DOUBLE), 6) AS value FROM w WHERE word < 65535")(lambda spark, d: rounded(entropy.randint(_words(spark, d), 0, 100)))
query("entropy_randint_wide", f"WITH {_WORDS}, p AS (SELECT pos // 2 AS pos, max(word) FILTER (pos % 2 = 0) * 65536 + max(word) FILTER (pos % 2 = 1) AS n FROM w GROUP BY 1 HAVING count(*) = 2) SELECT pos, round(n / (4294967295 / 1000000.0::DOUBLE) + 5, 4) AS value FROM p WHERE n < 4294967295")(lambda spark, d: entropy.randint(_words(spark, d), 5, 1_000_005).withColumn("value", F.round("value", 4)))
query("entropy_hex", f"WITH {_WORDS} SELECT string_agg(lower(format('{{:04x}}', word)), '' ORDER BY pos) AS hex, 2 * count(*) AS n_bytes FROM w")(lambda spark, d: entropy.hex_text(_words(spark, d).select("pos", F.lower(F.lpad(F.hex("word"), 4, "0")).alias("block"))).select("hex", F.octet_length("bytes").cast("long").alias("n_bytes")))
query("index_quantum", f"WITH {_WORDS}, k AS (SELECT pos, floor(word / (65535 / 100.0::DOUBLE))::BIGINT AS value FROM w WHERE word < 65535) SELECT (row_number() OVER (ORDER BY pos) - 1)::BIGINT AS pos, value FROM k ORDER BY pos LIMIT (SELECT count(*) // 2 FROM events)")(lambda spark, d: randomizer.Randomizer(spark, 100, _count(spark, d, "events") // 2).quantum(_words(spark, d)))
query("index_ambience_audit", "SELECT count(DISTINCT o_custkey) AS n, count(DISTINCT o_custkey) AS distinct_values FROM orders")(
    lambda spark, d: randomizer.Randomizer(spark, _count(spark, d, "customer"), 1).ambience(_table(spark, d, "orders").select(F.col("o_custkey").alias("value")), whole=True).agg(F.count("*").alias("n"), F.count_distinct("value").alias("distinct_values"))
)


@query("entropy_sink", f"WITH {_WORDS} SELECT count(*) AS n, sum(word)::BIGINT AS total, max(pos) AS last FROM w")
def _written_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of events, written by the sink into the shared folder and read from its files."""
    entropy.register(spark)
    path = f"{shared_folder(spark)}/words-{uuid.uuid4().hex}"
    _words(spark, sf_dir).write.format("entropy").mode("append").save(path)
    return spark.read.schema("pos long, word long").csv(path).agg(F.count("*").alias("n"), F.sum("word").alias("total"), F.max("pos").alias("last"))


@query("running_centres_audit", "SELECT 3 AS n, round(count(*) + 3.0::DOUBLE, 6) AS weight, round((sum(value) + 550) / (count(*) + 3), 6) AS mean FROM events")
def _centres_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centres of a stream of all event values: means keep the sum of what they have taken in, the first centres included."""
    events, root = _table(spark, sf_dir, "events"), f"{shared_folder(spark)}/centres-{uuid.uuid4().hex}"
    initial = spark.createDataFrame([(0, [0.0], 1.0), (1, [50.0], 1.0), (2, [500.0], 1.0)], "centre long, coords array<double>, weight double")
    stream = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events.parquet*").select(F.col("event_id").alias("point_id"), F.array("value").alias("coords"))
    name, schema = "spark.sql.streaming.stateStore.providerClass", "shard long, centre long, coords array<double>, weight double"
    before = spark.conf.get(name)
    spark.conf.set(name, means.STORE)
    try:
        centres = means.centres_from(stream, initial).writeStream.outputMode("update").foreachBatch(lambda given, _: given.write.mode("append").parquet(f"{root}/given"))
        centres.option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(name, before)
    merged = means.merged_centres(spark.read.schema(schema).parquet(f"{root}/given"), initial)
    x = F.get("coords", 0)
    return rounded(merged.agg(F.count("*").cast("int").alias("n"), F.sum("weight").alias("weight"), (F.sum(F.col("weight") * x) / F.sum("weight")).alias("mean")), "weight", "mean")


# matching

query("match_orders_parts_audit", "SELECT count(DISTINCT l_partkey) AS size, true AS proper, true AS largest FROM lineitem")(lambda spark, d: _best_match(spark, d))


def _best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders matched with parts they hold: there are so many orders that each part has one of its own, as a cover proves."""
    edges = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("left"), F.col("l_partkey").alias("right"))
    return matching.certificate(edges, matching.bipartite_match(edges))
