"""Table functions of SQL against the plans, at bounds of blocks, and in their defined cases."""

import math

import pytest
from pyspark.sql import functions as F

from pointloom.plans import sequences, strata, tablefunctions


@pytest.fixture(scope="module")
def sql(spark):
    tablefunctions.register(spark)
    return lambda text: [tuple(r) for r in spark.sql(text).collect()]


def of_plan(points):
    return sorted((r.point_id, *r.coords) for r in points.collect())


def test_points_are_those_of_the_plans(spark, sql):
    assert sorted(sql("SELECT * FROM halton_points(5, 20000, 3)")) == of_plan(sequences.halton(spark, 20000, 3, 5))
    assert sorted(sql("SELECT * FROM sobol_points(1, 300, 7)")) == of_plan(sequences.sobol(spark, 7, 300))
    lattice = sequences.korobov(spark, 60, 2, 7).select("point_id", F.transform("bins", lambda b: b / 60).alias("coords"))
    assert sorted(sql("SELECT * FROM lattice_points(0, 60, 60, array(1, 7))")) == of_plan(lattice)


def test_boxes_are_those_of_the_plan(spark, sql):
    boxes = sorted((r.stratum_id, *r.lo, *r.hi) for r in strata.stratify_conventional(spark, 64, 3).collect())
    assert [r[0] for r in boxes] == list(range(64))
    for mine, plan in zip(sorted(sql("SELECT * FROM conventional_strata(0, 64, 4, 3)")), boxes, strict=True):
        assert mine == pytest.approx(plan, abs=1e-12)
    assert sql("SELECT x0, x1 FROM sukharev_points(1, 1, 2, 2)") == [(0.25, 0.75)]


def test_columns_follow_the_dimension(spark, sql):
    assert spark.sql("SELECT * FROM halton_points(0, 1, 4)").columns == ["point_id", "x0", "x1", "x2", "x3"]
    assert spark.sql("SELECT * FROM lattice_points(0, 1, 5, array(1, 2))").columns == ["point_id", "x0", "x1"]


def test_lateral_join_takes_sizes_from_rows(sql):
    rows = sql("SELECT g, point_id FROM VALUES ('a', 2L), ('b', 0L), ('c', NULL), ('d', -3L), (NULL, 1L) AS t(g, n), LATERAL halton_points(10L, n, 1)")
    assert sorted(rows, key=str) == sorted([("a", 10), ("a", 11), (None, 10)], key=str)


def test_a_large_group_is_many_blocks(spark):
    """Indices go on over the bounds of blocks, equal rows of sizes stay apart, and groups without rows have none."""
    n = 2 * tablefunctions.BLOCK + 7
    sizes = spark.createDataFrame([("a", n), ("b", 3), ("b", 3), ("none", 0), ("null", None)], "g string, n long")
    made = tablefunctions.generated(sizes, "halton_points({first}, {n}, 2)", 5)
    got = {r.g: r for r in made.groupBy("g").agg(F.count("*").alias("rows"), F.count_distinct("point_id").alias("ids"), F.min("point_id").alias("low"), F.max("point_id").alias("high")).collect()}
    assert set(got) == {"a", "b"}
    assert (got["a"].rows, got["a"].ids, got["a"].low, got["a"].high) == (n, n, 5, n + 4)
    assert (got["b"].rows, got["b"].ids, got["b"].low, got["b"].high) == (6, 3, 5, 7)
    tasks = made.where("g = 'a'").select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks > 1
    plan = sequences.halton(spark, n, 2, 5).select("point_id", "coords")
    assert made.where("g = 'a'").select("point_id", F.array("x0", "x1").alias("coords")).exceptAll(plan).count() == 0


def test_no_sizes_give_no_rows(spark):
    none = spark.createDataFrame([], "g string, n long")
    made = tablefunctions.generated(none, "sobol_points({first}, {n}, 2)", 1)
    assert made.columns == ["g", "n", "point_id", "x0", "x1"] and made.count() == 0


@pytest.mark.parametrize("call", ["halton_points(0, 1, 0)", "sobol_points(0, 1, 41)", "halton_points(-1, 2, 2)", "sukharev_points(0, 1, 0, 2)", "lattice_points(0, 1, 0, array(1))", "lattice_points(0, 1, 4000000000L, array(1))", "halton_points(0, 1, CAST(NULL AS INT))"])
def test_wrong_arguments_raise(sql, call):
    with pytest.raises(Exception, match="must"):
        sql(f"SELECT * FROM {call}")


def test_lattices_of_large_sizes_are_exact(sql):
    size, step = 3_000_000_019, 2_999_999_999
    (_, x), = sql(f"SELECT * FROM lattice_points({size - 2}L, 1, {size}L, array({step}L))")
    assert math.isclose(x, ((size - 2) * step % size) / size, rel_tol=1e-15)
