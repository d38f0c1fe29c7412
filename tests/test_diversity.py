import numpy as np
import pytest

from pointloom.functions.metrics import EUCLIDEAN, MANHATTAN, Metric
from pointloom.operators import indicators

SMALL = "/root/testdata/sf0.001"


def dense(x, metric=EUCLIDEAN, activity=1.0):
    return float(np.linalg.pinv(np.exp(-activity * metric.matrix(x, x)), hermitian=True).sum())


def test_products_give_what_the_inverse_gives(spark, monkeypatch):
    """All embeddings, and each label, by conjugate gradients over cells of pairs."""
    monkeypatch.setitem(indicators.EXACT_POINTS, "solow_polasky", 20)
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").selectExpr("vec_id AS point_id", "CAST(embedding AS array<double>) AS coords", "label").cache()
    own = rows.collect()
    x, label = np.array([r.coords for r in own]), np.array([r.label for r in own])
    assert abs(indicators.solow_polasky_diversity(rows).first()[0] - dense(x)) < 1e-6
    got = {r.label: r.value for r in indicators.solow_polasky_diversity(rows, by="label").collect()}
    assert set(got) == set(label) and all(abs(v - dense(x[label == k])) < 1e-6 for k, v in got.items())


def test_points_at_one_place_are_one(spark, monkeypatch):
    x = np.random.default_rng(2).random((25, 2))
    frame = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(np.concatenate([x, x[:9]]))], "point_id long, coords array<double>")
    want = dense(np.concatenate([x, x[:9]]), MANHATTAN, 3.0)
    assert indicators.solow_polasky_diversity(frame, 3.0, MANHATTAN).first()[0] == pytest.approx(want, abs=1e-6)
    # far apart by their activity, so that few steps settle it
    want = dense(np.concatenate([x, x[:9]]), MANHATTAN, 80.0)
    monkeypatch.setitem(indicators.EXACT_POINTS, "solow_polasky", 5)
    assert indicators.solow_polasky_diversity(frame, 80.0, MANHATTAN).first()[0] == pytest.approx(want, abs=1e-6)


def test_weitzman_by_groups(spark):
    rows = [(i, [float(i * i), 0.0], i // 3) for i in range(8)]
    got = {r.g: r.value for r in indicators.weitzman_diversity(spark.createDataFrame(rows, "point_id long, coords array<double>, g int"), by="g").collect()}
    assert got == {0: 1 + 1 + 4, 1: 1 + 7 + 16, 2: 1 + 13}


def test_small_groups_share_a_call(spark, monkeypatch):
    # one call for each group took milliseconds a group
    monkeypatch.setattr(indicators, "TOGETHER", 10)
    calls = spark.sparkContext.accumulator(0)

    class Counted(Metric):
        def matrix(self, a, b):
            calls.add(1)
            return super().matrix(a, b)

    rng = np.random.default_rng(5)
    x = rng.random((600, 2))
    rows = spark.createDataFrame([(int(i), str(i // 3 if i < 300 else 200 + i // 2), x[i].tolist()) for i in rng.permutation(600)], "point_id long, g string, coords array<double>")
    got = {r.g: r.value for r in indicators.solow_polasky_diversity(rows, metric=Counted(2.0), by="g").collect()}
    assert len(got) == 250 and calls.value < 200
    for g, at in (("0", range(3)), ("99", range(297, 300)), ("350", range(300, 302)), ("499", range(598, 600))):
        assert got[g] == pytest.approx(dense(x[list(at)]), abs=1e-12)


def test_close_places_take_few_steps(spark, monkeypatch):
    """A sample of the places takes the large eigenvalues out of the steps; without it these take 81."""
    monkeypatch.setitem(indicators.EXACT_POINTS, "solow_polasky", 20)
    steps = []
    stored = indicators.stored
    monkeypatch.setattr(indicators, "stored", lambda df, *a, **b: steps.append("q" in df.columns) or stored(df, *a, **b))
    x = np.random.default_rng(8).random((100, 2))
    frame = spark.createDataFrame([(i, p) for i, p in enumerate(x.tolist())], "point_id long, coords array<double>")
    assert abs(indicators.solow_polasky_diversity(frame).first()[0] - dense(x)) < 1e-6
    assert sum(steps) < 50
