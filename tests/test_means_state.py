"""Centres as list state against a plain loop over the same points."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.streaming import means

EVENTS = "/root/testdata/sf0.001/events.parquet"


@pytest.fixture
def store(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, means.STORE)
    yield
    spark.conf.set(name, before)


def loop(rows, centres, weight):
    """Centres after all points, one by one."""
    centres, weight = [list(c) for c in centres], [weight] * len(centres)
    for x in rows:
        i = int(np.argmin([sum((a - b) ** 2 for a, b in zip(c, x)) for c in centres]))
        centres[i] = [(weight[i] * a + b) / (weight[i] + 1) for a, b in zip(centres[i], x)]
        weight[i] += 1
    return centres, weight


def replayed(spark, points, initial, shards, folder, parts):
    """All that the stream gives, points arriving in batches of ascending ids."""
    for k in range(parts):
        points.where(F.col("point_id") % parts == k).coalesce(1).write.mode("overwrite").parquet(f"{folder}/in/{k}")
    stream = spark.readStream.schema(points.schema).parquet(f"{folder}/in/*")
    query = means.centres_from(stream, initial, shards).writeStream.outputMode("update").format("memory").queryName("state_centres").option("checkpointLocation", f"{folder}/state").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return spark.table("state_centres")


def test_replay_of_events_equals_a_plain_loop(spark, store, tmp_path):
    events = spark.read.parquet(EVENTS)
    points = events.select(F.col("event_id").alias("point_id"), F.array(F.col("value").cast("double"), (F.col("user_id") % 10).cast("double")).alias("coords"))
    first = [[0.0, 0.0], [100.0, 9.0], [30.0, 4.0]]
    initial = spark.createDataFrame([(i, c, 1.0) for i, c in enumerate(first)], "centre long, coords array<double>, weight double")
    shards = 3
    given = replayed(spark, points, initial, shards, str(tmp_path), 1)
    last = {(r.shard, r.centre): (r.coords, r.weight) for r in given.collect()}
    dealt = points.select(F.pmod(F.xxhash64("point_id"), F.lit(shards)).alias("shard"), "point_id", "coords").orderBy("point_id").collect()
    total, weights = np.zeros((3, 2)), np.zeros(3)
    for shard in range(shards):
        centres, weight = loop([r.coords for r in dealt if r.shard == shard], first, 1 / shards)
        for i in range(3):
            assert np.allclose(last[shard, i][0], centres[i]) and np.isclose(last[shard, i][1], weight[i])
        total += np.array(weight)[:, None] * centres
        weights += weight
    merged = {r.centre: r for r in means.merged_centres(given, initial, shards).collect()}
    assert np.allclose([merged[i].coords for i in range(3)], total / weights[:, None]) and np.isclose(sum(r.weight for r in merged.values()), len(dealt) + 3)


def test_a_stream_goes_on_from_merged_centres(spark, store, tmp_path):
    points = spark.range(40).select(F.col("id").alias("point_id"), F.array(F.col("id") % 2 * 1.0).alias("coords"))
    initial = spark.createDataFrame([(0, [0.1], 1.0), (1, [0.9], 1.0)], "centre long, coords array<double>, weight double")
    first = means.merged_centres(replayed(spark, points, initial, 4, str(tmp_path / "a"), 2), initial, 4)
    one = spark.createDataFrame(first.collect(), initial.schema)
    spark.sql("DROP VIEW IF EXISTS state_centres")
    two = {r.centre: r for r in means.merged_centres(replayed(spark, points, one, 2, str(tmp_path / "b"), 1), one, 2).collect()}
    assert two[0].weight == two[1].weight == 41 and np.isclose(two[0].coords[0], 0.1 / 41) and np.isclose(two[1].coords[0], 40.9 / 41)


def test_shards_without_points_and_the_store(spark, tmp_path):
    initial = spark.createDataFrame([(0, [0.5], 1.0)], "centre long, coords array<double>, weight double")
    none = spark.createDataFrame([], "shard long, centre long, coords array<double>, weight double")
    row = means.merged_centres(none, initial, 4).first()
    assert row.weight == 1.0 and row.coords == [0.5]
    stream = spark.readStream.format("rate").load().select(F.col("value").alias("point_id"), F.array(F.lit(0.5)).alias("coords"))
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass") != means.STORE:
        with pytest.raises(ValueError):
            means.centres_from(stream, initial)
