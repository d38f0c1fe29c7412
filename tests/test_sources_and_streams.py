import json

import pytest
from pyspark.sql import functions as F

from pointloom import cli
from pointloom.plans.randomizer import Randomizer
from pointloom.sources import entropy
from pointloom.streaming.means import running_centres

WORDS = "65534,0,1,32768,65535,4096,77,65000"


@pytest.fixture(scope="module")
def words(spark):
    entropy.register(spark)
    return spark.read.format("entropy").option("words", WORDS).option("block", 3).load()


def test_recorded_words(words):
    assert [r.word for r in words.orderBy("pos").collect()] == [int(w) for w in WORDS.split(",")]


def test_randint(words):
    got = {r.pos: int(r.value) for r in entropy.randint(words, 0, 100).collect()}
    assert got[0] == 99 and got[1] == 0 and 4 not in got  # the top word is dropped
    assert {r.value for r in entropy.randint(words, 7, 7).collect()} == {7.0}
    assert len(Randomizer(words.sparkSession, 100, 5).quantum(words).collect()) == 5


def test_responses():
    assert entropy.parse_response(json.dumps({"success": True, "length": 2, "data": ["1", 2]}), "uint16", 2) == [1, 2]
    assert entropy.parse_response(json.dumps({"result": {"random": {"data": [[4, 5]]}}}), "uint16", 2) == [4, 5]
    assert entropy.parse_response(json.dumps({"success": True, "length": 1, "data": ["00ff"]}), "hex16", 1) == ["00ff"]
    with pytest.raises(ValueError):
        entropy.parse_response(json.dumps({"success": False}), "uint16", 1)
    for bad in ({"kind": "uint8"}, {"length": 2000}):
        with pytest.raises(ValueError):
            entropy.fetch("https://localhost", **bad)


def test_hex(spark):
    blocks = spark.createDataFrame([(1, "10aa"), (0, "00ff")], "pos long, block string")
    row = entropy.hex_text(blocks).first()
    assert row.hex == "00ff10aa" and bytes(row.bytes) == bytes.fromhex("00ff10aa")


def test_kinds(spark, words, capsys):
    read = spark.read.format("entropy").option("block", 2)
    assert [r.block for r in read.option("type", "hex16").option("words", "00ff,10aa,7777").load().orderBy("pos").collect()] == ["00ff", "10aa", "7777"]
    assert [tuple(r) for r in read.option("type", "integers").option("words", "5,-1").load().orderBy("pos").collect()] == [(0, 5), (1, -1)]
    cli.main(["--int", "--min", "5", "--max", "6", "--count", "3", "--words", WORDS], spark)
    assert capsys.readouterr().out.split() == ["5"] * 3
    cli.main(["--hex", "--words", "00ff,10aa"], spark)
    assert capsys.readouterr().out.strip() == "00ff10aa"


def test_stream_of_words(spark, words):
    stream = spark.readStream.format("entropy").option("words", WORDS).option("block", 3).load()
    query = stream.writeStream.format("memory").queryName("entropy_words").start()
    try:
        for _ in range(60):
            query.processAllAvailable()
            if spark.table("entropy_words").count() == 8:
                break
        assert sorted(r.pos for r in spark.table("entropy_words").collect()) == list(range(8))
    finally:
        query.stop()


def test_running_centres(spark, tmp_path):
    rows = [(i, [0.1 + 0.01 * (i % 3), 0.1] if i % 2 else [0.9, 0.9]) for i in range(60)]
    source = str(tmp_path / "in")
    spark.createDataFrame(rows, "point_id long, coords array<double>").repartition(2).write.parquet(source)
    stream = spark.readStream.schema("point_id long, coords array<double>").option("maxFilesPerTrigger", 1).parquet(source)
    query = running_centres(stream, [[0.2, 0.2], [0.8, 0.8]], shards=2).writeStream.outputMode("update").format("memory").queryName("centres").option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    last = spark.table("centres").groupBy("shard", "centre").agg(F.max_by("coords", "weight").alias("coords"), F.max("weight").alias("weight")).collect()
    assert sum(r.weight for r in last) == 60 + 4
    assert all(abs(r.coords[1] - (0.1 if r.centre == 0 else 0.9)) < 0.05 for r in last)
