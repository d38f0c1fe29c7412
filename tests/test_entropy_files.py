"""Live streams that start again, and the sink: what a failure leaves behind."""

import glob
import itertools
import json
import os
import threading
from concurrent.futures import ThreadPoolExecutor
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from pointloom.sources import entropy
from pointloom.sources.blocklog import BlockLog


@pytest.fixture
def service():
    """A service on this machine that never gives the same words twice."""
    numbers = itertools.count()

    class Answer(BaseHTTPRequestHandler):
        def do_GET(self):
            n = int(parse_qs(urlparse(self.path).query)["length"][0])
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps({"success": True, "length": n, "data": [next(numbers) for _ in range(n)]}).encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/"
    server.shutdown()


def test_a_live_stream_goes_on_where_it_was(spark, service, tmp_path):
    entropy.register(spark)
    seen: dict[int, list] = {}
    fails = [2]

    def note(frame, batch):
        seen.setdefault(batch, []).append(sorted((r.pos, r.word) for r in frame.collect()))
        if batch in fails:
            fails.remove(batch)
            raise RuntimeError("lost")

    def start():
        stream = spark.readStream.format("entropy").option("url", service).option("block", 4).option("blocks", 9).option("trigger", 2).option("log", str(tmp_path / "log")).load()
        return stream.writeStream.foreachBatch(note).option("checkpointLocation", str(tmp_path / "state")).start()

    with pytest.raises(Exception, match="lost"):
        start().processAllAvailable()
    query = start()
    query.processAllAvailable()
    query.stop()
    assert len(seen[2]) == 2 and seen[2][0] == seen[2][1]  # the batch that was lost came again with its first values
    rows = [row for batch in seen.values() for row in batch[-1]]
    assert sorted(p for p, _ in rows) == list(range(36)) and len({w for _, w in rows}) == 36
    assert len(os.listdir(tmp_path / "log")) <= 2  # what is committed is forgotten


def test_a_live_stream_needs_a_log(spark, service):
    entropy.register(spark)
    with pytest.raises(Exception, match="log"):
        spark.readStream.format("entropy").option("url", service).load().writeStream.format("noop").start().processAllAvailable()
    with pytest.raises(ValueError):
        BlockLog("somewhere")


def test_the_first_of_several_tasks_gives_a_block(tmp_path):
    log, numbers = BlockLog(f"file:{tmp_path}/log"), itertools.count()
    with ThreadPoolExecutor(16) as pool:
        served = list(pool.map(lambda _: log.values(7, lambda: [next(numbers)]), range(64)))
    assert len({v[0] for v in served}) == 1 and log.count() == 8 and len(os.listdir(tmp_path / "log")) == 1
    with pytest.raises(RuntimeError):
        log.values(8, lambda: (_ for _ in ()).throw(RuntimeError()))
    assert log.count() == 8 and len(os.listdir(tmp_path / "log")) == 1


def words(spark, n, parts=3):
    entropy.register(spark)
    return spark.range(0, n, 1, parts).select(F.col("id").alias("pos"), (F.col("id") * 257 % 65536).cast("int").alias("word"))


def test_forms_and_modes(spark, tmp_path):
    rows = words(spark, 100)
    for form in ("text", "hex", "binary"):
        rows.write.format("entropy").option("form", form).mode("append").save(str(tmp_path / form))
    read = spark.read.schema("pos long, word int").csv(str(tmp_path / "text"))
    assert sorted(map(tuple, read.collect())) == [(i, i * 257) for i in range(100)]
    files = sorted(glob.glob(f"{tmp_path}/binary/*"))
    assert len(files) == 3 and b"".join(open(f, "rb").read() for f in files) == b"".join(bytes([i, i]) for i in range(100))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "hex")).collect()) == [f"{i:02x}" * 2 for i in range(100)]
    for mode, n in (("append", 110), ("overwrite", 10)):
        rows.where("pos < 10").write.format("entropy").mode(mode).save(str(tmp_path / "text"))
        assert spark.read.csv(str(tmp_path / "text")).count() == n


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    rows = words(spark, 100)
    rows.write.format("entropy").mode("append").save(str(tmp_path / "out"))
    before = sorted(os.listdir(tmp_path / "out"))
    for bad in (rows.withColumn("word", F.when(F.col("pos") != 99, F.col("word"))), rows.withColumn("word", F.expr("IF(pos = 99, 70000, word)"))):
        with pytest.raises(Exception):
            bad.write.format("entropy").option("form", "hex").mode("append").save(str(tmp_path / "out"))
        assert sorted(os.listdir(tmp_path / "out")) == before
    for options in ({"form": "other"}, {}):
        with pytest.raises(Exception):
            rows.select("pos").write.format("entropy").options(**options).mode("append").save(str(tmp_path / "out"))


def test_a_stream_into_the_sink_and_again(spark, tmp_path):
    entropy.register(spark)
    given = [str(i) for i in range(20)]

    def run():
        stream = spark.readStream.format("entropy").option("words", ",".join(given)).option("block", 6).load()
        query = stream.writeStream.format("entropy").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).start()
        query.processAllAvailable()
        query.stop()

    run()
    for done in glob.glob(f"{tmp_path}/state/commits/*") + glob.glob(f"{tmp_path}/state/commits/.*crc"):
        os.remove(done)  # as if it had been lost after its files were moved
    run()
    read = spark.read.schema("pos long, word int").csv(str(tmp_path / "out"))
    assert sorted(map(tuple, read.collect())) == [(i, i) for i in range(20)]
    assert not glob.glob(f"{tmp_path}/out/_staging*")
