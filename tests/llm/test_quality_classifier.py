import numpy as np
from pyspark.sql import functions as F

from pointloom.llm import quality_classifier as C
from pyspark.sql import functions as F

from pointloom.llm.frames import FIT_CHARS, bounded_sample, fitting_rows
from tests.llm.conftest import EDGES


def test_held_out_accuracy(spark, documents, small):
    labels = spark.read.parquet(f"{small}/labels.parquet")
    fold = F.crc32(F.col("doc_id").cast("string")) % 3
    model = C.fit_from(documents, labels.where(fold != 0))
    held = C.score_quality(documents, model).join(labels.where(fold == 0), "doc_id").toPandas()
    assert ((held.score >= C.DECISION) == (held.quality == 1)).mean() > 0.85


def plain(model, text):
    """Score of one text, token by token."""
    words = (text or "").split()
    out = np.zeros(C.DIMENSIONS + len(C.SHAPES))
    if words:
        tokens = [t for w in words for t in C.Tokens().of(w)]
        for t in tokens:
            if t in model.vocabulary:
                out[: C.DIMENSIONS] += model.vectors[model.vocabulary[t]] / len(tokens)
        for k, shape in enumerate(C.SHAPES):
            n = sum(a == b for a, b in zip(words, words[1:])) if shape == "<same>" else tokens.count(shape)
            out[C.DIMENSIONS + k] = n / len(words)
    w1, b1, w2, b2 = model.layers
    hidden = [np.tanh(sum(x * w for x, w in zip(out, column)) + b) for column, b in zip(w1.T, b1)]
    return 1 / (1 + np.exp(-(sum(h * w for h, w in zip(hidden, w2[:, 0])) + b2[0]) / model.temperature))


def test_scores_equal_the_plain_network(spark, documents, rows, edges, small):
    model = C.fit_from(documents, spark.read.parquet(f"{small}/labels.parquet"))
    for frame, texts in ((documents, rows), (edges, EDGES)):
        got = sorted(((str(r.doc_id), r.score) for r in C.score_quality(frame, model).collect()))
        want = sorted((str(i), float(plain(model, t))) for i, t in texts)
        assert [g[0] for g in got] == [w[0] for w in want] and np.allclose([g[1] for g in got], [w[1] for w in want], atol=1e-4)


def test_vectors_sum_the_index_vectors_of_neighbours():
    vocabulary, vectors = C.word_vectors(["red blue red green", "blue red"])
    streams = [["red", "<lower>", "blue", "<lower>", "red", "<lower>", "green", "<lower>"], ["blue", "<lower>", "red", "<lower>"]]
    assert set(vocabulary) == {"red", "blue", "<lower>"}
    for token, at in vocabulary.items():
        total = C.index_vector(token).astype(float)
        for stream in streams:
            known = [t for t in stream if t in vocabulary]
            for i, t in enumerate(known):
                if t == token:
                    total += sum(C.index_vector(known[j]) for j in range(max(0, i - C.WINDOW), min(len(known), i + C.WINDOW + 1)) if j != i)
        assert np.allclose(vectors[at], total / np.linalg.norm(total), atol=1e-5)


def test_fitting_rows_are_bounded(spark):
    docs = spark.createDataFrame([(i % 5, "x" * 100 * (1 + i // 5), "w") for i in range(15)] + [(7, None, "w")], "doc_id long, text string, value string")
    sample = spark.createDataFrame([(i, i) for i in range(8)], "doc_id long, value int")
    assert sorted((r.doc_id, len(r.text)) for r in fitting_rows(docs, sample, 10_000).collect()) == [(i, 100) for i in range(5)]
    assert [len(r.text) for r in fitting_rows(docs, sample, 70).collect()] == [70] * 5


def test_one_long_text_takes_no_room_from_others(spark, documents):
    """A text of twice what a model is fitted on, first in the order of the sample, leaves the others in it."""
    first = min(range(10**6, 10**6 + 50), key=lambda i: spark.range(1).select(F.xxhash64(F.lit(i).cast("long"), F.lit(11))).first()[0])
    labels = documents.select("doc_id", F.pmod("doc_id", F.lit(2)).cast("int").alias("quality"))
    huge = spark.createDataFrame([(first, "ab " * (1 << 21), "en", "s", 0)], documents.schema)
    more = labels.unionAll(spark.createDataFrame([(first, 1)], labels.schema))
    rows = {r.doc_id: r.text for r in fitting_rows(documents.unionAll(huge), bounded_sample(more, "quality", 4000)).collect()}
    assert len(rows) == documents.where("text IS NOT NULL").count() + 1 and len(rows[first]) == FIT_CHARS


def test_edges(edges):
    model = C.fit(["good words here", "bad %%% bad %%%"] * 20, np.array([1.0, 0.0] * 20))
    rows = C.score_quality(edges, model).collect()
    assert len(rows) == edges.count() and all(0 <= r.score <= 1 for r in rows)
    assert C.score_quality(edges.limit(0), model).count() == 0
    assert set(C.fit(["a"], np.array([1.0])).scores(["x", None])) == {0.5}


def test_temperature_is_the_best_of_its_grid():
    rng = np.random.default_rng(0)
    texts = [" ".join(rng.choice(["a", "b", "%%%"], 20, p=[0.4, 0.3, 0.3] if i % 2 else [0.3, 0.3, 0.4])) for i in range(200)]
    model = C.fit(texts, np.arange(200) % 2)
    assert 0.25 <= model.temperature <= 16
