import random
import tracemalloc
from collections import Counter

import numpy as np

from pointloom.llm import decontaminate as D


def shingles(text):
    w = text.lower().split()
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def test_planted_passages_are_found_as_brute_force_says(spark, small):
    benchmark = spark.read.parquet(f"{small}/benchmark.parquet")
    items = [(r.item_id, r.text) for r in benchmark.collect()]
    rng = random.Random(3)
    words = [f"q{i}" for i in range(3000)]
    docs, expected = [], set()
    for i in range(300):
        item, text = rng.choice(items)
        w = text.split()
        for _ in range(rng.choice([0, 1, 2])):
            w[rng.randrange(len(w))] = rng.choice(words)
        docs.append((i, " ".join(rng.choices(words, k=rng.randint(0, 90)) + w + rng.choices(words, k=rng.randint(0, 90)))))
        a, b = shingles(" ".join(w)), shingles(text)
        if sum((a & b).values()) >= 0.75 * sum((a | b).values()):
            expected.add((i, item))
    found = D.leaks(spark.createDataFrame(docs, "doc_id long, text string"), benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in found} == expected
    few = D.leaks(spark.createDataFrame(docs, "doc_id long, text string"), benchmark, items_per_pass=5).collect()
    assert {(r.doc_id, r.item_id) for r in few} == expected


def test_every_window_of_every_document(spark):
    """All item-sized windows of all documents against all items: the best window of a passage, and no other document."""
    rng = random.Random(6)
    items = [(i, " ".join(rng.choices("abcdefghijklmnop", k=rng.randint(5, 14)))) for i in range(25)] + [(30, "a b " * 6), (31, "b a " * 6), (32, "a b " * 6)]
    docs = []
    for i in range(60):
        w = rng.choices("abcdefghijklmnop", k=rng.randint(0, 12))
        for _ in range(rng.randint(0, 3)):
            own = rng.choice(items)[1].split()
            if rng.random() < 0.5:
                own[rng.randrange(len(own))] = rng.choice("xyz")
            w += own + rng.choices("abcdefghijklmnop", k=rng.randint(0, 3))
        docs.append((i, " ".join(w)))
    want = {}
    for d, text in docs:
        w = text.split()
        for item, t in items:
            k = min(len(t.split()), len(w))
            for s in range(len(w) - k + 1):
                a, b = shingles(" ".join(w[s : s + k])), shingles(t)
                both = sum((a & b).values())
                if both and both / (sum(a.values()) + sum(b.values()) - both) >= 0.75:
                    want.setdefault((d, item), {})[s] = both / (sum(a.values()) + sum(b.values()) - both)
    got = {}
    for r in D.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect():
        got.setdefault((r.doc_id, r.item_id), {})[r.first_word] = r.similarity
    assert got.keys() == want.keys() and len(want) > 30
    for key, found in got.items():
        assert found.items() <= want[key].items() and max(found.values()) == max(want[key].values())


def test_long_texts_take_little_memory():
    """An item over and over: bits of a bounded run of shingles are held."""
    item = " ".join(f"w{i}" for i in range(40))
    items = D.Items.of([(1, item)])
    ((_, texts),) = list(D.slices(D.pa.array([" ".join([item] * 200)]), 1 << 30))
    tracemalloc.start()
    assert len(D.find_leaks(texts, items)) == 200
    assert tracemalloc.get_traced_memory()[1] < 60 << 20
    tracemalloc.stop()


def test_index_finds_every_fingerprint_within_the_radius():
    rng = np.random.default_rng(4)
    items = D.Items.of([(i, " ".join(rng.choice(list("abcdefghij"), 12))) for i in range(60)])
    probes = items.fingerprints[rng.integers(0, len(items.ids), 400)].copy()
    for k in range(len(probes)):
        for bit in rng.choice(64, rng.integers(0, 30), replace=False):
            probes[k] ^= np.uint64(1) << np.uint64(bit)
    place, item, _ = items.within(probes)
    apart = np.bitwise_count(probes[:, None] ^ items.fingerprints[None])
    assert set(zip(place.tolist(), item.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(apart <= D.RADIUS))))


def test_similar_windows_far_apart_in_bits_are_found(spark):
    """Two shingles by turns, four and three times in the item and the other way round in the document: 6 of 8 agree."""
    item, other = "ping pong " * 5 + "ping", "pong ping " * 5 + "pong"
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    (found,) = D.leaks(spark.createDataFrame([(7, other)], "doc_id long, text string"), benchmark).collect()
    assert (found.doc_id, found.item_id, found.first_word, found.end_word, found.similarity) == (7, 1, 0, 11, 0.75)
    assert found.distance > D.RADIUS


def test_edges(spark, edges, small):
    benchmark = spark.read.parquet(f"{small}/benchmark.parquet")
    assert D.leaks(edges, benchmark).count() == 0
    assert D.leaks(edges, benchmark.limit(0)).count() == 0
    assert D.leaks(edges.limit(0), benchmark).count() == 0
    assert D.drop_leaking(edges, benchmark).columns == edges.columns
    short = spark.createDataFrame([(1, "one two"), (2, None), (3, "The quick brown fox jumps over the lazy dog.")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in D.leaks(edges, short).collect()} == {(7, 3)}
    assert D.drop_leaking(edges, short).where("doc_id = 7").count() == 0


def planted(rng, words):
    """Items of 60 words, and documents that hold them with some words changed."""
    items = [(i, " ".join(rng.choices(words, k=60))) for i in range(200)]
    texts = []
    for _, t in items:
        w = t.split()
        for at in rng.sample(range(60), rng.randint(0, 2)):
            w[at] = "changed"
        texts.append(" ".join(rng.choices(words, k=30) + w + rng.choices(words, k=30)))
    return D.Items.of(items), texts


def test_tables_propose_the_items(monkeypatch):
    """What is found comes from the tables: nearly all similar passages, and none where the tables are empty."""
    rng = random.Random(8)
    items, texts = planted(rng, [f"v{i}" for i in range(5000)])
    ((_, batch),) = list(D.slices(D.pa.array(texts), 1 << 30))
    found = {(d, item) for d, item, *_ in D.find_leaks(batch, items)}
    want = {(i, int(k)) for i, k in enumerate(items.ids) if max(items.similarity(i, g) for g in _windows(texts[i])) >= D.SIMILARITY}
    assert len(found & want) >= 0.98 * len(want) and found <= want and len(want) > 100
    none = np.zeros(0, np.int64)
    monkeypatch.setattr(D.Items, "within", lambda self, prints: (none, none, none))
    assert not D.find_leaks(batch, items)


def _windows(text):
    ((_, one),) = list(D.slices(D.pa.array([text])))
    g = D.grams(one.lowered().words().hashes(), 5)
    return [g[s : s + 56] for s in range(len(g) - 55)]


def test_many_repeats_in_one_text():
    import time

    item = " ".join(f"w{i}" for i in range(12))
    items = D.Items.of([(1, item), (2, " ".join(f"u{i}" for i in range(60)))])
    ((_, texts),) = list(D.slices(D.pa.array([" ".join([item] * 20_000)]), 1 << 30))
    start = time.time()
    found = D.find_leaks(texts, items)
    assert len(found) == 20_000 and time.time() - start < 5
