import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from pointloom.llm import substring_dedup as S
from pointloom.llm.textkernel import slices
from tests.llm.conftest import EDGES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, k):
    first = {}
    for i, t in rows:
        w = WORD.findall(t or "")
        for p in range(len(w) - k + 1):
            if i is not None:
                key = tuple(w[p : p + k])
                first[key] = min(i, first.get(key, i))
    out = []
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = set()
        for p in range(len(w) - k + 1):
            if i is not None and first[tuple(w[p : p + k])] < i:
                gone |= set(range(p, p + k))
        text = " ".join(x for q, x in enumerate(w) if q not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def got(docs, k, **more):
    return sorted((tuple(r) for r in S.substring_dedup(docs, k, **more).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256)).collect()), key=str)


def test_equals_brute_force(spark, documents, rows, edges):
    assert got(documents, 50) == brute(rows, 50)
    assert got(edges, 3) == brute(EDGES, 3)
    rng = random.Random(1)
    made = [(i, " ".join(rng.choices("abc", k=rng.randint(0, 60)))) for i in range(200)]
    docs = spark.createDataFrame(made, "doc_id long, text string").repartition(7)
    assert got(docs, 6) == brute(made, 6)
    # shared passages with other words around them, and one edit here and there
    passages = [[f"p{j}w{q}" for q in range(rng.randint(4, 90))] for j in range(12)]
    made = []
    for i in range(150):
        w = []
        for _ in range(rng.randint(0, 3)):
            own = list(rng.choice(passages))
            if rng.random() < 0.5:
                own[rng.randrange(len(own))] = f"x{rng.randrange(9)}"
            w += own[rng.randrange(len(own)) :] if rng.random() < 0.3 else own
            w += [f"r{rng.randrange(40)}" for _ in range(rng.randint(0, 9))]
        made.append((i // 2 if i % 9 == 0 else i, " ".join(w)))
    docs = spark.createDataFrame(made, "doc_id long, text string").repartition(5)
    for k in (1, 2, 9, 20):
        assert got(docs, k) == brute(made, k)


def test_equal_first_hashes_remove_nothing(spark, monkeypatch):
    """All phrases and windows meet in the first hash: the second one tells them apart."""
    whole = S.Polynomial.of

    def few(self, starts, lens):
        h = whole(self, starts, lens)
        return h if self.which else h & np.uint64(3)

    kept = S.Polynomial.__init__
    monkeypatch.setattr(S.Polynomial, "__init__", lambda self, h, which: (kept(self, h, which), setattr(self, "which", which))[0])
    monkeypatch.setattr(S.Polynomial, "of", few)
    rng = random.Random(5)
    texts = [" ".join(rng.choices("abcdefghijkl", k=rng.randint(20, 60))) for _ in range(12)]
    for k in (8, 13):
        seen = {}
        for i, t in enumerate(texts):
            for _, part in slices(pa.array([t + " " + texts[i - 1]])):
                u = S.Units.of(part, k)
                at = u.windows(np.ones(len(u.doc), bool))
                w = t.split() + texts[i - 1].split()
                for a, p in zip(S.joined(*u.window_hashes(at)).tolist(), u.starts[at].tolist()):
                    assert seen.setdefault(a, w[p : p + k]) == w[p : p + k]
                for x, h, lo, hi in zip(u.anchors.tolist(), u.hashes.tolist(), u.starts[u.ptr[:-1]].tolist(), (u.starts[u.ptr[1:] - 1] + k).tolist()):
                    assert x < 4 and seen.setdefault(("unit", h), w[lo:hi]) == w[lo:hi]


def test_intervals_are_maximal(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g"), (2, "x a b c y d e f g z"), (3, "a b c d")], "doc_id long, text string")
    assert {r.doc_id: r.intervals for r in S.substring_dedup(docs, 3).collect()} == {1: [], 2: [1, 4, 5, 9], 3: [0, 4]}


def test_remove_repeats_keeps_rows_and_columns(spark, edges):
    out = S.remove_repeats(edges, 3)
    assert out.columns == edges.columns and out.count() == edges.count()
    whole = {(r.doc_id, r.text) for r in out.collect()}
    assert (2, "") in whole and (8, EDGES[8][1]) in whole and (6, "") in whole
    assert S.remove_repeats(edges.limit(0), 3).count() == 0
    sized = spark.createDataFrame([(1, "a b c", 5), (2, "a b c  x", 8), (3, "q\n r", 4)], "doc_id long, text string, n_chars long")
    assert {tuple(r) for r in S.remove_repeats(sized, 3).collect()} == {(1, "a b c", 5), (2, "x", 1), (3, "q\n r", 4)}
