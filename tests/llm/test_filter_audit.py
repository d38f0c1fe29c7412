import re
from collections import Counter
from itertools import permutations

from pointloom.llm import filter_audit as A
from tests.llm.conftest import EDGES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, labels):
    """All orders applied one after another to the documents themselves."""
    docs = [(i, t or "", s or "") for i, t, s in docs]
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, x in labels if x == 1 and i is not None}
    fails = []
    for i, t, _ in docs:
        words = WORD.findall(t)
        capitals = sum("A" <= c <= "Z" for c in t)
        copy = i is not None and any(j is not None and j < i and u == t for j, u, _ in docs)
        fails.append({c for c, f in zip("ABCDE", (len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * capitals > 5 * len(t), bool(re.search(r"[#$%&*|]", t)), copy)) if f})
    out, shapley = {}, Counter()
    for order in map("".join, permutations("ABCDE")):
        for part in {s for *_, s in docs}:
            here = [(i, f) for (i, _, s), f in zip(docs, fails) if s == part]
            left = here
            for step, c in enumerate(order, 1):
                removed = [x for x in left if c in x[1]]
                gone = len(here) - len(left)
                left = [x for x in left if c not in x[1]]
                redundant = sum(c in f for _, f in here) - len(removed)
                assert redundant <= gone
                out[part, order, step] = [len(left), len(removed), redundant, sum(f == {c} for _, f in here), sum(i in good for i, _ in removed), sum(i in toxic for i, _ in removed)]
                shapley[part, c] += len(removed)
    return sorted((*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items())


def got(docs, labels):
    return sorted(tuple(r) for r in A.audit(docs, labels).collect())


def test_audit_equals_brute_force(spark, small):
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    want = brute(rows, [(r.doc_id, r.quality, r.toxic) for r in labels.collect()])
    assert got(docs, labels) == want and any(r[4] for r in want) and any(r[7] for r in want) and any(r[8] for r in want)


def test_edges_and_clashing_columns(spark):
    words = " ".join(f"w{i}" for i in range(60))
    rows = [(i, t, "s") for i, t in EDGES] + [(20, words, None), (20, words, None), (20, words, "s"), (18, words, "s"), (None, words, "s"), (None, words, ""), (21, "w " * 200_000, None), (22, words + " # ABC", ""), (23, "\x0b \x1f x", "")]
    labels = [(20, 1, 0), (20, 0, 1), (20, 1, 0), (22, None, 1), (None, 1, 1), (4, 1, None)]
    docs = spark.createDataFrame([(*r, 1, "m", 2) for r in rows], "doc_id long, text string, source string, mask int, part string, n int")
    marks = spark.createDataFrame([(*r, "x") for r in labels], "doc_id long, quality int, toxic int, digest string")
    assert got(docs, marks) == brute(rows, labels)
    assert got(docs.where("text IS NULL"), marks.limit(0)) == brute([r for r in rows if r[1] is None], [])
    assert got(docs.limit(0), marks) == []


def test_steps_and_edges_are_the_whole_lattice(spark):
    steps = A.steps(spark).collect()
    assert len(steps) == 600 and len({(r.applied, r.next) for r in steps}) == 80
    assert all(bin(r.applied).count("1") == r.step - 1 and not r.applied >> r.next & 1 for r in steps)
    counts = spark.createDataFrame([("p", m, False, False, 1) for m in range(32)], "part string, mask int, good boolean, toxic boolean, n long")
    edges = A.edge_counts(counts).collect()
    assert {(r.applied, r.next) for r in edges} == {(r.applied, r.next) for r in steps}
    assert all(r.kept == 2 ** (4 - bin(r.applied).count("1")) == r.removed for r in edges)
