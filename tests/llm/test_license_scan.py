import random
import re
import time

from pointloom.llm import license_scan as L
from pointloom.llm.license_rules import default_rules
from tests.llm.conftest import EDGES


def brute(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(L.WORD, low)
    places = [(i, label) for phrase, label in L.BASE_PHRASES for i in range(len(words)) if tuple(words[i : i + len(phrase)]) == phrase]
    at = [i for i, _ in places]
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({label for _, label in places}))


def base(df):
    return sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in df.collect()), key=str)


def test_base_equals_brute_force(spark, documents, rows, edges):
    assert base(L.scan_licenses(documents)) == sorted(((i, *brute(t)) for i, t in rows), key=str)
    assert base(L.scan_licenses(edges)) == sorted(((i, *brute(t)) for i, t in EDGES), key=str)
    made = [(1, "CC-BY cc_by ccby cc by, cc by"), (2, "GENERAL\nPublic--license general public licenses"), (3, "all rights reserved" * 2), (4, "écc by cc byé Cc By")]
    assert base(L.scan_licenses(spark.createDataFrame(made, "doc_id long, text string"))) == sorted(((i, *brute(t)) for i, t in made), key=str)


def detected(text, rules):
    """Every match of every rule, without those inside another one, by comparing all with all."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    found = [(m.start(), m.end(), r.priority, n, r.label) for n, r in enumerate(rules) for m in re.finditer(r.expression, low, re.ASCII)]
    over = lambda o, m: o != m and o[0] <= m[0] and o[1] >= m[1] and (o[1] - o[0] > m[1] - m[0] or (o[2], -o[3]) > (m[2], -m[3]))
    return sorted(m for m in found if not any(over(o, m) for o in found))


def verdicts(df):
    return sorted(((r.doc_id, r.labels, round(r.score, 6), [tuple(d) for d in r.detections]) for r in df.collect()), key=str)


def expected(rows, rules):
    out = []
    for i, t in rows:
        kept, (_, n_base, _, _, base_labels) = detected(t, rules), brute(t)
        labels = sorted({d[4] for d in kept} | set(filter(None, base_labels.split(","))))
        out.append((i, ",".join(labels), round(max([d[2] / 100 for d in kept] + [0.5 if n_base else 0]), 6), kept))
    return sorted(out, key=str)


def example(tree, rng):
    """A text that a parsed expression matches."""
    out = ""
    for op, value in tree:
        op = str(op)
        if op == "LITERAL":
            out += chr(value)
        elif op == "IN":
            kinds = [(str(k), v) for k, v in value]
            if kinds[0][0] == "NEGATE":
                out += rng.choice("ab 1")
            elif kinds[0][0] == "CATEGORY":
                out += rng.choice("07")
            else:
                kind, v = rng.choice(kinds)
                c = chr(v) if kind == "LITERAL" else chr(rng.randint(*v))
                out += "-" if c.isupper() else c
        elif op == "MAX_REPEAT":
            low, high, inner = value
            out += "".join(example(inner, rng) for _ in range(rng.randint(low, min(high, low + 3))))
        elif op == "SUBPATTERN":
            out += example(value[3], rng)
        elif op == "BRANCH":
            out += example(rng.choice(value[1]), rng)
        elif op == "NOT_LITERAL":
            out += "x"
        else:
            assert op == "ASSERT_NOT", op
    return out


def drawn(rng, times=1):
    return [(r, example(re._parser.parse(r.expression), rng)) for r in default_rules() for _ in range(times)]


def test_rules_are_distinct_and_gated():
    rules = default_rules()
    assert len({r.pattern for r in rules}) == len(rules) > 350 and len({r.label for r in rules}) > 200
    for r, text in drawn(random.Random(2), 20):
        low = text.lower()
        assert re.fullmatch(r.expression, low, re.ASCII)
        assert r.root in low and re.search(r.gate, low), (r, text)


def test_labels_and_scores_equal_brute_force(spark, documents, rows, edges):
    rules = default_rules()
    assert verdicts(L.scan_licenses(documents)) == expected(rows, rules)
    assert verdicts(L.scan_licenses(edges)) == expected(EDGES, rules)
    rng = random.Random(4)
    texts = [text for _, text in drawn(rng)]
    many = [(i, " ".join(rng.choice([t, t.upper(), "commit success", "\n * "]) for t in rng.choices(texts, k=rng.randint(1, 6)))) for i in range(150)]
    frame = spark.createDataFrame(many + list(enumerate(texts, 1000)), "doc_id long, text string")
    assert verdicts(L.scan_licenses(frame)) == expected(many + list(enumerate(texts, 1000)), rules)


def test_many_hits_in_one_text(spark):
    text = "the MIT License, all rights reserved; licensed under the GNU General Public License version 2. " * 700
    rules = default_rules()
    frame = spark.createDataFrame([(1, text)], "doc_id long, text string")
    (row,) = L.scan_licenses(frame).collect()
    assert [tuple(d) for d in row.detections] == detected(text, rules)
    long = spark.createDataFrame([(1, text * 10)], "doc_id long, text string").cache()
    assert long.count() == 1
    L.scan_licenses(long).collect()
    start = time.time()
    (row,) = L.scan_licenses(long).collect()
    assert len(row.detections) > 20_000 and time.time() - start < 20


def test_no_rules(spark, edges):
    assert {r.labels for r in L.scan_licenses(edges, ()).collect()} == {""}


def test_suppression(spark):
    texts = [
        (1, "Licensed under the Apache License, Version 2.0."),
        (2, "the MIT License and the GNU General Public License, version 3"),
        (3, "SPDX-License-Identifier: MIT"),
        (4, "nothing to see, commit success"),
        (5, "This work is in the public domain. Copyright (c) 2019-2021"),
    ]
    out = {r.doc_id: r for r in L.scan_licenses(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert out[1].labels == "apache-2.0" and out[2].labels == "gpl,gpl-3.0,mit" and out[3].labels == "spdx"
    assert out[4].labels == "" and out[4].score == 0 and out[5].labels == "copyright,public-domain"


def test_no_rows_and_no_python(spark, edges):
    assert L.scan_licenses(edges.limit(0)).count() == 0
    plan = L.scan_licenses(edges)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
