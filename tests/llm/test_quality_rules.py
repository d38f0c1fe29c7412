import re
from collections import Counter
from itertools import product

import numpy as np
import pyarrow as pa

from pointloom.llm import quality_rules as Q
from pointloom.llm.textkernel import slices
from tests.llm.conftest import EDGES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = list(zip(words, words[1:], words[2:]))
    counts = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed


def counted(df):
    return sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in df.collect()), key=str)


def test_counts_equal_brute_force(spark, documents, rows, edges):
    model = Q.LineField()
    assert counted(Q.quality_rules(documents, model)) == sorted(((i, *brute(t)) for i, t in rows), key=str)
    assert counted(Q.quality_rules(edges, model)) == sorted(((i, *brute(t)) for i, t in EDGES), key=str)


def test_empty_table_and_kept(spark, edges):
    model = Q.LineField()
    assert Q.quality_rules(edges.limit(0), model).count() == 0
    assert all(not r.kept for r in Q.quality_rules(edges, model).where("base_failed").collect())
    assert Q.keep_quality(edges, model).columns == edges.columns


def test_viterbi_equals_the_best_of_all_labellings():
    rng = np.random.default_rng(1)
    model = Q.LineField(rng.normal(size=len(Q.FEATURES)), rng.normal(size=(2, 2)), rng.normal(size=2))
    lens = [1, 4, 0, 6, 3]
    ptr = np.concatenate([[0], np.cumsum(lens)])
    x = rng.normal(size=(ptr[-1], len(Q.FEATURES)))
    labels = model.viterbi(x, ptr)
    unary = x @ model.weights
    for a, b in zip(ptr[:-1], ptr[1:]):
        if b > a:
            score = lambda y: model.start[y[0]] + sum(unary[a + t] * y[t] for t in range(b - a)) + sum(model.moves[y[t - 1], y[t]] for t in range(1, b - a))
            assert tuple(labels[a:b]) == max(product((0, 1), repeat=b - a), key=score)


def test_marginals_equal_the_sums_over_all_labellings():
    rng = np.random.default_rng(2)
    model = Q.LineField(np.zeros(len(Q.FEATURES)), rng.normal(size=(2, 2)), rng.normal(size=2))
    odds, lens = 3 * rng.normal(size=(5, 3)), np.array([5, 2, 1])
    live = np.arange(5)[:, None] < lens
    marginal, moves = Q._forward_backward(odds, live, model)
    ones, steps = np.zeros((5, 3)), np.zeros((2, 2))
    for i, n in enumerate(lens):
        ways = list(product((0, 1), repeat=n))
        weight = np.exp([model.start[y[0]] + sum(odds[t, i] * y[t] for t in range(n)) + sum(model.moves[y[t - 1], y[t]] for t in range(1, n)) for y in ways])
        for y, w in zip(ways, weight / weight.sum()):
            ones[:n, i] += w * np.array(y)
            for t in range(1, n):
                steps[y[t - 1], y[t]] += w
    assert np.allclose(marginal, ones) and np.allclose(moves, steps)


def verdict(text, model):
    """Line features, decoding and the share of content of one text, word by word."""
    seen, unary, sizes = set(), [], []
    for line in (text or "").split("\n"):
        words = WORD.findall(line)
        if not words:
            continue
        count = lambda pattern: len(re.findall(pattern, line))
        n, size = len(words), len(line.encode())
        features = [
            1,
            min(1, 2 * count(r"[#*$%&|<>]") / n),
            count("[A-Z]") / max(1, count("[A-Za-z]")),
            min(1, 2 * count(r"\|") / n),
            min(1, 4 * count("[0-9]") / max(1, size)),
            min(1, count("!") / n),
            sum(a == b for a, b in zip(words, words[1:])) / n,
            min(1, np.log1p(n) / 6),
            n < 4,
            line in seen,
        ]
        seen.add(line)
        unary.append(sum(w * f for w, f in zip(model.weights, features)))
        sizes.append(n)
    best, back = [], []
    for t, u in enumerate(unary):
        ways = [[best[a] + model.moves[a][b] if t else model.start[b] for a in (0, 1)] for b in (0, 1)]
        back.append([int(w[1] > w[0]) for w in ways])
        best = [max(w) + (u if b else 0) for b, w in enumerate(ways)]
    label, content = int(best[1] > best[0]) if best else 0, 0
    for t in range(len(unary) - 1, -1, -1):
        content += sizes[t] * (1 - label)
        label = back[t][label]
    n, *_, failed = brute(text)
    return content / max(1, n), not failed and content / max(1, n) >= Q.CONTENT_SHARE


def test_verdicts_equal_brute_force(spark, documents, rows, edges, small):
    for frame, texts, model in ((documents, rows, Q.fit_from(documents, spark.read.parquet(f"{small}/labels.parquet"))), (edges, EDGES, Q.LineField())):
        got = sorted(((r.doc_id, round(r.content_share, 9), r.kept) for r in Q.quality_rules(frame, model).collect()), key=str)
        assert got == sorted(((i, *(round(float(x), 9) if not isinstance(x, bool) else x for x in verdict(t, model))) for i, t in texts), key=str)


def test_fitted_field_tells_junk_from_prose(spark, documents, small):
    model = Q.fit_from(documents, spark.read.parquet(f"{small}/labels.parquet"))
    prose = ("Some words of plain prose that go on for a while, as they do.\n" + " ".join(f"word{i}" for i in range(60))) + ".\n"
    junk = "\n".join(" ".join(f"w{i}{j}%%%" for j in range(20)) for i in range(6))
    (_, texts), = slices(pa.array([prose, junk]))
    assert Q.judge_texts(texts, model)["kept"].tolist() == [True, False]
