import numpy as np
from pyspark.sql import functions as F

from pointloom.llm import language_id as N
from tests.llm.conftest import EDGES


def test_gradients_are_the_slopes():
    rng = np.random.default_rng(0)
    net = N.Network.random(("a", "b", "c"), rng, 3)
    x, y = rng.integers(0, 256, (4, 6)), np.array([0, 1, 2, 1])
    _, grads = N.gradients(net, x, y)
    for k, p in enumerate((net.table, net.states, net.out, net.bias)):
        at = (1, x[0, 3], 4) if k == 0 else tuple(s - 1 for s in p.shape)
        old = p[at]
        p[at] = old + 1e-6
        up = N.gradients(net, x, y)[0]
        p[at] = old - 1e-6
        down = N.gradients(net, x, y)[0]
        p[at] = old
        assert np.isclose((up - down) / 2e-6, grads[k][at], atol=1e-7)


def test_positions_agree_with_training_states():
    rng = np.random.default_rng(1)
    net = N.Network.random(("a", "b"), rng)
    x = rng.integers(0, 256, (5, 9))
    states = np.zeros((2, 9, 5, N.HIDDEN))
    for d in (0, 1):
        for t, *_, after in N._run(net, x, d):
            states[d, t] = after
    logit = states[0] @ net.out[0] + states[1] @ net.out[1] + net.bias
    p = np.exp(logit) / np.exp(logit).sum(-1, keepdims=True)
    assert np.allclose(net.position_sums(x, np.full(5, 9)), p.sum(0), atol=1e-4)


def plain(net, text):
    """Mean probabilities over all bytes of a text, one byte after another."""
    data, total = (text or "").encode(), np.zeros(len(net.languages))
    h, sigmoid = net.states.shape[1], lambda v: 1 / (1 + np.exp(-v))
    for lo in range(0, len(data), N.SEGMENT):
        part, states = data[lo : lo + N.SEGMENT], [[], []]
        for d in (0, 1):
            state = np.zeros(h)
            for byte in part if d == 0 else part[::-1]:
                gates, inner = net.table[d][byte], state @ net.states[d]
                z, r = sigmoid(gates[:h] + inner[:h]), sigmoid(gates[h : 2 * h] + inner[h : 2 * h])
                new = np.tanh(gates[2 * h :] + r * inner[2 * h :])
                state = z * state + (1 - z) * new
                states[d].append(state)
        for forward, backward in zip(states[0], states[1][::-1]):
            p = np.exp(forward @ net.out[0] + backward @ net.out[1] + net.bias)
            total += p / p.sum()
    return total / max(1, len(data))


def test_predictions_equal_the_plain_network(spark, documents, rows, edges):
    net = N.Network.random(("a", "b", "c"), np.random.default_rng(3))
    some = sorted(rows, key=lambda r: len(r[1] or ""))[:40] + sorted(rows, key=lambda r: len(r[1] or ""))[-1:] + EDGES
    frame = spark.createDataFrame(some, "doc_id long, text string")
    got = sorted(((r.doc_id, r.lang_pred, round(r.score, 4)) for r in N.identify(frame, net).collect()), key=str)
    want = []
    for i, t in some:
        p, letters = plain(net, t), any(c.isalpha() for c in t or "")
        want.append((i, net.languages[int(p.argmax())] if letters else "und", round(float(p.max()), 4) if letters else 0.0))
    want.sort(key=str)
    assert [g[:2] for g in got] == [w[:2] for w in want] and np.allclose([g[2] for g in got], [w[2] for w in want], atol=2e-4)


def test_short_texts_teach():
    net = N.fit([("aaa bb", "x"), ("zz yyy", "y")] * 20, steps=60)
    for text, language in (("bb aaa aa", "x"), ("yy zz zy", "y")):
        (_, part), = N.slices(N.pa.array([text]))
        assert net.languages[int(net.probabilities(part)[0].argmax())] == language


def test_held_out_accuracy_and_edges(spark, documents, edges):
    fold = F.crc32(F.col("doc_id").cast("string")) % 3
    net = N.fit_from(documents.where(fold != 0))
    held = N.identify(documents, net).join(documents.where(fold == 0).select("doc_id", "lang", "n_chars"), "doc_id").toPandas()
    assert (held.lang == held.lang_pred).mean() > 0.93
    out = {r.doc_id: r for r in N.identify(edges, net).collect()}
    assert all(out[i].lang_pred == "und" and out[i].score == 0 for i in (1, 2, 3)) and out[8].lang_pred in net.languages
    assert N.identify(edges.limit(0), net).count() == 0
    assert {r.lang_pred for r in N.identify(edges, None).collect()} == {"und"}
    assert N.fit_from(documents.withColumn("lang", F.lit(None).cast("string"))) is None


def test_a_rare_language_and_one_long_text(spark, documents):
    """A language of a thousandth of the documents is learned, and a long text or texts without letters take no places."""
    greek = ["Το πρωί ο ήλιος βγήκε πάνω από τη θάλασσα και όλοι κατέβηκαν στο λιμάνι. ", "Η βιβλιοθήκη ανοίγει κάθε μέρα εκτός από την Κυριακή, όταν ξεκουράζονται όλοι. "]
    many = documents.select("doc_id", "text", "lang").where("text IS NOT NULL")
    copies = many.crossJoin(spark.range(3000 // many.count() + 1).toDF("k")).select((F.col("doc_id") + F.col("k") * 100_000).alias("doc_id"), "text", "lang")
    rare = [(10**7 + i, g * 6, "el") for i, g in enumerate(greek)] + [(10**7 + 9, "ab " * (1 << 21), "en")] + [(10**8 + i, None if i % 2 else "12 34", "el") for i in range(400)]
    net = N.fit_from(copies.unionAll(spark.createDataFrame(rare, copies.schema)))
    probe = spark.createDataFrame([(1, "Οι μαθητές διάβασαν τα βιβλία και έγραψαν μια μεγάλη επιστολή στον δάσκαλο. " * 3), (2, documents.where("lang = 'en'").orderBy(F.length("text").desc()).first().text)], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in N.identify(probe, net).collect()} == {1: "el", 2: "en"}
