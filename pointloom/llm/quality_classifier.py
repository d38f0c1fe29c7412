"""Quality classifier: random-indexing word vectors, a two-layer network, calibrated probabilities.

Texts become tokens: words with what trails them split off, a token for the
shape of each word and one for a word that repeats the one before it.  Each
token of the fitting sample has a sparse random index vector; its word vector is
the sum of the index vectors around it (random indexing), scaled to length one.
A document is the mean of its tokens' vectors plus a few shares of shapes, and a
network of two layers in numpy gives a logit, which a temperature fitted on
rows kept apart turns into a probability.

The classifier is fitted on a bounded sample of labelled documents
(FIT_DOCUMENTS, the first FIT_CHARS code points of each); whole texts are the
only input of a score.  Tokens that the sample
lacks count through their shape alone.

Defined cases: null and empty texts have the zero vector and get the network's
answer to it; repeated rows are scored one by one; without labels of both kinds
every score is 0.5; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import re
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.llm.frames import FIT_CHARS, bounded_sample, fitting_rows, id_and_text, map_batches

#: Labelled documents that the classifier is fitted on, at most; FIT_CHARS bounds what each gives.
FIT_DOCUMENTS = 4000
DIMENSIONS, NONZERO, WINDOW, HIDDEN = 64, 6, 2, 24
#: Scores from here on are predicted as good.
DECISION = 0.3

_TRAIL = re.compile(r"[^\w]+$")
SHAPES = ("<lower>", "<title>", "<upper>", "<digits>", "<mark>", "<mixed>", "<same>", "<trail>", "<shout>", "<symbol>")


def shape_of(word: str) -> str:
    if word.islower():
        return "<lower>"
    if word.isupper():
        return "<upper>" if len(word) > 1 else "<title>"
    if word.istitle():
        return "<title>"
    if word.isdigit():
        return "<digits>"
    return "<mixed>" if any(c.isalnum() for c in word) else "<mark>"


class Tokens:
    """Tokens of a word, remembered for words that come again (bounded)."""

    MOST = 200_000

    def __init__(self) -> None:
        self.known: dict[str, tuple[str, ...]] = {}

    def of(self, word: str) -> tuple[str, ...]:
        found = self.known.get(word)
        if found is None:
            m = _TRAIL.search(word)
            core, trail = (word[: m.start()], m.group()) if m else (word, "")
            found = (core.lower(), shape_of(core)) if core else ()
            if trail:
                found += (trail, "<trail>")
                if "!" in trail:
                    found += ("<shout>",)
                if any(c in "#*$%&|<>" for c in trail):
                    found += ("<symbol>",)
            if len(self.known) < self.MOST:
                self.known[word] = found
        return found


def index_vector(token: str) -> np.ndarray:
    """Sparse vector of a token: NONZERO places of plus or minus one, from a digest of the token."""
    import hashlib

    bits = np.frombuffer(hashlib.blake2b(token.encode("utf-8", "surrogatepass"), digest_size=2 * NONZERO).digest(), np.uint16)
    out = np.zeros(DIMENSIONS, np.float32)
    out[bits % DIMENSIONS] = np.where(bits >> 15, 1, -1)
    return out


@dataclass
class Classifier:
    vocabulary: dict[str, int]
    vectors: np.ndarray
    layers: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None = None
    temperature: float = 1.0

    def pooled(self, texts: list[str | None]) -> np.ndarray:
        """Document vectors: mean word vector, and shares of shapes among words."""
        tokens, vocabulary = Tokens(), self.vocabulary
        out = np.zeros((len(texts), DIMENSIONS + len(SHAPES)), np.float32)
        for row, text in enumerate(texts):
            words = text.split() if text else []
            if not words:
                continue
            counts: Counter[str] = Counter()
            for word, n in Counter(words).items():
                for token in tokens.of(word):
                    counts[token] += n
            same = sum(map(str.__eq__, words[1:], words))
            at = [vocabulary[t] for t in counts if t in vocabulary]
            n = np.array([counts[t] for t in counts if t in vocabulary], np.float32)
            if at:
                out[row, :DIMENSIONS] = n @ self.vectors[at] / sum(counts.values())
            out[row, DIMENSIONS:] = [same / len(words) if s == "<same>" else counts[s] / len(words) for s in SHAPES]
        return out

    def logits(self, x: np.ndarray) -> np.ndarray:
        if self.layers is None:
            return np.zeros(len(x))
        w1, b1, w2, b2 = self.layers
        return (np.tanh(x @ w1 + b1) @ w2 + b2)[:, 0]

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(self.pooled(texts)) / self.temperature, -60, 60)))


def word_vectors(texts: list[str | None]) -> tuple[dict[str, int], np.ndarray]:
    """Random indexing over the sample: a token's vector sums the index vectors of its neighbours."""
    tokens = Tokens()
    streams = [[t for w in (text or "").split() for t in tokens.of(w)] for text in texts]
    counts = Counter(t for s in streams for t in s)
    vocabulary = {t: i for i, (t, _) in enumerate(sorted(((t, n) for t, n in counts.items() if n > 1), key=lambda x: (-x[1], x[0])))}
    own = np.array([index_vector(t) for t in vocabulary], np.float32).reshape(-1, DIMENSIONS)
    sums = own.copy()
    for stream in streams:
        at = np.array([vocabulary[t] for t in stream if t in vocabulary], np.int64)
        for step in range(1, WINDOW + 1):
            if len(at) > step:
                np.add.at(sums, at[:-step], own[at[step:]])
                np.add.at(sums, at[step:], own[at[:-step]])
    return vocabulary, sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)


def fit(texts: list[str | None], good: np.ndarray, steps: int = 600, seed: int = 7) -> Classifier:
    """Fit on texts in a fixed order; every fifth is kept apart for the temperature."""
    vocabulary, vectors = word_vectors(texts)
    model = Classifier(vocabulary, vectors)
    good = np.asarray(good, float)
    if not len(good) or good.min() == good.max():
        return model
    x = model.pooled(texts).astype(float)
    apart = np.arange(len(x)) % 5 == 4
    scale = np.append(np.full(DIMENSIONS, 4.0), np.full(len(SHAPES), 1.0))
    rng = np.random.default_rng(seed)
    params = [rng.normal(0, 0.3, (x.shape[1], HIDDEN)) * scale[:, None], np.zeros(HIDDEN), rng.normal(0, 0.3, (HIDDEN, 1)), np.zeros(1)]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    a, y = x[~apart], good[~apart]
    # both kinds weigh the same while the network is fitted
    weight = np.where(y > 0, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6))
    for step in range(1, steps + 1):
        at = rng.integers(0, len(a), 256)
        h = np.tanh(a[at] @ params[0] + params[1])
        p = 1 / (1 + np.exp(-(h @ params[2] + params[3])[:, 0]))
        d = ((p - y[at]) * weight[at] / len(at))[:, None]
        back = d @ params[2].T * (1 - h**2)
        grads = [a[at].T @ back + 1e-4 * params[0], back.sum(0), h.T @ d + 1e-4 * params[2], d.sum(0)]
        for k, g in enumerate(grads):
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g**2
            params[k] = params[k] - 0.02 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    model.layers = tuple(params)
    if apart.any():
        # the temperature of least log loss on the rows kept apart
        logit, y = model.logits(x[apart]), good[apart]
        grid = np.exp(np.linspace(np.log(0.25), np.log(16), 97))
        loss = [np.mean(np.logaddexp(0, np.where(y > 0, -logit, logit) / t)) for t in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
    return model


def fit_from(docs: DataFrame, labels: DataFrame, most: int = FIT_DOCUMENTS, most_chars: int = FIT_CHARS) -> Classifier:
    """The classifier fitted on at most ``most`` labelled documents, the first ``most_chars`` code points of each, whose tokens seen twice are its vocabulary."""
    rows = fitting_rows(docs, bounded_sample(labels, "quality", most), most_chars).orderBy(F.xxhash64("doc_id", F.lit(12)), "doc_id").collect()
    return fit([r.text for r in rows], np.array([r.value for r in rows], float))


def score_quality(docs: DataFrame, model: Classifier) -> DataFrame:
    """(doc_id, score) for each row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        for lo in range(0, len(batch), 1000):
            rows = batch.slice(lo, 1000)
            yield {"doc_id": rows["doc_id"], "score": shared.value.scores(rows["text"].to_pylist())}

    return map_batches(id_and_text(docs), run, "doc_id long, score double")
