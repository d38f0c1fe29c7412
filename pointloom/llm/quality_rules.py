"""Quality rules: a linear-chain conditional random field labels the lines of a document.

Each line with a word gets a feature vector; Viterbi decoding over the chain of
lines marks it content or boilerplate, and the share of words in content lines
decides whether the document is kept.  A base rule (too few words, too much
repetition) rejects a document whatever the lines look like.

The field is fitted on a bounded sample of labelled documents: the label of a
document is a first guess for its lines, then two rounds of Viterbi relabelling
inside low-quality documents leave their normal lines as content.  A text longer
than FIT_CHARS code points teaches by its first ones; it is judged as a whole.

Defined cases: null and empty texts have no words, fail the base rule and have
content share 0; repeated rows are judged one by one; an empty table gives an
empty result; without labels of both kinds the stated default weights are used;
extra columns are ignored (``quality_rules``) or passed through (``keep_quality``).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pointloom.llm.frames import FIT_CHARS, bounded_sample, fitting_rows, id_and_text, map_batches
from pointloom.llm.textkernel import LEAD_BYTE, Texts, gram_starts, grams, slices, span_hashes, sums_by

#: Labelled documents that the field is fitted on, at most; FIT_CHARS bounds what each gives.
FIT_DOCUMENTS = 2000
#: Lines of one training chain; longer documents are cut into several chains.
CHAIN_LINES = 32
#: Share of words in content lines from which a document is kept.
CONTENT_SHARE = 0.5
MIN_WORDS = 50

FEATURES = ("bias", "symbols", "upper", "pipes", "digits", "exclaims", "repeats", "length", "short", "duplicate")

_SYMBOL, _PIPE, _DIGIT, _EXCLAIM, _UPPER, _LETTER = (np.zeros(256, bool) for _ in range(6))
_SYMBOL[list(b"#*$%&|<>")] = True
_PIPE[ord("|")] = True
_DIGIT[48:58] = True
_EXCLAIM[ord("!")] = True
_UPPER[65:91] = True
_LETTER[65:91] = _LETTER[97:123] = True


@dataclass
class LineField:
    """Weights of the field: a score of 'boilerplate' by feature, and transition and start scores."""

    weights: np.ndarray = field(default_factory=lambda: np.array([-3.0, 6, 5, 6, 2, 3, 6, 0, 0, 0.5]))
    moves: np.ndarray = field(default_factory=lambda: np.array([[0.5, -0.5], [-0.5, 0.5]]))
    start: np.ndarray = field(default_factory=lambda: np.zeros(2))

    def viterbi(self, features: np.ndarray, ptr: np.ndarray) -> np.ndarray:
        """Best label (1: boilerplate) of every line; chain i is lines ptr[i] up to ptr[i + 1]."""
        unary = np.zeros((len(features), 2))
        unary[:, 1] = features @ self.weights
        lens = np.diff(ptr)
        order = np.argsort(-lens, kind="stable")
        first, lens = ptr[:-1][order], lens[order]
        labels = np.zeros(len(features), np.int8)
        back = np.zeros((len(features), 2), np.int8)
        most = int(lens[0]) if len(lens) else 0
        # chains still running at step t are a prefix of the order
        running = np.searchsorted(-lens, -np.arange(most), side="left") if most else []
        score = self.start + unary[first[: running[0]]] if most else None
        last = np.zeros((len(first), 2))
        if most:
            last[: running[0]] = score
        for t in range(1, most):
            k = running[t]
            at = first[:k] + t
            through = last[:k, :, None] + self.moves[None]
            back[at] = through.argmax(1)
            last[:k] = through.max(1) + unary[at]
        state = last.argmax(1).astype(np.int8)
        for t in range(most - 1, -1, -1):
            k = running[t]
            at = first[:k] + t
            ends = lens[:k] == t + 1
            if t < most - 1:
                k2 = running[t + 1]
                state[:k2] = back[first[:k2] + t + 1, state[:k2]]
            state[:k][ends] = last[:k][ends].argmax(1)
            labels[at] = state[:k]
        return labels


def line_features(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(features, words by line, lines with words by document as a pointer, duplicate-line count by document)."""
    words = texts.words()
    starts, ends, line_ptr = texts.lines()
    first = np.searchsorted(words.starts, starts)
    n_words = np.searchsorted(words.starts, ends) - first
    real = n_words > 0
    doc = np.repeat(np.arange(len(texts)), np.diff(line_ptr))[real]
    starts, ends, first, n_words = starts[real], ends[real], first[real], n_words[real]
    ptr = np.searchsorted(doc, np.arange(len(texts) + 1))

    def share(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags[texts.data], dtype=np.int64)])
        return total[ends] - total[starts]

    hashes = words.hashes()
    same = np.zeros(len(words), bool)
    same[1:] = hashes[1:] == hashes[:-1]
    total = np.concatenate([[0], np.cumsum(same)])
    repeats = total[first + n_words] - total[np.minimum(first + 1, len(total) - 1)]
    # equality of lines inside a document
    keys = span_hashes(texts.data, starts, ends) + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    order = np.argsort(keys, kind="stable")
    later = np.zeros(len(keys), bool)
    later[order[1:]] = keys[order[1:]] == keys[order[:-1]]
    per_word = 1 / np.maximum(n_words, 1)
    features = np.stack(
        [
            np.ones(len(starts)),
            np.minimum(1, 2 * share(_SYMBOL) * per_word),
            share(_UPPER) / np.maximum(1, share(_LETTER)),
            np.minimum(1, 2 * share(_PIPE) * per_word),
            np.minimum(1, share(_DIGIT) / np.maximum(1, ends - starts) * 4),
            np.minimum(1, share(_EXCLAIM) * per_word),
            repeats * per_word,
            np.minimum(1, np.log1p(n_words) / 6),
            n_words < 4,
            later,
        ],
        axis=1,
    ) if len(starts) else np.zeros((0, len(FEATURES)))
    return features, n_words, ptr, sums_by(later, ptr)


def repeated_words(hashes: np.ndarray, ptr: np.ndarray, k: int = 3) -> np.ndarray:
    """By document, the words inside k-word windows that the document holds twice or more."""
    at = gram_starts(ptr, k)
    covered = np.zeros(len(hashes) + 1, np.int64)
    if len(at):
        doc = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))[at]
        keys = grams(hashes, k)[at] + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        order = np.argsort(keys)
        same = keys[order[1:]] == keys[order[:-1]]
        twice = np.zeros(len(at), bool)
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
        np.add.at(covered, at[twice], 1)
        np.subtract.at(covered, at[twice] + k, 1)
    return sums_by(np.cumsum(covered[:-1]) > 0, ptr)


def judge_texts(texts: Texts, model: LineField, content_share: float = CONTENT_SHARE) -> dict[str, np.ndarray]:
    words = texts.words()
    n_words = words.counts()
    lead = np.concatenate([[0], np.cumsum(LEAD_BYTE[texts.data], dtype=np.int64)])
    chars = np.concatenate([[0], np.cumsum(lead[words.ends] - lead[words.starts])])
    symbols = np.concatenate([[0], np.cumsum(_SYMBOL[texts.data], dtype=np.int64)])
    features, line_words, line_ptr, n_dup = line_features(texts)
    labels = model.viterbi(features, line_ptr)
    content = sums_by(np.where(labels == 0, line_words, 0), line_ptr)
    n_repeat = repeated_words(words.hashes(), words.ptr)
    failed = (n_words < MIN_WORDS) | (100 * n_repeat > 50 * n_words)
    share = content / np.maximum(1, n_words)
    return {
        "n_words": n_words,
        "word_chars": chars[words.ptr[1:]] - chars[words.ptr[:-1]],
        "n_symbols": symbols[texts.offsets[1:]] - symbols[texts.offsets[:-1]],
        "n_dup_lines": n_dup,
        "n_repeat_words": n_repeat,
        "base_failed": failed,
        "content_share": share,
        "n_lines": np.diff(line_ptr),
        "n_boilerplate_lines": sums_by(labels, line_ptr),
        "kept": ~failed & (share >= content_share),
    }


def _forward_backward(odds: np.ndarray, live: np.ndarray, model: LineField) -> tuple[np.ndarray, np.ndarray]:
    """Probability of label 1 by line and expected moves, for padded chains; ``odds`` are the unary scores of label 1.

    States are scaled to sums of one at every step, so that products of many lines stay in range.
    """
    most, n = odds.shape
    emit = np.stack([np.exp(-np.maximum(odds, 0)), np.exp(np.minimum(odds, 0))], axis=2)  # by line, label 0 and label 1
    moves = np.exp(model.moves - model.moves.max())
    alpha = np.empty((most, n, 2))
    for t in range(most):
        own = emit[t] * (np.exp(model.start - model.start.max()) if t == 0 else alpha[t - 1] @ moves)
        alpha[t] = own / own.sum(1, keepdims=True)
    beta = np.full((most, n, 2), 0.5)
    for t in range(most - 2, -1, -1):
        back = (emit[t + 1] * beta[t + 1]) @ moves.T
        beta[t] = np.where(live[t + 1][:, None], back / back.sum(1, keepdims=True), 0.5)
    both = alpha * beta
    marginal = np.where(live, both[:, :, 1] / both.sum(2), 0)
    pairs = alpha[:-1, :, :, None] * moves * (emit[1:] * beta[1:])[:, :, None, :]
    pairs *= (live[1:] / pairs.sum((2, 3)))[:, :, None, None]
    return marginal, pairs.sum((0, 1))


def fit_field(chains: list[np.ndarray], low_quality: np.ndarray, rounds: int = 2, steps: int = 120) -> LineField:
    """Fit by gradient ascent on the log-likelihood of weak line labels; chains of normal documents are all content."""
    chains, low = zip(*[(c[i : i + CHAIN_LINES], q) for c, q in zip(chains, low_quality) for i in range(0, len(c), CHAIN_LINES)]) if chains else ((), ())
    low = np.array(low, bool)
    if not low.any() or low.all():
        return LineField()
    lens = np.array([len(c) for c in chains])
    most, f = int(lens.max()), len(FEATURES)
    x = np.zeros((most, len(chains), f))  # lines first, so that a step of all chains lies together
    for i, c in enumerate(chains):
        x[: len(c), i] = c
    live = np.arange(most)[:, None] < lens
    model = LineField(np.zeros(f), np.zeros((2, 2)), np.zeros(2))
    y = (low & live).astype(float)
    for _ in range(rounds + 1):
        params = np.concatenate([model.weights, model.moves.ravel(), model.start])
        m, v = np.zeros_like(params), np.zeros_like(params)
        labels = np.stack([live - y, y], axis=2)
        seen = np.concatenate([np.einsum("tn,tnf->f", y, x), np.einsum("tni,tnj->ij", labels[:-1], labels[1:]).ravel(), labels[0].sum(0)])
        for step in range(1, steps + 1):
            marginal, moves = _forward_backward(x @ model.weights, live, model)
            expected = np.concatenate([marginal.ravel() @ x.reshape(-1, f), moves.ravel(), [(1 - marginal[0]).sum(), marginal[0].sum()]])
            grad = (seen - expected) / len(chains) - 1e-3 * params
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            params = params + 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            model = LineField(params[:f], params[f : f + 4].reshape(2, 2), params[f + 4 :])
        flat = np.concatenate(chains)
        ptr = np.concatenate([[0], np.cumsum(lens)])
        best = model.viterbi(flat, ptr)
        for i in np.flatnonzero(low):
            own = best[ptr[i] : ptr[i + 1]]
            if own.any():
                y[: lens[i], i] = own
    return model


def fit_from(docs: DataFrame, labels: DataFrame, most: int = FIT_DOCUMENTS, most_chars: int = FIT_CHARS) -> LineField:
    """The field fitted on at most ``most`` labelled documents, the first ``most_chars`` code points of each; only their line features reach the driver."""
    sample = bounded_sample(labels, "quality", most)

    def features(batch: pa.RecordBatch) -> Iterator[dict]:
        for lo, texts in slices(batch["text"]):
            x, _, ptr, _ = line_features(texts)
            x = x.astype(np.float32)
            yield {"doc_id": batch["doc_id"][lo : lo + len(texts)], "value": batch["value"][lo : lo + len(texts)], "x": [x[a:b].tobytes() for a, b in zip(ptr[:-1], ptr[1:])]}

    rows = map_batches(fitting_rows(docs, sample, most_chars), features, "doc_id long, value int, x binary").orderBy("doc_id").collect()
    chains = [(np.frombuffer(r.x, np.float32).reshape(-1, len(FEATURES)).astype(float), r.value == 0) for r in rows]
    chains = [c for c in chains if len(c[0])]
    return fit_field([c for c, _ in chains], np.array([q for _, q in chains], bool))


RESULT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double, n_lines long, n_boilerplate_lines long"


def quality_rules(docs: DataFrame, model: LineField, content_share: float = CONTENT_SHARE) -> DataFrame:
    """One row of counts and the verdict for each row of ``docs``."""

    def judge(batch: pa.RecordBatch) -> Iterator[dict]:
        for lo, texts in slices(batch["text"]):
            yield judge_texts(texts, model, content_share) | {"doc_id": batch["doc_id"][lo : lo + len(texts)]}

    return map_batches(id_and_text(docs), judge, RESULT)


def keep_quality(docs: DataFrame, model: LineField, content_share: float = CONTENT_SHARE, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns; no shuffle."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [judge_texts(texts, model, content_share)["kept"] for _, texts in slices(batch[text_col])]
            if kept:
                yield batch.filter(pa.array(np.concatenate(kept)))

    return docs.mapInArrow(keep, docs.schema)
