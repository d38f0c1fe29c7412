"""Language identification: a bidirectional gated recurrent network over bytes.

Every byte of a text is labelled: a forward and a backward state run over
segments of SEGMENT bytes, and both states of a position give its language
probabilities; a document's probabilities are the mean over all its bytes.  The
network is trained in numpy by backpropagation through time on segments from a
bounded sample of documents with a known language, as many of each language.

Defined cases: null texts and texts without a letter give ``und`` and score 0,
as do all texts if no language is known; rows with a null language, a null id
or no letter teach nothing, and a text teaches by its first FIT_CHARS code points; repeated rows are labelled one by one; a very long text is many
segments; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.llm.frames import FIT_CHARS, fitting_rows, id_and_text, map_batches, sample_of_each
from pointloom.llm.textkernel import Texts, slices

#: Documents that the network is fitted on, shared among the languages, but FIT_EACH for a language at least (FIT_CHARS bounds
#: what each gives), and segments of one of them, at most.
FIT_DOCUMENTS, FIT_EACH, FIT_SEGMENTS = 800, 20, 12
HIDDEN, SEGMENT, FIT_SEGMENT = 8, 128, 48
#: Text bytes of one pass over segments.
PASS_BYTES = 1 << 20

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


@dataclass
class Network:
    """Weights, both directions in one array: bytes to gates (2, 256, 3H), states to gates (2, H, 3H), states to languages."""

    languages: tuple[str, ...]
    table: np.ndarray
    states: np.ndarray
    out: np.ndarray  # (2, H, languages)
    bias: np.ndarray

    @classmethod
    def random(cls, languages: tuple[str, ...], rng: np.random.Generator, hidden: int = HIDDEN) -> Network:
        return cls(languages, rng.normal(0, 0.3, (2, 256, 3 * hidden)), rng.normal(0, 0.3, (2, hidden, 3 * hidden)), rng.normal(0, 0.3, (2, hidden, len(languages))), np.zeros(len(languages)))

    def position_sums(self, segments: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """Sums over positions of the language probabilities, for rows of bytes of which the first ``lens`` count."""
        n, most = segments.shape
        h = self.states.shape[1]
        # columns are segments, so that every operation runs over contiguous rows; gates go through tanh(x / 2)
        half = np.repeat(np.array([0.5, 0.5, 1.0]), h)
        table = [np.ascontiguousarray((self.table[d] * half).T, np.float32) for d in (0, 1)]
        states = [np.ascontiguousarray((self.states[d] * half).T, np.float32) for d in (0, 1)]
        out = [np.ascontiguousarray(self.out[d].T, np.float32) for d in (0, 1)]
        columns = np.ascontiguousarray(segments.T).astype(np.intp)
        kept = np.empty((most, h, n), np.float32)
        gates, inner = np.empty((3 * h, n), np.float32), np.empty((3 * h, n), np.float32)

        def step(d: int, t: int, state: np.ndarray) -> np.ndarray:
            np.take(table[d], columns[t], axis=1, out=gates, mode="clip")
            np.matmul(states[d], state, out=inner)
            zr = gates[: 2 * h]
            zr += inner[: 2 * h]
            np.tanh(zr, out=zr)
            zr += 1
            zr *= 0.5
            new = gates[2 * h :]
            new += gates[h : 2 * h] * inner[2 * h :]
            np.tanh(new, out=new)
            return new + gates[:h] * (state - new)

        state = np.zeros((h, n), np.float32)
        for t in range(most):
            state = kept[t] = step(0, t, state)
        sums = np.zeros((len(self.languages), n), np.float32)
        state = np.zeros((h, n), np.float32)
        bias = self.bias.astype(np.float32)[:, None]
        for t in range(most - 1, -1, -1):
            live = lens > t
            state = step(1, t, state)
            if not live.all():
                state *= live  # the backward state begins at a segment's last byte
            logit = out[0] @ kept[t] + out[1] @ state + bias
            logit -= logit.max(0)
            np.exp(logit, out=logit)
            logit /= logit.sum(0)
            sums += logit * live
        return sums.T

    def probabilities(self, texts: Texts) -> np.ndarray:
        """Mean probabilities of each text; rows of zeros for texts without bytes."""
        sizes = np.diff(texts.offsets)
        out = np.zeros((len(texts), len(self.languages)))
        n = -(-sizes // SEGMENT)
        doc = np.repeat(np.arange(len(texts)), n)
        number = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
        begin = texts.offsets[doc] + number * SEGMENT
        lens = np.minimum(SEGMENT, texts.offsets[doc + 1] - begin)
        data = np.concatenate([texts.data, np.zeros(SEGMENT, np.uint8)])
        # segments of like length together, so that short texts do not take whole steps
        order = np.argsort(lens, kind="stable")
        step = PASS_BYTES // SEGMENT
        for k in range(0, len(order), step):
            own = order[k : k + step]
            most = int(lens[own].max())
            sums = self.position_sums(data[begin[own, None] + np.arange(most)], lens[own])
            np.add.at(out, doc[own], sums)
        return out / np.maximum(sizes, 1)[:, None]


def _run(net: Network, x: np.ndarray, d: int) -> list[tuple[np.ndarray, ...]]:
    """States of one direction over training segments, with what backpropagation needs."""
    h = net.states.shape[1]
    state, kept = np.zeros((len(x), h)), []
    for t in range(x.shape[1]) if d == 0 else range(x.shape[1] - 1, -1, -1):
        inner = state @ net.states[d]
        gates = net.table[d][x[:, t]]
        z = 1 / (1 + np.exp(-(gates[:, :h] + inner[:, :h])))
        r = 1 / (1 + np.exp(-(gates[:, h : 2 * h] + inner[:, h : 2 * h])))
        new = np.tanh(gates[:, 2 * h :] + r * inner[:, 2 * h :])
        after = new + z * (state - new)
        kept.append((t, state, inner[:, 2 * h :], z, r, new, after))
        state = after
    return kept


def gradients(net: Network, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross entropy of all positions and its gradients, by backpropagation through time in both directions."""
    n, most = x.shape
    h = net.states.shape[1]
    runs = [_run(net, x, d) for d in (0, 1)]
    states = np.zeros((2, most, n, h))
    for d in (0, 1):
        for t, *_, after in runs[d]:
            states[d, t] = after
    logit = states[0] @ net.out[0] + states[1] @ net.out[1] + net.bias
    logit -= logit.max(-1, keepdims=True)
    p = np.exp(logit)
    p /= p.sum(-1, keepdims=True)
    loss = -np.log(np.maximum(p[:, np.arange(n), y], 1e-12)).mean()
    delta = p
    delta[:, np.arange(n), y] -= 1
    delta /= n * most
    table, inner_w, out = np.zeros_like(net.table), np.zeros_like(net.states), np.zeros_like(net.out)
    for d in (0, 1):
        out[d] = np.einsum("tnh,tnc->hc", states[d], delta)
        back = np.zeros((n, h))
        for t, before, hidden, z, r, new, _ in reversed(runs[d]):
            back = back + delta[t] @ net.out[d].T
            d_new = back * (1 - z) * (1 - new**2)
            d_z = back * (before - new) * z * (1 - z)
            d_r = d_new * hidden * r * (1 - r)
            np.add.at(table[d], x[:, t], np.concatenate([d_z, d_r, d_new], 1))
            d_inner = np.concatenate([d_z, d_r, d_new * r], 1)
            inner_w[d] += before.T @ d_inner
            back = back * z + d_inner @ net.states[d].T
    return float(loss), [table, inner_w, out, delta.sum((0, 1))]


def fit(rows: list[tuple[str, str]], steps: int = 260, batch: int = 192, seed: int = 5) -> Network:
    """Train on (text, language) rows, whose segments are drawn evenly over each text."""
    languages = tuple(sorted({language for _, language in rows}))
    rng = np.random.default_rng(seed)
    net = Network.random(languages, rng)
    pieces, own = [], []
    for text, language in rows:
        data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
        if 0 < len(data) < FIT_SEGMENT:  # a short text teaches by its repetition
            data = np.resize(np.append(data, np.uint8(32)), FIT_SEGMENT)
        for at in np.unique(np.linspace(0, len(data) - FIT_SEGMENT, FIT_SEGMENTS).astype(int)) if len(data) else ():
            pieces.append(data[at : at + FIT_SEGMENT])
            own.append(languages.index(language))
    if len(languages) < 2 or not pieces:
        return net
    x, y = np.array(pieces), np.array(own)
    # every language is drawn as often as any other
    share = 1 / np.bincount(y, minlength=len(languages))[y]
    share /= share.sum()
    params = [net.table, net.states, net.out, net.bias]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        at = rng.choice(len(x), batch, p=share)
        _, grads = gradients(net, x[at], y[at])
        size = np.sqrt(sum((g**2).sum() for g in grads))
        for k, g in enumerate(grads):
            g = g * min(1, 1 / max(size, 1e-12))
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g**2
            params[k] -= 0.03 * (1 - step / (steps + 1)) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return net


def fit_from(docs: DataFrame, most: int = FIT_DOCUMENTS, most_chars: int = FIT_CHARS) -> Network | None:
    """The network fitted on documents with a language and a letter, as many of each language; None if there is none.

    They are ``most`` together, or FIT_EACH of each language where that is more.
    """
    taught = docs.where(F.substring("text", 1, most_chars).rlike(r"\p{L}"))
    rows = fitting_rows(taught, sample_of_each(taught, "lang", most, FIT_EACH), most_chars).orderBy("doc_id").collect()
    return fit([(r.text, r.value) for r in rows]) if rows else None


def has_letter(texts: Texts) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(_LETTER[texts.data], dtype=np.int64)])
    some = total[texts.offsets[1:]] > total[texts.offsets[:-1]]
    for i in np.flatnonzero(~some):  # few: texts without an ASCII letter
        some[i] = regex.search(r"\p{L}", texts.data[texts.offsets[i] : texts.offsets[i + 1]].tobytes().decode("utf-8", "replace")) is not None
    return some


def identify(docs: DataFrame, net: Network | None) -> DataFrame:
    """(doc_id, lang_pred, score) for each row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        net = shared.value
        for lo, texts in slices(batch["text"]):
            ids = batch["doc_id"][lo : lo + len(texts)]
            if net is None:
                yield {"doc_id": ids, "lang_pred": ["und"] * len(texts), "score": [0.0] * len(texts)}
                continue
            p, some = net.probabilities(texts), has_letter(texts)
            best = p.argmax(1)
            yield {"doc_id": ids, "lang_pred": [net.languages[b] if s else "und" for b, s in zip(best.tolist(), some.tolist())], "score": np.where(some, np.clip(p.max(1), 0, 1), 0.0)}

    return map_batches(id_and_text(docs), run, "doc_id long, lang_pred string, score double")
