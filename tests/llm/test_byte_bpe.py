import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken

from pointloom.llm import byte_bpe as B
from pointloom.llm.textkernel import slices
from tests.llm.conftest import EDGES


@pytest.fixture(scope="module")
def ranks():
    return B.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@pytest.fixture(scope="module")
def encoding(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_spans_are_the_pattern_s_matches():
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab sS'tdlrevm  \n\t1٣é中  $%'’😀\x1c\x85") for _ in range(rng.randint(0, 40))) for _ in range(5000)] + ["'", "''s", "'ll", "x'll'd 're", "  's", "a're'", ""]
    # white space as the Unicode property has it
    pattern = regex.compile(public_tokenizers.PATTERN.replace(r"[^\s", r"[^\p{White_Space}").replace(r"(?!\S)", r"(?!\P{White_Space})").replace(r"\s", r"\p{White_Space}"))
    for lo, part in slices(pa.array(texts)):
        starts, ends, ptr = B.pretoken_spans(part)
        body = part.data.tobytes()
        for i in range(len(part)):
            assert [body[a:b].decode() for a, b in zip(starts[ptr[i] : ptr[i + 1]], ends[ptr[i] : ptr[i + 1]])] == pattern.findall(texts[lo + i])


def test_merges_of_long_words(ranks, encoding):
    for word in ("a" * 300, "ab" * 99, "thntblereofthen" * 20, "éàç" * 40, "0123456789" * 9):
        assert B.merge_word(word.encode(), ranks) == encoding.encode_ordinary(word)


def expected(rows, encoding):
    out = []
    for i, t in rows:
        ids = encoding.encode_ordinary(t or "")
        out.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


def test_ids_and_round_trip(spark, documents, rows, edges, ranks, encoding):
    found = lambda df, **k: sorted(map(tuple, B.digests(df, ranks, **k).collect()), key=str)
    assert found(documents) == expected(rows, encoding)
    assert found(edges) == expected(EDGES, encoding)
    # two chunks with the same content
    assert found(edges.unionAll(edges).coalesce(1), chunk_bytes=700) == expected(EDGES * 2, encoding)
    assert found(edges.limit(0)) == []
