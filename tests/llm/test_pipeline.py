import hashlib

import numpy as np
import public_tokenizers
import tiktoken

import corpus_pipeline as P
from pointloom.llm import byte_bpe, decontaminate, quality_rules, queries
from tests.llm.test_minhash import brute as components
from tests.llm.test_substring_dedup import WORD


def test_stages_one_by_one(spark, documents, small):
    docs = documents
    kept = P.quality(spark, docs, small)
    model = quality_rules.fit_from(documents, spark.read.parquet(f"{small}/labels.parquet"))
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in quality_rules.quality_rules(docs, model).where("kept").collect()}
    kept = kept.cache()
    single = P.near_dedup(spark, kept, small).cache()
    assert {r.doc_id for r in single.collect()} == {r[0] for r in components([(r.doc_id, r.text) for r in kept.collect()]) if r[3]}
    before = {r.doc_id: r.text for r in single.collect()}
    cut = P.substrings(spark, single, small).cache()
    first = {}
    for i in sorted(before):
        w = WORD.findall(before[i] or "")
        gone = {q for p in range(len(w) - 49) if first.setdefault(tuple(w[p : p + 50]), i) < i for q in range(p, p + 50)}
        expected = " ".join(x for q, x in enumerate(w) if q not in gone) if gone else before[i]
        assert cut.where(f"doc_id = {i}").first().text == expected if gone else True
    assert cut.count() == single.count()
    clean = P.decontamination(spark, cut, small).cache()
    leaking = {r.doc_id for r in decontaminate.leaks(cut, spark.read.parquet(f"{small}/benchmark.parquet")).collect()}
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in cut.collect()} - leaking
    assert all(f.columns == documents.columns for f in (kept, single, cut, clean))
    ranks = byte_bpe.read_ranks(public_tokenizers.path(queries.VOCABULARY))
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r.doc_id: r.text for r in clean.collect()}
    final = {r.doc_id: r for r in P.run(spark, small).collect()}
    assert final.keys() == texts.keys()
    for i, t in texts.items():
        assert final[i].ids_sha256 == hashlib.sha256(np.array(encoding.encode_ordinary(t), "<u4").tobytes()).hexdigest()


def test_stages_take_empty_and_odd_tables(spark, small, documents):
    odd = spark.createDataFrame([(1, None, "en", "s", 0), (2, "", None, None, None), (2, "", None, None, None)], documents.schema)
    for docs in (odd, odd.limit(0)):
        for _, stage in P.STAGES:
            assert stage(spark, docs, small).count() <= docs.count()


def test_registered_queries_have_whole_results(spark, small, documents):
    n = documents.count()
    for name in ("op1_quality_rules", "op2_quality_classifier", "op5_substring_dedup", "op7_license_scan", "op8_byte_bpe", "op9_minhash", "op10_language_id"):
        assert queries.QUERIES[name](spark, small).count() == n
