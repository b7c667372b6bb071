"""The corpus pipeline against brute-force versions of its stages, on the smallest tables."""

import hashlib
import os

import pytest

import corpus_pipeline
from courtloom.llm.queries import QUERIES, tokenizer_path
from tests.llm.test_links import brute_links
from tests.llm.test_text import plain_spans

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


def plain_redaction(text):
    spans = sorted((int(s.split(":")[1]), int(s.split(":")[2]), i, s.split(":")[0]) for i, s in enumerate(plain_spans(text).split(",")) if s)
    out, at = "", 0
    for low, high, _, kind in spans:
        if low >= at:
            out += text[at:low] + f"[{kind.upper()}]"
        at = max(at, high)
    return out + text[at:]


@needs_data
def test_stages_equal_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept[name] = docs.collect()
        assert name == "bpe" or docs.columns == columns
    assert list(kept) == ["quality_rules", "ngram_jaccard_join", "benchmark_decontamination", "pii", "bpe"]
    verdict = {r.doc_id: r.kept for r in QUERIES["op10_quality_rules"](spark, SF).collect()}
    assert {r.doc_id for r in kept["quality_rules"]} == {d for d, k in verdict.items() if k}
    classes = brute_links([(r.doc_id, r.text) for r in kept["quality_rules"]])
    assert sorted(r.doc_id for r in kept["ngram_jaccard_join"]) == sorted(d for d, c, _ in classes if d == c)

    leaked = {r.doc_id for r in QUERIES["op5_benchmark_decontamination"](spark, SF).collect()}
    assert {r.doc_id for r in kept["benchmark_decontamination"]} == {r.doc_id for r in kept["ngram_jaccard_join"]} - leaked
    before = {r.doc_id: r.text for r in kept["benchmark_decontamination"]}
    assert len(kept["pii"]) == len(before)
    for r in kept["pii"]:
        assert r.text == plain_redaction(before[r.doc_id]) and r.n_chars == len(r.text)

    from tokenizers import Tokenizer

    tokenizer, texts = Tokenizer.from_file(tokenizer_path()), {r.doc_id: r.text for r in kept["pii"]}
    assert len(kept["bpe"]) == len(texts)
    for r in kept["bpe"]:
        ids = tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, kept["bpe"]))


def test_stages_bear_odd_rows(spark):
    rows = [(None, None, None, None, None), (1, None, "en", "a", 0), (2, "", None, "b", 0), (2, "", None, "b", 0), (3, "w " * 90, "en", "c", 180)]
    rows = [(*r, "own", 7, False, "s") for r in [*rows, (9, " ".join(f"w{i}" for i in range(70)), "en", "d", 300)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, summary string, job_id long, kept boolean, stats string")
    kept = corpus_pipeline.quality(spark, docs, SF).collect()
    assert [(r.doc_id, r.summary, r.job_id, r.kept, r.stats) for r in kept] == [(9, "own", 7, False, "s")]
    for docs in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            assert out.count() <= docs.count() and (name == "bpe" or out.columns == docs.columns), name


def test_each_operator_is_registered_once():
    numbers = sorted(int(n[2:].split("_")[0]) for n in QUERIES)
    assert numbers == list(range(1, 14)) and len(corpus_pipeline.STAGES) == 5
