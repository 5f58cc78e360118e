import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from llm import brute
from panelspark.llm import language, mixing, store

DIR = "/root/testdata/sf0.001"


def test_pipeline_against_plain_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    good = {r["doc_id"] for r in language.languages(docs).collect() if r["lang_pred"] != "und" and r["score"] >= 0.4}
    assert len(good) >= 0.98 * len(rows)
    kept = [(k, rows[k]["text"]) for k in sorted(good)]
    kept = [(k, rows[k]["text"]) for k, _, _, keeps in brute.near(kept, 5, 80) if keeps]
    items = [tuple(r) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    kept = [(r[0], rows[r[0]]["text"]) for r in brute.leaks(kept, items) if not r[-1]]
    sizes = {}
    for k, t in kept:
        sizes[rows[k]["source"]] = sizes.get(rows[k]["source"], 0) + len(t.encode().split())
    targets = brute.mix_targets(sizes)

    d, counts = docs, []
    for _, stage in corpus_pipeline.STAGES[:4]:
        d = stage(spark, d, DIR).cache()
        assert d.columns == docs.columns
        counts.append(d.count())
        if len(counts) == 3:
            assert sorted(r["doc_id"] for r in d.collect()) == sorted(k for k, _ in kept)
    mixed = d.collect()
    words = {}
    for r in mixed:
        words[r["source"]] = words.get(r["source"], 0) + len(r["text"].encode().split())
    assert all(abs(words.get(s, 0) - targets[s]) <= 1 for s in targets)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted((r["doc_id"], zlib.crc32(np.array(tokenizer.encode(r["text"], add_special_tokens=False).ids + [0], "<u4").tobytes())) for r in mixed)
    found = corpus_pipeline.run(spark, DIR).collect()
    assert sorted((r["doc_id"], r["ids_crc32"]) for r in found) == want


def test_token_files_are_in_training_order(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    mixed, _ = store.materialise(corpus_pipeline.order_mix(spark, docs, DIR), "mixed")
    found = corpus_pipeline.write_tokens(spark, mixed, DIR).orderBy("start").collect()
    assert [r["doc_id"] for r in found] == [r["doc_id"] for r in mixing.training_order(docs).collect()]


def test_stages_are_the_ones_asked_for():
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
