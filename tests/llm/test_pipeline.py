import hashlib

import corpus_pipeline
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer
from tributary.llm import lang_id
from pyspark.sql import functions as F

from .cases import table
from .test_decontaminate import ITEM
from .test_jaccard_join import brute as similar
from .test_substring_dedup import brute as repeats


def test_stages_against_brute_force(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names, order = docs.columns, [n for n, _ in corpus_pipeline.STAGES]
    assert order == ["language_id", "jaccard_join", "substring_dedup", "decontamination", "bpe"]
    inputs = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        inputs[name] = {r.doc_id: r for r in docs.collect()}
        docs = stage(spark, docs, sf_dir)
        docs.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if name != "bpe":
            assert docs.columns == names
    out = {r.doc_id: r for r in docs.collect()}
    text = lambda stage: [(d, r.text) for d, r in sorted(inputs[stage].items())]

    first = spark.read.parquet(f"{sf_dir}/documents.parquet")
    judged = lang_id.predict(first, lang_id.learn(first.where(~lang_id.held_out(F.col("doc_id")))))
    assert set(inputs["jaccard_join"]) == {r.doc_id for r in judged.where("not rejected").collect()}
    assert set(inputs["substring_dedup"]) == {d for d, _, _, c in similar(text("jaccard_join")) if d == c}
    left = {d: (gone, sha) for d, _, gone, sha in repeats(text("substring_dedup"))}
    for d, r in inputs["decontamination"].items():
        gone, sha = left[d]
        assert (hashlib.sha256(r.text.encode()).hexdigest() == sha) if gone else r.text == inputs["substring_dedup"][d].text
        assert r.n_chars == len(r.text)
    items = [" ".join(r.text.split()) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    for d, r in inputs["decontamination"].items():
        if any(i in " ".join(r.text.split()) for i in items):
            assert d not in inputs["bpe"]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert set(out) == set(inputs["bpe"])
    for d, r in inputs["bpe"].items():
        ids = library.encode(r.text, add_special_tokens=False).ids
        assert (out[d].n_tokens, out[d].ids_sha256) == (len(ids), hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest())


def test_clashing_columns_and_empty_tables(spark, sf_dir, tmp_path):
    for name, docs in (("some", table(spark)), ("none", table(spark, []))):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            got = stage(spark, docs, sf_dir)
            assert k == 4 or got.columns == docs.columns
            got.write.parquet(f"{tmp_path}/{name}{k}")
            docs = spark.read.parquet(f"{tmp_path}/{name}{k}")
    assert docs.count() == 0
