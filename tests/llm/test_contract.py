import importlib

import pytest

from tributary.llm import queries

COLUMNS = {
    "op1_": [("page_id", "bigint"), ("host", "string"), ("path", "string"), ("rule", "string"), ("verdict", "string")],
    "op3_": [("doc_id", "bigint"), ("n_words", "bigint"), ("n_removed", "bigint"), ("kept_sha256", "string")],
    "op4_": [("doc_id", "bigint"), ("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")],
    "op5_": [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")],
    "op7_": [("doc_id", "bigint"), ("n_shingles", "bigint"), ("n_similar", "bigint"), ("component_id", "bigint")],
    "op8_": [("doc_id", "bigint"), ("n_chars", "bigint"), ("edited_sha256", "string"), ("fingerprint", "string"), ("edited_fingerprint", "string"), ("near_edited", "double"), ("near_next", "double")],
    "op9_": [("doc_id", "bigint"), ("held_out", "boolean"), ("lang_pred", "string"), ("score", "double")],
    "op10_": [("doc_id", "bigint"), ("start", "bigint"), ("n_tokens", "bigint"), ("ids_crc32", "bigint")],
}


def test_one_query_of_each_operator():
    numbers = sorted(int(k[2:].split("_")[0]) for k in queries.QUERIES)
    assert numbers == list(range(1, 11))
    entry = importlib.import_module("__spark_entry__")
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())


def test_columns(spark, sf_dir):
    for name, query in queries.QUERIES.items():
        want = next((c for p, c in COLUMNS.items() if name.startswith(p)), None)
        if want:
            assert query(spark, sf_dir).dtypes[: len(want)] == want, name


def test_ids_that_are_no_integers(spark):
    """Operators that need the order of doc_ids say so; the others take any."""
    from tributary.llm import bpe, fingerprint, jaccard_join, lang_id, substring_dedup, token_files

    docs = spark.createDataFrame([("a", "some words", "en"), ("b", None, "en")], "doc_id string, text string, lang string")
    for ordered in (substring_dedup.digest_documents, substring_dedup.without_repeats, jaccard_join.similar_documents, fingerprint.compare_neighbours, lambda d: token_files.write_token_files(d, "", "")):
        with pytest.raises(TypeError):
            ordered(docs)
    import public_tokenizers

    assert bpe.digest_documents(docs, public_tokenizers.path("byte_bpe_50k.json")).count() == 2 == fingerprint.fingerprint_documents(docs).count()
    assert lang_id.predict(docs, lang_id.learn(docs)).count() == 2
