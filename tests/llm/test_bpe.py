import hashlib
import json
import random
import tracemalloc
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql.types import LongType
from tokenizers import Tokenizer
from tributary.llm import bpe

from .cases import table

PATH = public_tokenizers.path("byte_bpe_50k.json")
SIGNS = ["a", "b", "the", " ", "  ", "\n", "\t", "'s", "'ll", "é", "ß", "中", "😀", "\u0301", "\x85", "\u00a0", "1", "23", "!", "...", "<|endoftext|>", "<|endof", "\u3000", "\x1c", "\u0558", "Ω", "_", "-", "\r\n", "x" * 300, "ab" * 200]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_same_ids_as_the_library(library):
    mine, r = bpe.vocabulary(PATH), random.Random(7)
    for _ in range(4000):
        text = "".join(r.choice(SIGNS) for _ in range(r.randrange(14)))
        want = library.encode(text, add_special_tokens=False).ids
        ids = mine.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == want, repr(text)
        assert mine.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_short_and_long_words_merge_alike():
    mine, r = bpe.vocabulary(PATH), random.Random(8)
    for _ in range(200):
        word = "".join(r.choice("aethinos ") for _ in range(r.randrange(1, 150))).encode()
        assert mine.merge(word) == mine._merge_long(word)


def test_memory_of_two_generations():
    m = bpe._Memory(3)
    for c in "abcdae":
        if m.known(c) is None:
            m.keep_all({c: c.upper()})
    assert m.known("a") == "A" and m.known("e") == "E" and m.known("z") is None and len(m.young) <= 4 and len(m.old) <= 4


def test_words_merged_as_rows_and_one_by_one():
    mine, r = bpe.vocabulary(PATH), random.Random(9)
    words = ["".join(r.choice("aethinoslé") for _ in range(r.randrange(1, 12))) for _ in range(3000)] + ["x" * 300, "q" * 161, "a"]
    assert [np.frombuffer(x, "<u4").tolist() for x in mine.merge_many(words)] == [mine.merge(w.encode()) for w in words]
    assert mine.merge_many([]) == []


def test_many_texts_with_small_memories(library, monkeypatch):
    with open(PATH, encoding="utf-8") as f:
        mine = bpe.ByteBpe(json.load(f))
    mine.pieces.size = mine.spaced.size = 5
    r = random.Random(10)
    for _ in range(60):
        texts = [None if r.random() < 0.1 else "".join(r.choice([*SIGNS, " and", " of,", " x1", "don't "]) for _ in range(r.randrange(20))) for _ in range(30)]
        want = [e.ids for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
        got = mine.encode_many(texts)
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == want
        assert mine.decode_many(got) == [library.decode(x, skip_special_tokens=False) for x in want]
    assert mine.encode_many([]) == [] == mine.decode_many([])


@pytest.mark.parametrize("change", [{}, {"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}}, {"pre_tokenizer": {"type": "Whitespace"}}])
def test_other_vocabulary_files_are_left_to_the_library(change, tmp_path):
    with open(PATH if change else public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        spec = json.load(f) | change
    (tmp_path / "v.json").write_text(json.dumps(spec))
    mine, other = bpe.vocabulary(str(tmp_path / "v.json")), Tokenizer.from_file(str(tmp_path / "v.json"))
    assert isinstance(mine, bpe.LibraryBpe)
    texts = ["Some Words, and SOME more", None, "", " a  b\n12 don't"]
    want = [other.encode(t or "", add_special_tokens=False).ids for t in texts]
    got = mine.encode_many(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == want and [np.frombuffer(mine.encode(t), "<u4").tolist() for t in texts] == want
    assert mine.decode_many(got) == [other.decode(x, skip_special_tokens=False) for x in want]


def test_rows(spark, library):
    docs = table(spark)
    got = bpe.encode_documents(docs, PATH)
    texts = sorted((r.text or "") for r in bpe.decode_documents(got, PATH).collect())
    assert texts == sorted((r.text or "") for r in docs.collect())
    for r in bpe.digest_documents(docs, PATH).collect():
        assert r.n_tokens >= 0
    assert bpe.digest_documents(table(spark, []), PATH).count() == 0


@pytest.mark.parametrize("step", [bpe.digest_documents, bpe.encode_documents])
def test_a_task_holds_few_words_and_leaves_none(step):
    """Its process goes on to other steps, with what memory the executor has."""

    def batches(n):
        for k in range(n):
            words = ("".join(chr(97 + i // 26**j % 26) for j in range(5)) for i in range(k * 20_000, (k + 1) * 20_000))
            yield pa.RecordBatch.from_pydict({"doc_id": [k], "text": [" ".join(words)]})

    docs = SimpleNamespace(schema={"doc_id": SimpleNamespace(dataType=LongType())}, mapInArrow=lambda run, _: run)
    docs.select = lambda *_: docs
    run = step(docs, PATH)
    list(run(batches(1)))  # loads the vocabulary
    tracemalloc.start()
    held = [tracemalloc.get_traced_memory()[0] for _ in run(batches(15))]
    left = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert max(held) < 28 << 20 and left < 2 << 20


def test_query(spark, sf_dir, library):
    want = set()
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        out = library.decode(ids, skip_special_tokens=False)
        want.add((r.doc_id, len(ids), hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(out.encode()).hexdigest()))
    assert {tuple(r) for r in bpe.op4_bpe(spark, sf_dir).collect()} == want
