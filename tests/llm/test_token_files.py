import io
import json
import random
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer
from tributary.llm import token_files as T
from tributary.llm.io import scratch_uri

from .cases import table

PATH = public_tokenizers.path("word_bpe_49k.json")
SIGNS = ["a", "B", "the", " ", "  ", "\n", "\t", "'s", "'LL", "é", "ß", "中", "😀", "́", "\x85", " ", "1", "23", "!", "...", "&&&", "$$$", "<|", "|>", "<|endoftext|>", "<|startoftext|>", "Σ", "ΑΣ", "İ", "_", "\r\n", "ﬁ", "x" * 30, "À", "×"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.mark.parametrize("seed", range(4))
def test_round_trip(seed):
    r = np.random.default_rng(seed)
    docs = []
    for k in range(300):
        x = r.integers(0, 49_408, r.integers(0, 4000)).astype(np.uint32)
        if k % 7 == 0:
            x %= 3
        if k % 11 == 0:
            x[::40] = 2**32 - 1
        docs.append(x)
    f = io.BytesIO()
    f.close = lambda: None
    w = T.Writer(f, block=256, percentile=[0.9, 0.98, 1.0, 0.5][seed])
    for k, x in enumerate(docs):
        w.add(k or None, x)
    w.close()
    reader = T.Reader(io.BytesIO(f.getvalue()))
    assert reader.docs == [None, *range(1, 300)] and reader.total == sum(map(len, docs))
    assert all(np.array_equal(a, b) for (_, a), b in zip(reader, docs))
    for k in (0, 1, 150, 299):
        assert np.array_equal(reader.document(k), docs[k])


def test_outliers_are_patched():
    x = np.full((1, 1024), 5, np.uint32)
    x[0, ::200] = 1 << 30
    (block,) = T.encode_blocks(x)
    assert len(block) < 60 and np.array_equal(T.decode_blocks([block]), x[0])


def test_empty_part_and_wrong_file():
    f = io.BytesIO()
    f.close = lambda: None
    T.Writer(f).close()
    assert list(T.Reader(io.BytesIO(f.getvalue()))) == []
    with pytest.raises(ValueError):
        T.Reader(io.BytesIO(b"x" * 100))


def test_units_give_the_library_ids(library):
    r, encoder = random.Random(5), T.UnitEncoder(PATH, size=500)
    for _ in range(4):
        texts = ["".join(r.choice(SIGNS) for _ in range(r.randrange(14))) for _ in range(1500)] + [None, ""]
        ids, bounds = encoder(pa.array(texts))
        for t, x in zip(texts, np.split(ids, bounds[1:-1])):
            assert library.encode(t or "", add_special_tokens=False).ids == x.tolist(), repr(t)


@pytest.mark.parametrize("bits", [3, 12])
def test_pieces_of_one_hash_are_told_apart(bits, library, monkeypatch):
    pieces_of, r = T.pieces_of, random.Random(bits)
    monkeypatch.setattr(T, "pieces_of", lambda text: (p := pieces_of(text))._replace(h1=p.h1 >> np.uint64(64 - bits)))
    monkeypatch.setattr(T, "_WORDS", 5)
    encoder = T.UnitEncoder(PATH, size=50)
    for n in (1, 1, 1, 2, 40, 1, 300):
        texts = ["".join(r.choice(SIGNS) for _ in range(r.randrange(14))) for _ in range(n)]
        ids, bounds = encoder(pa.array(texts))
        assert [x.tolist() for x in np.split(ids, bounds[1:-1])] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_known_pieces_take_few_bytes():
    def slice_of(k):
        return pa.array([" ".join("".join(chr(97 + i // 26**j % 26) for j in range(5)) for i in range(k * 10_000, (k + 1) * 10_000))])

    encoder = T.UnitEncoder(PATH, size=20_000)
    T.UnitEncoder(PATH)(slice_of(9))  # makes what all encoders share
    tracemalloc.start()
    for k in range(5):
        encoder(slice_of(k))
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 50_000 * 64


@pytest.mark.parametrize("name,whole", [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True), ("changed", True)])
def test_other_vocabulary_files_are_left_to_the_library(name, whole, tmp_path):
    path = PATH
    if name == "changed":  # letters and signs no longer part
        with open(PATH, encoding="utf-8") as f:
            spec = json.load(f)
        spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] = r"\S+"
        path = str(tmp_path / "v.json")
        (tmp_path / "v.json").write_text(json.dumps(spec))
    elif whole:
        path = public_tokenizers.path(name)
    encoder, other = T.encoder_of(path), Tokenizer.from_file(path)
    assert isinstance(encoder, T.WholeEncoder) == whole
    texts = ["Some Words, and SOME more!!", None, "", " a  b\n12 don't", "x, y"]
    ids, bounds = encoder(pa.array(texts))
    assert [x.tolist() for x in np.split(ids, bounds[1:-1])] == [other.encode(t or "", add_special_tokens=False).ids for t in texts]


def expected(library, rows):
    start, out = 0, []
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = np.asarray([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return sorted(out, key=str)


def test_rows(spark, library):
    docs = table(spark)
    parts = T.write_token_files(docs.repartition(4), scratch_uri(spark), PATH)
    got = T.read_token_files(spark, parts, with_ids=True).collect()
    assert sorted((tuple(r)[:4] for r in got), key=str) == expected(library, [(r.doc_id, r.text) for r in docs.collect()])
    assert all(zlib.crc32(np.asarray(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in got)
    assert T.read_token_files(spark, T.write_token_files(table(spark, []), scratch_uri(spark), PATH)).count() == 0


def test_query(spark, sf_dir, library):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in T.op10_token_files(spark, sf_dir).collect()), key=str) == expected(library, rows)
