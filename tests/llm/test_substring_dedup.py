import hashlib
import tracemalloc
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from tributary.llm import substring_dedup as S

from .cases import table


def brute(rows, length=13):
    last = float("inf")
    first = {}
    texts = [(i if i is not None else last, (t or "").encode().split()) for i, t in rows]
    for i, w in texts:
        for k in range(len(w) - length + 1):
            g = tuple(w[k : k + length])
            first[g] = min(first.get(g, last), i)
    out = []
    for (doc, _), (i, w) in zip(rows, texts):
        gone = [False] * len(w)
        for k in range(len(w) - length + 1):
            if first[tuple(w[k : k + length])] < i:
                gone[k : k + length] = [True] * length
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((doc, len(w), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("map_bytes,hot", [(S.MAX_MAP_BYTES, 16), (128, 2)])
def test_against_brute_force(spark, map_bytes, hot, monkeypatch):
    """With maps that are too small, what repeats comes back by joins."""
    for name, value in (("MAX_MAP_BYTES", map_bytes), ("SETTLED", 50), ("HOT", hot)):
        monkeypatch.setattr(S, name, value)
    docs = table(spark).repartition(3)
    assert Counter(tuple(r) for r in S.digest_documents(docs).collect()) == brute([(r.doc_id, r.text) for r in docs.collect()])
    assert S.digest_documents(table(spark, [])).count() == 0


def _places(df):
    return sorted(map(tuple, df.selectExpr("id", "aggregate(packed, 0L, (s, x) -> s + length(x))").collect()))


def test_every_way_finds_the_same_windows(spark, monkeypatch):
    """Full maps, joins, and levels from two words on lose nothing."""
    docs = table(spark).select("doc_id", "text")
    want = _places(S.repeated_windows(docs))
    for bytes_, least, start in ((128, 0, None), (128, 4, None), (128, 4, 4), (S.MAX_MAP_BYTES, 4, 2)):
        monkeypatch.setattr(S, "LEAST_BITS", least)
        assert _places(S.repeated_windows(docs, max_map_bytes=bytes_, start=start)) == want


def test_levels_of_the_query(spark):
    docs = table(spark).select("doc_id", "text")
    assert S.level_sizes(13) == [7, 13] and S.level_sizes(13, 2) == [2, 4, 8, 13] and S.level_sizes(50, 13) == [13, 26, 50] and S.level_sizes(1) == [1, 1]
    found = [(x.size, x.n) for x in S.levels(docs, S.level_sizes(13, 2))]
    held = Counter()
    for length in (4, 8, 13):
        at = {}
        for r in docs.collect():
            w = (r.text or "").encode().split()
            for k in range(len(w) - length + 1):
                at.setdefault(tuple(w[k : k + length]), set()).add(r.doc_id)
        held[length] = sum(len(d) > 1 for d in at.values())
    assert [x[0] for x in found] == [2, 4, 8, 13] and dict(found[1:]) == held


def test_a_task_remembers_hot_windows():
    m = S._Memory()
    h, c = np.asarray([5, 9], np.uint64), np.asarray([1, 2], np.uint32)
    assert m.least_of(h, c, np.asarray([4, 4])).tolist() == [4, 4]
    m.keep(h[:1], c[:1], np.asarray([3]))
    m.keep(h, c, np.asarray([2, 8]))
    assert m.least_of(h, c, np.asarray([4, 4])).tolist() == [2, 4] and m.least_of(h, c[::-1], np.asarray([4, 9])).tolist() == [4, 9]


def test_texts_change_and_columns_stay(spark):
    docs = table(spark)
    got = S.without_repeats(docs)
    assert got.columns == docs.columns and got.count() == docs.count()
    by = {(r.doc_id, r.text): r for r in got.collect()}
    assert (2, "") in by and by[2, ""].n_chars == 0 and by[2, ""].region == "r"
    assert any(d == 9 and len(t) > 50_000 for d, t in by)
    assert (4, None) in by and (7, "one") in by


def test_levels_double_until_none_survives(spark):
    levels = S.longest_repeats(table(spark))
    assert levels[0][0] == 13 and all(b[0] == 2 * a[0] for a, b in zip(levels, levels[1:]))
    assert levels[-1][0] > 1000  # "the the the"
    assert S.longest_repeats(table(spark, [])) == []


def test_a_batch_needs_little_memory():
    """Two workers of an executor have what its JVM leaves them."""
    batch = pa.RecordBatch.from_pydict({"doc_id": range(400), "text": ["so many words " * 700] * 400})
    run = S._first_windows(SimpleNamespace(mapInArrow=lambda run, _: run), 7, 13)
    list(run(iter([batch])))  # makes what all batches share
    tracemalloc.start()
    for _ in run(iter([batch])):
        pass
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 24 << 20


def test_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert Counter(tuple(r) for r in S.op3_substring_dedup(spark, sf_dir).collect()) == brute(rows)
