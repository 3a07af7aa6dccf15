import re
from collections import Counter, defaultdict

import pytest
from tributary.llm import decontaminate as D

from .cases import rows, table, words

ITEM = "Alice bought 12 apples for 3 dollars each and Bob sold 12 pears in Paris while Carol walked 5 miles to the market to count 12 apples"
PROSE = "nothing to see in these few words of quite ordinary prose"


def found(spark, text, items=((1, ITEM),)):
    docs = spark.createDataFrame([(5, text)], "doc_id long, text string")
    bench = spark.createDataFrame(list(items), "item_id long, text string")
    return [(r.item_id, r.kind) for r in D.find_items(docs, bench).collect()]


def test_exact_and_changed_values(spark):
    assert found(spark, f"{PROSE}. {ITEM}. {PROSE}") == [(1, "exact")]
    assert found(spark, f"{PROSE}. {ITEM.replace(' ', '  ').replace('each', 'each,')}") == [(1, "exact")]
    changed = ITEM.replace("12", "77").replace("Bob", "John").replace("miles", "km").replace("Paris", "New York")
    assert found(spark, f"{PROSE}. {changed}.") == [(1, "reparameterised")]


def test_inconsistent_values_are_no_copy(spark):
    assert found(spark, ITEM.replace("12", "7", 1).replace("12", "8", 1).replace("12", "9", 1)) == []


def test_short_and_unlike_texts(spark):
    assert found(spark, " ".join(ITEM.split()[:9])) == []
    assert found(spark, PROSE, [(1, ITEM), (2, None), (3, "too short"), (4, "")]) == []


def gone(docs, kept):
    return sorted((Counter(r.doc_id for r in docs.collect()) - Counter(r.doc_id for r in kept.collect())).elements())


@pytest.mark.parametrize("parts", [D.MAX_INDEX, 20])
def test_rows_and_parts(spark, parts):
    # words with digits are numbers here, so digits become letters
    spell = lambda t: None if t is None else t.translate(str.maketrans("0123456789", "abcdefghij"))
    docs = table(spark, [(r[0], spell(r[1]), *r[2:]) for r in rows()])
    bench = spark.createDataFrame([(1, spell(words(40, 3))), (2, spell(words(40, 77))), (1, spell(words(30, 4))), (None, spell(words(30, 78)))], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id or 0) for r in D.find_items(docs, bench, parts).collect())
    assert got == [(10, 1), (10, 1), (10, 1), (11, 1), (15, 1)]
    kept = D.without_items(docs, bench, parts)
    assert kept.columns == docs.columns and gone(docs, kept) == [10, 10, 11, 15]
    assert D.find_items(docs, bench.limit(0)).count() == 0 == D.find_items(table(spark, []), bench).count()


@pytest.mark.parametrize("parts", [D.MAX_INDEX, 200])
def test_rows_of_words_with_digits(spark, parts):
    docs = table(spark)
    bench = spark.createDataFrame([(1, words(40, 3)), (2, words(40, 77)), (1, words(30, 4)), (None, words(30, 5))], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id or 0) for r in D.find_items(docs, bench, parts).collect())
    assert got == [(10, 1), (10, 1), (10, 1), (11, 0), (11, 1), (15, 1)]
    kept = D.without_items(docs, bench, parts)
    assert kept.columns == docs.columns and gone(docs, kept) == [10, 10, 11, 15]


VERBATIM = [
    "Who wrote Middlemarch?",
    "12 + 30 * 4 = 132; 5 * 5 * 5 = 125; 9 - 3 = 6; 18 / 3 = 6",
    "Then Alice and Bob Brown met Carol and Dave Dunn near Paris with Erin Eames and Frank Fry of New York",
    "x1 = y2 + z3; if x1 > w4: return q5(x1, y2, z3, w4) else: return p6(z3, w4, y2, x1)",
    "Кто написал Войну и Мир в Ясной Поляне",
    "Yes",
]


@pytest.mark.parametrize("item", VERBATIM)
def test_any_verbatim_copy_is_found(spark, item):
    for copy in (item, item.lower(), item.upper()):
        assert found(spark, f"{PROSE}. {copy} {PROSE}.", [(1, item)]) == [(1, "exact")]
    assert found(spark, PROSE, [(1, item)]) == []


@pytest.mark.parametrize("size,part", [(59, 20), (59, 14), (500, 150), (1000, 14)])
def test_verbatim_passages_of_long_items(spark, size, part):
    item = words(size, 8).split()
    for at in (0, size // 3, size - part):
        passage = " ".join(item[at : at + part])
        assert found(spark, f"{PROSE}. {passage} {PROSE}.", [(1, " ".join(item))]) == [(1, "exact")]
        assert found(spark, f"{PROSE}. {' '.join(item[at : at + 13])} {PROSE}.", [(1, " ".join(item))]) == []


def test_query_against_brute_force(spark, sf_dir):
    d = "/root/testdata/sf0.01"
    canon = lambda t: re.findall(r"[^\W_]+", t.lower())
    index = defaultdict(set)
    items = {r.item_id: canon(r.text) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()}
    for i, w in items.items():
        for k in range(len(w) - 7):
            index[tuple(w[k : k + 8])].add((i, k))
    want = set()
    for r in spark.read.parquet(f"{d}/documents.parquet").collect():
        w, hits = canon(r.text), defaultdict(set)
        for k in range(len(w) - 7):
            for i, p in index.get(tuple(w[k : k + 8]), ()):
                hits[i].add(p)
        want |= {(r.doc_id, i) for i, p in hits.items() if len(p) >= 0.9 * (len(items[i]) - 7)}
    assert {(r.doc_id, r.item_id) for r in D.op6_decontaminate(spark, d).collect()} == want and want
