import numpy as np
from pyspark.sql import functions as F
from tributary.llm import quality as Q

from .cases import table


def test_rules_fit_a_conjunction():
    r = np.random.default_rng(1)
    x = r.random((3000, 3))
    y = ((x[:, 0] > 0.6) & (x[:, 2] <= 0.5)).astype(float)
    m = Q.fit(x, y, ["a", "b", "c"])
    total = np.full(3000, m.bias)
    for rule in m.rules:
        hold = np.ones(3000, bool)
        for name, above, at in rule.conditions:
            hold &= (x[:, "abc".index(name)] > at) == above
        total += rule.weight * hold
    assert ((total > 0) == (y == 1)).mean() > 0.97
    assert 0 < len(m.rules) < 120


def test_few_or_equal_labels():
    assert Q.fit(np.zeros((0, 2)), np.zeros(0), ["a", "b"]) == Q.Model(0.0, ())
    assert Q.fit(np.ones((5, 2)), np.ones(5), ["a", "b"]).bias > 1


def by_hand(text, model):
    """The score of one text, statistics and rules in plain Python."""
    import math
    import re
    import unicodedata

    t = text or ""
    words, lines = re.split(r"[ \t-\r]+", t), t.split("\n")
    kind = [unicodedata.category(c) for c in t]
    n = max(1, len(t))
    stats = {
        "chars": len(t), "words": len(words), "word_length": len(t) / len(words), "distinct_words": len(set(words)) / len(words), "lines": len(lines), "distinct_lines": len(set(lines)) / len(lines),
        "words_per_line": len(words) / len(lines), "upper": kind.count("Lu") / n, "digits": sum(c in "0123456789" for c in t) / n,
        "signs": sum(not (k[0] in "LN" or c in " \t\n\x0b\f\r.,") for c, k in zip(t, kind)) / n, "sentence_ends": len(re.findall(r"[.!?](?=[ \t\n\x0b\f\r]|\Z)", t)) / len(words),
    }
    total = model.bias + sum(r.weight for r in model.rules if all((stats[k] > at) == above for k, above, at in r.conditions))
    return 1 / (1 + math.exp(-total))


def test_scores_by_hand(spark):
    """A learned model's column against the same model in plain Python, on whole texts of two tables."""
    d = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    model = Q.learn(docs, labels.where(~Q.held_out(F.col("doc_id"))))
    assert model.rules and any(len(r.conditions) > 1 for r in model.rules)
    both = docs.select("doc_id", "text").union(table(spark).where("doc_id <> 14").select("doc_id", "text"))
    texts = {(r.doc_id, i): r.text for i, r in enumerate(both.collect())}
    want = sorted(((d, round(by_hand(t, model), 9)) for (d, _), t in texts.items()), key=str)
    assert sorted(((r.doc_id, round(r.score, 9)) for r in Q.score(both, model).collect()), key=str) == want


def test_every_row_gets_a_score(spark):
    docs = table(spark)
    model = Q.Model(-0.5, (Q.Rule((("words", True, 5.0), ("signs", False, 0.2)), 1.5),))
    got = Q.score(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert Q.score(table(spark, []), model).count() == 0
    nothing = Q.learn(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert nothing == Q.Model(0.0, ())


def test_held_out_accuracy_and_no_leak(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    got = Q.op5_quality(spark, d).join(labels, "doc_id")
    r = got.where("held_out").agg(F.avg((F.col("predicted") == F.col("quality")).cast("int")).alias("a"), F.count("*").alias("n")).first()
    assert r.n > 50 and r.a > 0.95
    assert got.where((F.crc32(F.col("doc_id").cast("string")) % 3 == 1) != F.col("held_out")).count() == 0


def test_scoring_needs_neither_shuffle_nor_python(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plan = Q.score(docs, Q.Model(0.1, (Q.Rule((("words", True, 5.0),), 1.0),)))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
