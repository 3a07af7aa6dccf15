from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tributary.llm import components as C
from tributary.llm import jaccard_join as J

from .cases import table, words

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def brute(rows):
    sets = []
    for _, t in rows:
        w = (t or "").encode().translate(LOWER).split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    at, shared = defaultdict(list), Counter()
    for i, s in enumerate(sets):
        for g in s:
            at[g].append(i)
    for held in at.values():
        for i in held:
            for j in held:
                if i < j:
                    shared[i, j] += 1
    root, degree = list(range(len(rows))), Counter()

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (i, j), k in shared.items():
        if 100 * k >= 80 * (len(sets[i]) + len(sets[j]) - k):
            degree[i] += 1
            degree[j] += 1
            root[find(j)] = find(i)
    groups = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        groups[find(i)].append(d)
    least = {k: min((d for d in g if d is not None), default=None) for k, g in groups.items()}
    return Counter((d, len(sets[i]), degree[i], least[find(i)]) for i, (d, _) in enumerate(rows))


def result(df):
    return Counter((r.doc_id, r.n_shingles, r.n_similar, r.component_id) for r in df.collect())


@pytest.mark.parametrize("open_at", [64, 2])
def test_against_brute_force(spark, open_at, monkeypatch):
    monkeypatch.setattr(J, "OPEN", open_at)
    docs = table(spark).repartition(3)
    assert result(J.similar_documents(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize("exact,mapped,rounds", [(3, 10**8, J.ROUNDS), (3, 0, 1)])
def test_many_ids_and_pivots(spark, exact, mapped, rounds, monkeypatch):
    """Beyond some hashes bit maps are used, beyond some ids a join, and beyond some rounds what is left
    open is joined as it is; the result stays."""
    for name, value in (("OPEN", 2), ("EXACT_HASHES", exact), ("MAPPED_IDS", mapped), ("ROUNDS", rounds)):
        monkeypatch.setattr(J, name, value)
    docs = table(spark).repartition(3)
    assert result(J.similar_documents(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_ids_are_spread_over_the_map(spark, monkeypatch):
    monkeypatch.setattr(J, "EXACT_HASHES", 1000)
    classes = spark.range(0, 200_000, 2).select(F.col("id").alias("rep"))
    _, wanted = J._rows_with(spark.createDataFrame([], "doc_id long, text string"), classes)
    assert wanted.map is not None
    inside, outside = (wanted.has(J._mixed(pa.array(range(k, 200_000, 2), pa.int64()))) for k in (0, 1))
    assert inside.all() and outside.mean() < 0.1
    spread = J._mixed(pa.array(range(10_000), pa.int64())) >> np.uint64(56)
    assert len(set(spread.tolist())) > 200


@pytest.mark.parametrize("bits", [1, 3])
def test_classes_that_share_a_key(spark, bits, monkeypatch):
    monkeypatch.setattr(J, "CLASS_BITS", bits)
    monkeypatch.setattr(J, "OPEN", 2)
    docs = table(spark).repartition(2)
    assert result(J.similar_documents(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])
    rows = [(1, words(60, 1)), (2, words(60, 1)), (3, words(50, 2)), (4, words(50, 3))]
    assert sorted(r.doc_id for r in J.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == [1, 3, 4]


def test_hot_pivots_are_told_over_a_whole_task(spark, monkeypatch):
    """Few rows of a pivot come in each batch, many in the task: one row stands for the rest."""
    monkeypatch.setattr(J, "OPEN", 4)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = [(i, 9, [7, 1000 + i]) for i in range(1, 400)]
        df = spark.createDataFrame(rows, "cid long, n int, win array<long>").coalesce(1)
        found = J._regions(df).collect()
        assert {(r.a, r.b) for r in found} == {(7, None)}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2500")


def test_voronoi_cells_of_a_region():
    """Every similar pair meets in some cell, with one of both at home; most pairs meet in none."""
    texts, cells = [], []
    for g in range(12):
        base = words(120, 200 + g).split()
        for k in range(9):
            # neighbours of all distances: each some words further from the group's first
            texts.append(" ".join([*base[: 120 - 6 * k], *words(6 * k, 300 + 10 * g + k).split()]))
        texts += [" ".join([*base[:110], *words(10, 900 + 10 * g + k).split()]) for k in range(6)]
    members = []
    for _, _, text in J.chunks(pa.array(texts, pa.large_string())):
        h, bounds = J.shingles(text)
        members = [(i, True, h[x:y]) for i, (x, y) in enumerate(zip(bounds, bounds[1:]))]
    whole = set(zip(*J._exact(members)))
    for cell in (4, 16):
        cells = list(J._cells(members, cell))
        assert len(cells) > 5 and {p for part in cells for p in zip(*J._exact(part))} == whole
    assert len(whole) > 50 and sum(len(c) ** 2 for c in cells) < len(members) ** 2 / 2


def chain():
    """A crowd of near copies, each some words further from the first, with a passage all share."""
    base, rows = words(300, 50).split(), []
    for i in range(40):
        changed = list(base)
        for k in range(i):
            changed[(k * 37) % 300] = f"x{i}y{k}"
        rows.append((i, " ".join(changed)))
    rows += [(100 + i, words(60, 60 + i) + " " + words(80, 59)) for i in range(30)]
    return rows


@pytest.mark.parametrize("sets,shingles", [(4000, 1_500_000), (9, 1_500_000), (4000, 3000)])
def test_regions_are_cut_and_joined_exactly(spark, sets, shingles, monkeypatch):
    for name, value in (("OPEN", 5), ("REGION_SETS", sets), ("REGION_SHINGLES", shingles), ("PIVOTS", 4)):
        monkeypatch.setattr(J, name, value)
    monkeypatch.setattr(J.join_regions, "__defaults__", (sets, shingles))
    rows = chain()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(J.similar_documents(docs)) == brute(rows)


def members_of(texts):
    h, bounds = next((J.shingles(t) for _, _, t in J.chunks(pa.array(texts, pa.large_string()))))
    return [(i, i % 3 > 0, h[x:y]) for i, (x, y) in enumerate(zip(bounds, bounds[1:]))]


def cluster(n, size=60, seed=70):
    """Near copies, each with another word of its own."""
    base = words(size, seed).split()
    return [" ".join([*base[: k % size], f"x{k}", *base[k % size + 1 :]]) for k in range(n)]


def test_a_cluster_is_not_copied_to_cells(spark, monkeypatch):
    """A large region that cells can't part goes to pairs of blocks at once, not each of its cells."""
    texts, given, stored = cluster(60), [], J.stored
    monkeypatch.setattr(J, "stored", lambda df: (lambda out: given.append(out.count()) or out)(stored(df)))
    rows = [("r", i, True, s.tobytes()) for i, _, s in members_of(texts)]
    found = J.join_regions(spark.createDataFrame(rows, "region string, cid long, own boolean, item binary"), 30, 10**9)
    assert {tuple(r) for r in found.collect()} == set(zip(*J._exact([(i, True, s) for i, _, s in members_of(texts)])))
    assert max(given) == 60 * 4  # blocks of 15


@pytest.mark.parametrize("across", [False, True])
def test_sets_as_rows_of_a_matrix(across, monkeypatch):
    members = members_of(cluster(90) + [words(60, 500 + k) for k in range(20)] + ["", "one"])
    got = []
    for dense, rows, cells in ((0, 512, 1 << 22), (10**9, 512, 1 << 22), (10**9, 7, 1000)):
        for name, value in (("DENSE", dense), ("_ROWS", rows), ("_CELLS", cells)):
            monkeypatch.setattr(J, name, value)
        got.append(sorted(zip(*(x.tolist() for x in J._exact(members, across)))))
    sets = [set(s.tolist()) for *_, s in members]
    keep = lambda i, j: members[i][1] != members[j][1] if across else members[i][1] or members[j][1]
    similar = lambda x, y: x & y and 100 * len(x & y) >= 80 * len(x | y)
    assert got[0] == got[1] == got[2] == [(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if similar(sets[i], sets[j]) and keep(i, j)]
    assert len(got[0]) > 100


def test_clusters_that_a_passage_connects_are_parted():
    """Of several pivots in one cluster one is enough; so each cluster is a cell."""
    texts = [f"{t} {words(4, 1)}" for g in range(3) for t in cluster(40, 60, 80 + g)]
    members = [(i, True, s) for i, _, s in members_of(texts)]
    cells = [c for c in J._cells(members, J.CELL) if c]
    assert sorted(map(len, cells)) == [40, 40, 40]
    assert {p for c in cells for p in zip(*J._exact(c))} == set(zip(*J._exact(members)))


@pytest.mark.parametrize("sample,few", [(1, 1), (1, 10**9), (10**9, 1)])
def test_common_shingles_go_last(spark, sample, few, monkeypatch):
    """What a sample has in common only changes the order; sets that hold a common passage stay shut."""
    for name, value in (("SAMPLE", sample), ("FEW", few), ("OPEN", 4)):
        monkeypatch.setattr(J, name, value)
    opened, holding = [], J._holding
    monkeypatch.setattr(J, "_holding", lambda now, hashes: opened.append(1) or holding(now, hashes))
    rows = [(i, words(90, 100 + i, 10**6) + " " + words(12, 99)) for i in range(40)]
    rows += [(100 + i, t) for i, t in enumerate(cluster(3, 80))]
    assert result(J.similar_documents(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)
    assert bool(opened) == (sample > 1)


def test_components_of_many_links(spark, monkeypatch):
    """A cluster has as many links as pairs; a task sends one for each of its nodes."""
    given, stored = [], C.stored
    monkeypatch.setattr(C, "stored", lambda df: (lambda out: given.append(out.count()) or out)(stored(df)))
    edges = spark.range(200).crossJoin(spark.range(200).withColumnRenamed("id", "b")).selectExpr("id as a", "b").where("a < b").coalesce(2)
    assert {tuple(r) for r in C.components(edges).collect()} == {(i, 0) for i in range(200)}
    assert given[0] <= 400


def test_empty_table(spark):
    assert J.similar_documents(table(spark, [])).count() == 0


def test_hot_keys_are_joined_apart(spark):
    left = spark.range(5000).selectExpr("if(id % 3 = 0, 7, id) as k", "id as v")
    right = left.groupBy("k").count().withColumnRenamed("count", "held")
    got = J.join_hot(left, right, ["k"], "held", 10, share=10)
    assert got.count() == 5000
    J_share = J.join_hot(left, right.withColumn("held", right.held * 100), ["k"], "held", 10)
    assert sorted(map(tuple, J_share.select("k", "v").collect())) == sorted(map(tuple, left.collect()))


def test_one_of_each_component_stays(spark):
    docs = table(spark)
    kept = J.one_of_each(docs)
    assert kept.columns == docs.columns
    got = Counter((r.doc_id, r.text) for r in kept.collect())
    texts = {(r.doc_id, r.text) for r in docs.collect()}
    base = next(t for d, t in texts if d == 1)
    assert got[1, base] == 1 and not any(d in (2, 3, 13) for d, _ in got) and (None, base) not in got
    assert got[4, None] == got[5, ""] == got[6, " \t\n "] == got[7, "one"] == got[12, "the " * 3000] == 1
    plain = spark.createDataFrame([(1, base), (2, base), (3, "other words stand here now")], "doc_id long, text string")
    assert sorted(r.doc_id for r in J.one_of_each(plain).collect()) == [1, 3]


@pytest.mark.parametrize("exact,exchanged", [(J.EXACT_HASHES, False), (1, True)])
def test_no_text_is_exchanged_for_few_rows_to_drop(spark, exact, exchanged, monkeypatch):
    monkeypatch.setattr(J, "EXACT_HASHES", exact)
    texts = [words(60, 1), words(60, 1), words(60, 2), None, "", words(60, 2) + " tail", words(50, 3)]
    kept = J.one_of_each(spark.createDataFrame([("s", i, t) for i, t in enumerate(texts)], "source string, doc_id long, text string"))
    assert kept.columns == ["source", "doc_id", "text"]
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2, 3, 4, 6]
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert ("LeftAnti" not in plan) == exchanged


@pytest.mark.parametrize("local", [C.LOCAL_EDGES, 0])
def test_components(spark, local):
    edges = [(1, 2), (2, 3), (3, 1), (9, 8), (8, 7), (7, 6), (5, 5), (2, 1), (20, 30), (30, 40), (40, 50), (50, 20)] + [(100, i) for i in range(101, 130)]
    got = dict(map(tuple, C.components(spark.createDataFrame(edges, "a long, b long"), local).collect()))
    assert got == {**{i: 1 for i in (1, 2, 3)}, **{i: 6 for i in (6, 7, 8, 9)}, 5: 5, **{i: 20 for i in (20, 30, 40, 50)}, **{i: 100 for i in range(100, 130)}}
    assert C.components(spark.createDataFrame([], "a long, b long"), local).count() == 0
