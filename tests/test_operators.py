import random
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tributary.functions import scalars as S
from tributary.operators import catalog, gate, graph, rules


def fnv(data, h):
    for b in data:
        h = (h ^ b) * 0x100000001B3 % 2**64
    return h


def test_run_id_is_the_hash(spark):
    texts = ["", "o1", "dag.task", "é中😀", "x" * 300]
    got = {r.t: r.i for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", S.run_id(F.col("t")).alias("i")).collect()}
    for t in texts:
        a = fnv(t.encode(), 0xCBF29CE484222325)
        h = f"{a:016x}{fnv(t.encode(), a):016x}"
        assert got[t] == "-".join((h[:8], h[8:12], h[12:16], h[16:20], h[20:]))


edges_ = st.lists(st.tuples(st.sampled_from("abcdefgh"), st.sampled_from("abcdefgh")), max_size=14)


@given(edges_)
@settings(max_examples=60, deadline=None)
def test_ranks_are_a_priority_order(pairs):
    rank = graph.ranks(pairs)
    assert set(rank) == {n for p in pairs for n in p}
    placed = len(set(rank.values()))
    for a, b in pairs:
        if a != b and list(rank.values()).count(rank[b]) == 1:
            assert rank[a] <= rank[b] or rank[a] == placed
    assert graph.ranks(list(reversed(pairs))) == rank


def test_ranks_prefer_small_names_and_put_cycles_last():
    assert graph.ranks([("b", "d"), ("a", "d"), ("c", "a")]) == {"b": 0, "c": 1, "a": 2, "d": 3}
    r = graph.ranks([("x", "y"), ("y", "x"), ("a", "x"), ("s", "s")])
    assert r["a"] == 0 and r["s"] == r["x"] == r["y"] == 1  # a loop is a cycle


def test_reachability_and_levels_on_a_graph_with_a_cycle(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "b"), ("c", "d"), ("e", "d")]
    e = spark.createDataFrame(pairs, "from string, to string")
    reach = defaultdict(set)
    for s in "abcde":
        todo = [s]
        while todo:
            for x, y in pairs:
                if x == todo[0] and y not in reach[s]:
                    reach[s].add(y)
                    todo.append(y)
            todo.pop(0)
    got = defaultdict(set)
    for r in graph.reachable(e).collect():
        got[r.source].add(r.node)
    assert got == {k: v for k, v in reach.items() if v}
    assert {r.node: r.level for r in graph.levels(e).collect()} == {"a": 0, "e": 0, "b": None, "c": None, "d": None}


def jobs(spark, rows):
    return spark.createDataFrame(rows, "seq long, id string, inputs array<string>, outputs array<string>, source string").withColumn("origin", S.origin(F.col("source"), None))


def test_derived_edges_are_idempotent(spark):
    j = jobs(spark, [(1, "x", ["a", "b"], ["c"], "declared"), (2, "y", ["a"], ["c", "a"], "inferred_sql"), (3, "z", ["s"], ["s"], "declared"), (4, "n", [], ["q"], "declared")])
    none = spark.createDataFrame([], "from string, to string")
    first = catalog.derive_edges(j, none)
    assert sorted(tuple(r) for r in first.select("from", "to", "job").collect()) == [("a", "c", "x"), ("b", "c", "x"), ("s", "s", "z")]
    assert catalog.derive_edges(j, first).count() == 0


def test_gate_of_an_empty_document(spark):
    j = spark.createDataFrame([], "id string, dag string, source string")
    e = spark.createDataFrame([], "edge_id long, job string, source string, column_discovery boolean")
    r = gate.metrics(j, e, spark.createDataFrame([], "edge_id long")).first()
    assert (r.task_coverage, r.annotation_coverage, r.high_confidence_fraction) == (0.0, 0.0, 1.0)


def test_edges_of_unknown_jobs_count_for_default(spark):
    j = spark.createDataFrame([("d.t", "d", "declared")], "id string, dag string, source string")
    e = spark.createDataFrame([(1, None, "declared", False), (2, "gone", "inferred_sql", True)], "edge_id long, job string, source string, column_discovery boolean")
    got = {r.dag: r for r in gate.metrics_by_dag(j, e, spark.createDataFrame([(1,), (1,), (1,), (2,)], "edge_id long")).collect()}
    # mappings of discovery edges alone count
    assert got["default"].edges_total == 1 and got["default"].column_edges == 1 and got["default"].tasks_total == 0 and got["default"].column_mappings == 1
    same = gate.metrics_by_dag(j, e.withColumn("n_mappings", F.when(F.col("edge_id") == 1, 3).otherwise(1))).collect()
    assert {r.dag: r for r in same} == got
    assert got["d"].task_coverage == 0.0 and got["d"].high_confidence_fraction == 1.0


def test_declared_duplicates_stay_and_block_the_rest(spark):
    rows = [("e", "t", "inferred_code", 1), ("e", "t", "declared", 2), ("e", "t", "declared", 3), ("e", "u", "inferred_code", 1), ("e", "u", "inferred_sql", 5), ("e", "u", "inferred_sql", 4)]
    got = catalog.by_precedence(spark.createDataFrame(rows, "edge string, target string, source string, seq int")).collect()
    assert sorted((r.target, r.source, r.seq) for r in got) == [("t", "declared", 2), ("t", "declared", 3), ("u", "inferred_sql", 4)]


def test_scalars(spark):
    row = spark.range(1).select(
        S.fqn_parts(F.lit("Test Svc.d.s.t"))["service"].alias("svc"), S.fqn_parts(F.lit("a.b.c")).alias("three"), S.fqn_parts(F.lit("a..b.c")).alias("gap"), S.percent_encode(F.lit("a b*~+é/")).alias("pct"), S.dot_escape(F.lit('a"b\\c\nd')).alias("dot"),
        S.annotate(F.lit(""), F.lit("inferred_sql")).alias("tag"), S.annotate(F.lit("f"), F.lit("declared")).alias("plain"), S.display_function(F.lit(None).cast("string"), F.lit("inferred_code")).alias("bare"), S.engine_of(F.lit(" PySpark ")).alias("eng"),
        S.shorten(F.lit("x  y\n" + "z" * 90)).alias("short"), S.classify_label(F.lit("DISCOUNT"), F.lit(1)).alias("loose"), S.classify_label(F.lit("DISCOUNT"), F.lit(1), True).alias("strict"), S.rfc3339(F.lit(0)).alias("t0"), S.ratio(F.lit(1), F.lit(0), 0.5).alias("r"),
    ).first()
    assert row.svc == "Test Svc" and row.three is None and row.gap is None and row.pct == "a%20b%2A~%2B%C3%A9%2F" and row.dot == 'a\\"b\\\\c\\nd'
    assert row.tag == "(inferred from SQL)" and row.plain == "f" and row.bare == "(inferred from code)" and row.eng == "spark"
    assert len(row.short) == 78 and row.short.endswith("…") and row.loose == "aggregation" and row.strict == "transformation" and row.t0 == "1970-01-01T00:00:00Z" and row.r == 0.5


def test_no_python_in_relational_plans(spark, sf_dir):
    from tributary import queries as Q

    for name in ("gate_metrics_by_dag", "backfill_schema", "gapfill_identity", "validate_unknown_column", "distribute_column_edges", "upsert_datasets", "openlineage_fields"):
        plan = Q.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan, name


def test_validation_finds_each_defect(spark):
    ref = "struct<dataset:string,column:string>"
    datasets = spark.createDataFrame([(1, "a", [("x",)]), (2, "b", [("y",)]), (3, "b", [])], "seq long, name string, schema array<struct<name:string>>")
    e = spark.createDataFrame([(1, "a", "b"), (2, "a", "zz")], "edge_id long, from string, to string")
    maps = spark.createDataFrame([(1, [("a", "x")], ("b", "y")), (1, [("c", "x")], ("b", "q"))], f"edge_id long, from_columns array<{ref}>, to_column {ref}")
    j = spark.createDataFrame([(["a", "n"], ["b"])], "inputs array<string>, outputs array<string>")
    got = sorted((r.code, r.subject) for r in rules.validate(datasets, j, e, maps).collect())
    assert got == [("E_DUP_DATASET", "b"), ("E_UNKNOWN_DATASET", "zz"), ("W_COLUMN_ENDPOINT", "c.x"), ("W_JOB_DATASET", "n"), ("W_UNKNOWN_COLUMN", "b.q")]


@pytest.mark.parametrize("cyclic", [False, True])
def test_exact_order_beyond_the_drivers_memory(spark, monkeypatch, cyclic):
    monkeypatch.setattr(graph, "RANK_ROWS", 7)
    r = random.Random(5)
    pairs = [tuple(f"n{k}é" if k % 5 else f"N{k}" for k in sorted(r.sample(range(40), 2))) for _ in range(90)] + [("N0", "N0")]
    pairs += [("n39é", "n38é"), ("n38é", "n39é"), ("n39é", "z")] if cyclic else []
    want = graph.ranks(pairs)
    edges = spark.createDataFrame(pairs, "from string, to string")
    for limit in (0, 1000):
        got = graph.topological(edges, limit).collect()
        assert len(got) == len(pairs)
        assert all((x["rank"].rf, x["rank"].rt) == (want[x["from"]], want[x["to"]]) for x in got)


def test_levels_and_self_loops(spark):
    """A node that leads to itself is a cycle: it and what is behind it have no level and the last rank."""
    pairs = [("a", "a"), ("a", "b"), ("b", "c"), ("x", "y"), ("x", "z"), ("y", "z"), ("z", "c")]
    edges = spark.createDataFrame([*pairs, ("x", "y"), (None, "q")], "from string, to string")
    assert dict(map(tuple, graph.levels(edges).collect())) == {"a": None, "b": None, "c": None, "x": 0, "y": 1, "z": 2}
    assert graph.ranks(pairs) == {"x": 0, "y": 1, "z": 2, "a": 3, "b": 3, "c": 3}
    for limit in (0, 100):
        got = {(r["from"], r["to"]): (r["rank"].rf, r["rank"].rt) for r in graph.topological(spark.createDataFrame(pairs, "from string, to string"), limit).collect()}
        assert got["a", "a"] == (3, 3) and got["a", "b"] == (3, 3) and got["x", "y"] == (0, 1) and got["z", "c"] == (2, 3)


def test_edge_ids_are_unique_and_ordered(spark):
    from tributary.plans.encodings import _edge_id

    keys = [(1, 1, 150000, 7), (1, 2, 50000, 7), (1_200_000_000, 7, 20_000_000_000, 1_000_000_000), (600_000_000_000, 7, 20_000_000_000, 999_999_999), (1, 1, 1, 10_000), (1, 1, 2, 0)]
    df = spark.createDataFrame(keys, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long").select("*", _edge_id().alias("id"))
    rows = df.orderBy("id").collect()
    assert len({r.id for r in rows}) == len(keys) and [tuple(r)[:4] for r in rows] == sorted(keys)


def test_exact_order_gets_edges_in_blocks(spark, monkeypatch):
    """No row per edge reaches the driver: a node's many edges come in few blocks, of several ranges."""
    monkeypatch.setattr(graph, "SENT_EDGES", 1000)
    pairs = [("hub", f"t{k:04}") for k in range(3000)] + [(f"t{k:04}", "end") for k in range(3000)] + [("a", "hub"), (None, "x")]
    blocks = graph._packed(spark.range(6001).selectExpr("cast(id % 2 as bigint) a", "id b"), 6001, "int32").collect()
    assert 7 <= len(blocks) <= 14 and sum(len(x.b) for x in blocks) == 4 * 6001
    got = {(x["from"], x["to"]): (x["rank"].rf, x["rank"].rt) for x in graph.topological(spark.createDataFrame(pairs, "from string, to string"), 0).collect()}
    want = graph.ranks(pairs[:-1])
    assert got == {(a, b): (want[a], want[b]) for a, b in pairs[:-1]}


def test_stamps_of_far_years(spark):
    want = {0: "1970-01-01T00:00:00Z", -1: "1969-12-31T23:59:59Z", 951782399: "2000-02-28T23:59:59Z", 253402300799: "9999-12-31T23:59:59Z", 253402300800: "10000-01-01T00:00:00Z", 4668894000000: "149921-05-13T00:00:00Z", -62135596801: "0000-12-31T23:59:59Z", -62200000000: "-2-12-17T14:13:20Z"}
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for z in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", z)
            rows = spark.createDataFrame([(k,) for k in [*want, None]], "k long").select("k", S.rfc3339(F.col("k")).alias("t")).collect()
            assert {r.k: r.t for r in rows} == want | {None: None}
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
