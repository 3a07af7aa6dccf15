"""Steps that the lineage queries share: how often rows are exchanged, and that both forms of mappings agree."""

import duckdb
import pytest
from pyspark.sql import functions as F
from tributary import queries as Q
from tributary.functions import scalars as S
from tributary.operators import catalog, rules
from tributary.storage import spread

from .conftest import DATA

REF = "struct<dataset:string,column:string>"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def document(spark):
    e = spark.createDataFrame([(1, "a", "b", "declared", False), (2, "a", "b", "inferred_sql", False), (3, "a", "c", "declared", False), (4, "c", "d", "declared", True)], "edge_id long, from string, to string, source string, column_discovery boolean")
    e = e.select("*", S.origin(F.col("source"), None).alias("origin"), F.concat(F.lit("j"), "edge_id").alias("job"))
    maps = spark.createDataFrame(
        [(1, 0, [("a", "x"), ("z", "y")], ("b", "x"), "declared"), (1, 1, None, ("b", "n"), "inferred_code"), (2, 0, [("a", None)], ("q", "x"), "declared"), (4, 0, [("c", "u")], ("d", "v"), "declared")], f"edge_id long, ordinal int, from_columns array<{REF}>, to_column {REF}, source string"
    )
    maps = maps.select("edge_id", "ordinal", "from_columns", "to_column", S.origin(F.col("source"), None).alias("origin"))
    held = maps.groupBy("edge_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "from_columns", "to_column", "origin"))).alias("mappings"))
    return e, maps, e.join(held, "edge_id", "left")


def test_mappings_in_their_edges_give_the_same(spark, document):
    e, maps, held = document
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(catalog.with_inferred(e, maps).select("edge_id", "has_inferred")) == rows(catalog.with_inferred(held).select("edge_id", "has_inferred"))
    jobs = e.select(F.col("job").alias("id"), F.struct(F.lit("f").alias("file")).alias("location"))
    assert rows(catalog.missing_lineage(e, maps, jobs)) == rows(catalog.missing_lineage(held, None, jobs))
    assert [r.edge_id for r in catalog.missing_lineage(held, None, jobs).collect()] == [3]
    assert rows(catalog.observed_columns(e, maps)) == rows(catalog.observed_columns(held, None))
    want = rows(rules.misplaced_columns(e, maps))
    assert rows(rules.misplaced_columns(held)) == want and len(want) == 2


@pytest.mark.parametrize("name", ["openmetadata_columns", "validate_column_endpoint", "dot_edges", "edge_has_inferred", "has_errors", "missing_lineage", "openlineage_fields"])
def test_lines_are_exchanged_once_and_not_sorted_by_texts(spark, name):
    plan = plan_of(Q.QUERIES[name](spark, DATA))
    assert "hashpartitioning(edge_id" not in plan and "hashpartitioning(l_orderkey#" in plan
    assert all("hashpartitioning(l_orderkey#" not in x or "l_linenumber" not in x for x in plan.splitlines())


def test_known_names_meet_counts(spark):
    """Each use of a name is counted before the join, and still told as often."""
    e = spark.createDataFrame([("a", "x")] * 5 + [("a", "b"), (None, "b")], "from string, to string")
    known = spark.createDataFrame([("a",)], "name string")
    assert sorted(map(str, rules.count_unknown_endpoints(e, known).select("subject", "times").collect())) == sorted(["Row(subject=None, times=1)", "Row(subject='b', times=2)", "Row(subject='x', times=5)"])
    assert rules.unknown_endpoints(e, known).count() == 8
    maps = spark.createDataFrame([([("a", "q"), ("a", "x")], ("a", "q"))] * 3, f"from_columns array<{REF}>, to_column {REF}")
    datasets = spark.createDataFrame([("a", [("x",)])], "name string, schema array<struct<name:string>>")
    assert [tuple(r) for r in rules.count_unknown_columns(maps, datasets).collect()] == [("warn", "W_UNKNOWN_COLUMN", "a.q", 6)]
    assert rules.unknown_columns(maps, datasets).count() == 6


@pytest.mark.parametrize("name", ["validate_unknown_column", "edge_has_inferred", "openmetadata_columns", "missing_lineage", "derive_edges"])
def test_lines_without_order_repeated_lines_and_odd_flags(spark, tmp_path, name):
    lines = [(1, 1, 1, 1, "R", "O"), (1, 1, 1, 1, "S", "F"), (1, 2, 2, 1, "N", "F"), (1, 2, 2, 1, "A", "B"), (1, 3, 3, 2, "Z", "G"), (2, 1, 2, 2, "Q", "P"), (9, 1, 1, 2, "N", "F"), (2, 2, 4, 1, "R", "A")]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_returnflag string, l_linestatus string").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, "F", "1"), (2, "O", "2"), (3, "P", "2")], "o_orderkey long, o_orderstatus string, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(1, 5).withColumnRenamed("id", "p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    spark.range(1, 3).withColumnRenamed("id", "s_suppkey").write.parquet(f"{tmp_path}/supplier.parquet")
    c = duckdb.connect()
    for t in ("lineitem", "orders", "part", "supplier"):
        c.execute(f"create view {t} as from '{tmp_path}/{t}.parquet/*.parquet'")
    df = Q.QUERIES[name](spark, str(tmp_path))
    o = c.execute(Q.ORACLE_SQL[name])
    at = [[x[0] for x in o.description].index(n) for n in df.columns]
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(str(tuple(r[k] for k in at)) for r in o.fetchall())


def test_discovery_and_jobs_have_small_tasks(spark):
    many = spark.range(1 << 20).select((F.col("id") % 7).alias("k"), "id")
    assert spread(many, "k", mb=1).rdd.getNumPartitions() >= 8 > 4 == spread(spark.range(9), "id").rdd.getNumPartitions()
    plan = plan_of(Q.QUERIES["discovery_edges"](spark, DATA))
    assert plan.count("Exchange") == 1 and "REPARTITION_BY_NUM" in plan
    plan = plan_of(Q.QUERIES["derive_edges"](spark, DATA))
    assert "REPARTITION_BY_NUM" in plan and all("collect_set" not in x or "partial_" not in x or "part." not in x for x in plan.splitlines())
