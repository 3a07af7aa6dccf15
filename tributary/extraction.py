"""Queries that read lineage out of source text: each writes code or SQL for the rows of a table, and
the operators find out what it does. The SQL beside them states what must be found."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalars as S
from .operators import gate
from .plans.encodings import read
from .sinks import dot, openlineage, openmetadata
from .sources.scan import Options, scan
from .sources.sql_lineage import lineage_of
from .storage import scratch_uri
from .tables import Document

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

#: What stands for the row's key in texts and in what is expected of them.
KEY = "#"


def _query(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLE_SQL[name] = f, sql
        return f

    return add


def _written(text: str | Column, key: str = "n_nationkey") -> Column:
    return F.replace(F.lit(text) if isinstance(text, str) else text, F.lit(KEY), F.col(key).cast("string"))


def _document(spark: SparkSession, d: str, *texts: str, options: Options | None = None) -> Document:
    """The scan of one file for each text and nation."""
    n = read(spark, d, "nation").select("n_nationkey")
    files = n.select(F.explode(F.array(*[F.struct(F.concat(F.lit(f"m{i}_"), F.col("n_nationkey").cast("string"), F.lit(".py")).alias("path"), _written(t).alias("source")) for i, t in enumerate(texts)])).alias("f"))
    return scan(spark, files.select("f.path", "f.source", F.lit(None).cast("string").alias("error")), options or Options())


def _sources() -> Column:
    return F.array_join(F.transform("from_columns", lambda r: F.concat_ws(".", r["dataset"], r["column"])), ",").alias("sources")


def _mappings(doc: Document) -> DataFrame:
    edges = doc.edges.select("edge_id", "from", "to", "column_discovery")
    found = doc.column_edges.join(edges, "edge_id")
    confidence = F.round(F.coalesce(F.col("origin.confidence").cast("double"), F.lit(1.0)), 2).cast("double").alias("confidence")
    return found.select("from", "to", F.col("to_column.column").alias("target"), _sources(), F.col("transform_type").alias("kind"), F.col("origin.source").alias("source"), confidence, "column_discovery")


def _expected(frm: str, to: str, source: str, confidence: float, rows: list[tuple[str, str, str]], discovery: bool = False) -> str:
    """The rows of ``_mappings`` for every nation, from (target, sources, kind)."""
    values = ", ".join(f"('{t}', '{s}', '{k}')" for t, s, k in rows)
    k = f"'{KEY}', CAST(n_nationkey AS VARCHAR)"
    return f"""SELECT replace('{frm}', {k}) AS "from", replace('{to}', {k}) AS "to", replace(t, {k}) AS target, replace(s, {k}) AS sources, k AS kind, '{source}' AS source, CAST({confidence} AS DOUBLE) AS confidence, {str(discovery).lower()} AS column_discovery
FROM nation, (VALUES {values}) AS v(t, s, k)"""


def _task(sql: str, body: str = "") -> str:
    return f'from airflow import DAG\nQ = """{sql}"""\n{body}\nwith DAG(dag_id="d#") as dag:\n    t = PostgresOperator(task_id="load", sql=Q)\n'


# -- SQL text alone

_STATEMENTS = {
    "columns": "INSERT INTO out_# (id, total, label) SELECT k#, SUM(v), CAST(w AS STRING) FROM raw_# GROUP BY k#",
    "positional": "INSERT INTO out_# SELECT a AS X#, CAST(b AS INT), c FROM cat.db.raw_#",
    "overwrite": "INSERT OVERWRITE out_# SELECT COALESCE(a, b) AS a FROM raw_#",
    "bare": "SELECT *, a, s.b# AS d FROM raw_# s",
    "merge": "MERGE INTO out_# o USING raw_# r ON o.id = r.id WHEN MATCHED AND r.gone THEN DELETE WHEN MATCHED THEN UPDATE SET o.name = r.name#, age = r.age + 1 WHEN NOT MATCHED THEN INSERT (id, name) VALUES (r.id, upper(r.name#))",
    "wildcard": "INSERT INTO out_# (a, b, c) SELECT *, x FROM raw_#",
    "arity": "INSERT INTO out_# (a, b) SELECT x, y, z FROM raw_#",
    "union": "INSERT INTO out_# SELECT a# FROM raw_# UNION ALL SELECT z FROM other_#",
    "joined": "INSERT INTO out_# (v, w) SELECT x.v * y.f, CASE WHEN x.c > 0 THEN y.d# END FROM raw_# x JOIN side_# y ON x.k = y.k",
    "cte": "WITH c AS (SELECT a FROM raw_#) SELECT a AS n# FROM c",
    "conflict": "INSERT INTO out_# (a) SELECT b# FROM raw_# WHERE note = 'RETURNING' ON CONFLICT (a) DO NOTHING RETURNING a",
    "window": "SELECT SUM(m#) OVER (PARTITION BY p) AS w FROM raw_#",
    "ddl": "CREATE TABLE out_# (a INT)",
    "broken": "SELEC a FRM raw_#",
}


def _statements(spark: SparkSession, d: str) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(k).alias("form"), _written(t).alias("sql")) for k, t in _STATEMENTS.items()])
    texts = read(spark, d, "nation").select("n_nationkey", F.explode(rows).alias("x")).select("n_nationkey", "x.form", "x.sql")
    return texts.join(lineage_of(texts), "sql")


@_query(
    "sql_column_lineage",
    """SELECT n_nationkey, form, replace(t, '#', CAST(n_nationkey AS VARCHAR)) AS target, replace(s, '#', CAST(n_nationkey AS VARCHAR)) AS sources, kind FROM nation, (VALUES
('columns', 'id', 'k#', 'identity'), ('columns', 'total', 'v', 'aggregation'), ('columns', 'label', 'w', 'transformation'), ('positional', 'X#', 'a', 'identity'), ('positional', 'b', 'b', 'transformation'), ('positional', 'c', 'c', 'identity'),
('overwrite', 'a', 'a,b', 'transformation'), ('bare', 'a', 'a', 'identity'), ('bare', 'd', 'raw_#.b#', 'identity'), ('merge', 'name', 'name#', 'identity'), ('merge', 'age', 'age', 'transformation'), ('merge', 'id', 'id', 'identity'),
('union', 'a#', 'a#', 'identity'), ('joined', 'v', 'raw_#.v,side_#.f', 'transformation'), ('joined', 'w', 'raw_#.c,side_#.d#', 'transformation'), ('cte', 'n#', 'a', 'identity'), ('conflict', 'a', 'b#', 'identity'), ('window', 'w', 'm#', 'aggregation')) AS v(form, t, s, kind)""",
)
def sql_column_lineage(spark, d):
    m = _statements(spark, d).select("n_nationkey", "form", F.explode("mappings").alias("m"))
    # refs of an expression come as they are met; here by name
    refs = F.array_sort(F.transform("m.sources", lambda r: F.concat_ws(".", r["dataset"], r["column"])))
    return m.select("n_nationkey", "form", "m.target", F.array_join(refs, ",").alias("sources"), "m.kind")


@_query(
    "sql_tables",
    """SELECT n_nationkey, form, CASE WHEN form NOT IN ('bare', 'cte', 'window', 'ddl', 'broken') THEN 'out_' || n_nationkey END AS target,
CASE WHEN form IN ('ddl', 'broken') THEN '' WHEN form = 'joined' THEN 'raw_' || n_nationkey || ',side_' || n_nationkey ELSE 'raw_' || n_nationkey END AS tables
FROM nation, (VALUES ('columns'), ('positional'), ('overwrite'), ('bare'), ('merge'), ('wildcard'), ('arity'), ('union'), ('joined'), ('cte'), ('conflict'), ('window'), ('ddl'), ('broken')) AS v(form)""",
)
def sql_tables(spark, d):
    return _statements(spark, d).select("n_nationkey", "form", "target", F.array_join("tables", ",").alias("tables"))


@_query(
    "sql_guards",
    """SELECT n_nationkey, form, form = 'wildcard' AS wildcard, CASE WHEN form = 'arity' THEN '3,2' ELSE '' END AS arity FROM nation, (VALUES ('wildcard'), ('arity'), ('columns')) AS v(form)""",
)
def sql_guards(spark, d):
    found = _statements(spark, d).where("form in ('wildcard', 'arity', 'columns')")
    return found.select("n_nationkey", "form", "wildcard", F.coalesce(F.array_join(F.transform("arity", lambda x: x.cast("string")), ","), F.lit("")).alias("arity"))


# -- files

_SQL_TASK = [("id", "raw_#.k#", "identity"), ("total", "raw_#.v", "aggregation"), ("label", "raw_#.w", "transformation")]


@_query("scan_sql_task", _expected("raw_#", "out_#", "inferred_sql", 0.85, _SQL_TASK))
def scan_sql_task(spark, d):
    """A task found from its operator; tables and columns from its query."""
    return _mappings(_document(spark, d, _task(_STATEMENTS["columns"])))


@_query("scan_merge_task", _expected("raw_#", "out_#", "inferred_sql", 0.85, [("name", "raw_#.name#", "identity"), ("age", "raw_#.age", "transformation"), ("id", "raw_#.id", "identity")]))
def scan_merge_task(spark, d):
    return _mappings(_document(spark, d, _task(_STATEMENTS["merge"])))


_PANDAS = """
import pandas as pd
def work():
    src = pd.read_sql("SELECT * FROM raw_#", con=None)
    name = "total"
    out = src[["a#", "b"]]
    out[name] = src["x"] + src["y"]
    for c in ["p", "q"]:
        out[c] = src[c]
    out["full"] = src.apply(lambda r: r["first"] + r.last, axis=1)
    if len(src):
        out["k"] = src["k"]
    else:
        out["k"] = src["k"]
    out = out.rename(columns={"b": "b#"}).assign(late=src["d"] + src["e"])
    out.to_sql("out_#", con=None)
with DAG(dag_id="d#") as dag:
    t = PythonOperator(task_id="work", python_callable=work)
"""
_PANDAS_ROWS = [("a#", "raw_#.a#", "identity"), ("b", "raw_#.b", "identity"), ("total", "raw_#.x,raw_#.y", "transformation"), ("p", "raw_#.p", "identity"), ("q", "raw_#.q", "identity"), ("full", "raw_#.first,raw_#.last", "transformation"), ("k", "raw_#.k", "identity"), ("b#", "raw_#.b", "identity"), ("late", "raw_#.d,raw_#.e", "transformation")]


@_query("scan_pandas_flow", _expected("raw_#", "out_#", "inferred_code", 0.7, _PANDAS_ROWS))
def scan_pandas_flow(spark, d):
    return _mappings(_document(spark, d, _PANDAS))


_SPARK = """
def work(spark):
    df = spark.read.table("raw_#")
    out = df.filter("x > 0").withColumn("usd", F.col("amount#") * 2).withColumnRenamed("id", "key#")
    out.write.mode("append").saveAsTable("out_#")
with DAG(dag_id="d#") as dag:
    t = PythonOperator(task_id="work", python_callable=work)
"""


@_query("scan_spark_flow", _expected("raw_#", "out_#", "inferred_code", 0.7, [("usd", "raw_#.amount#", "transformation"), ("key#", "raw_#.id", "identity")]))
def scan_spark_flow(spark, d):
    return _mappings(_document(spark, d, _SPARK))


_AGGREGATE = """
def work(spark):
    df = spark.read.table("raw_#")
    out = df.groupBy("r#").agg(F.sum(F.col("v")).alias("t"), F.max("w").alias("top#"))
    out.write.saveAsTable("out_#")
with DAG(dag_id="d#") as dag:
    t = PythonOperator(task_id="work", python_callable=work)
"""


@_query("scan_aggregates", _expected("raw_#", "out_#", "inferred_code", 0.7, [("r#", "raw_#.r#", "identity"), ("t", "raw_#.v", "aggregation"), ("top#", "raw_#.w", "aggregation")]))
def scan_aggregates(spark, d):
    return _mappings(_document(spark, d, _AGGREGATE))


_SELECTS = """
def work(spark):
    df = spark.read.table("raw_#")
    out = df.selectExpr("a# * 1.08 AS x", "b").select("x", F.col("b").alias("c#"))
    out.write.saveAsTable("out_#")
with DAG(dag_id="d#") as dag:
    t = PythonOperator(task_id="work", python_callable=work)
"""

_DECLARED = """
import tool as tw
@tw.task(dag="d#", inputs=["s.d.p.a#", "s.d.p.b#"], outputs=["s.d.p.c#"], column_map=[(["a#.x", "b#.y"], "z", "x + y"), ("q", "r#"), ("v", "n", "count of v")], copy=["k"])
def t(): pass
"""


@_query(
    "scan_declared_task",
    _expected("s.d.p.a#", "s.d.p.c#", "declared", 1.0, [("z", "s.d.p.a#.x,s.d.p.b#.y", "transformation"), ("r#", "s.d.p.a#.q", "identity"), ("n", "s.d.p.a#.v", "aggregation"), ("k", "s.d.p.a#.k", "identity")])
    + " UNION ALL " + _expected("s.d.p.b#", "s.d.p.c#", "declared", 1.0, [("z", "s.d.p.a#.x,s.d.p.b#.y", "transformation")]),
)
def scan_declared_task(spark, d):
    return _mappings(_document(spark, d, _DECLARED))


_NAMES, _USER = 'RAW = "s.d.p.raw#"\nALIAS = RAW\n', '\nfrom m0_# import ALIAS as SRC\nimport m0_# as names\n@lineage(inputs=[SRC, names.RAW], outputs=["s.d.p.out#"])\ndef good(): pass\n@lineage(inputs=["s.d.p.me#"], outputs=["s.d.p.me#"])\ndef loop(): pass\n'


@_query(
    "scan_constants",
    """SELECT 's.d.p.' || f || n_nationkey AS "from", 's.d.p.' || t || n_nationkey AS "to", 'declared' AS source, job FROM nation, (VALUES ('raw', 'out', 'good'), ('me', 'me', 'loop')) AS v(f, t, job)""",
)
def scan_constants(spark, d):
    """Names of another module's constants, by both kinds of import; a declared self-loop stays."""
    doc = _document(spark, d, _NAMES, _USER)
    return doc.edges.select("from", "to", F.col("origin.source").alias("source"), F.substring_index("job", ".", -1).alias("job")).distinct()


_LONELY = '\ndef lonely(spark):\n    df = spark.read.table("p#")\n    out = df.withColumnRenamed("i", "j#")\n    out.write.saveAsTable("q#")\n'


@_query("scan_column_discovery", _expected("p#", "q#", "inferred_code", 0.7, [("j#", "p#.i", "identity")], True))
def scan_column_discovery(spark, d):
    """A function that no task calls."""
    return _mappings(_document(spark, d, _LONELY))


_CALLER = """
import tool as tw
@tw.task(inputs=["s.d.p.a#"], outputs=["s.d.p.b#"])
def one():
    helper()
@tw.task(inputs=["s.d.p.z#"], outputs=["s.d.p.a#"], copy=["x"])
def two(): pass
@tw.task(inputs=["s.d.p.b#"], outputs=["s.d.p.c#"], copy=["x"])
def three(): pass
def helper():
    df = spark.read.table("a#")
    out = df.withColumn("w#", F.upper(df.v))
    out.write.saveAsTable("b#")
"""


@_query(
    "scan_helpers_and_gaps",
    _expected("s.d.p.a#", "s.d.p.b#", "inferred_code", 0.7, [("w#", "s.d.p.a#.v", "transformation")]) + " UNION ALL " + _expected("s.d.p.a#", "s.d.p.b#", "inferred_code", 0.4, [("x", "s.d.p.a#.x", "identity")])
    + " UNION ALL " + _expected("s.d.p.z#", "s.d.p.a#", "declared", 1.0, [("x", "s.d.p.z#.x", "identity")]) + " UNION ALL " + _expected("s.d.p.b#", "s.d.p.c#", "declared", 1.0, [("x", "s.d.p.b#.x", "identity")]),
)
def scan_helpers_and_gaps(spark, d):
    """Columns of a helper go to its caller's edge; equal names fill the gap between two schemas."""
    return _mappings(_document(spark, d, _CALLER))


_VIEW = """
TARGET = "gold#"
def work(spark):
    df = spark.read.table("bronze#")
    df.createOrReplaceTempView("v")
    spark.sql(f"INSERT INTO {TARGET} SELECT CAST(amount# AS INT) AS amount FROM v")
with DAG(dag_id="d#") as dag:
    t = PythonOperator(task_id="work", python_callable=work)
"""


@_query("scan_temp_view", _expected("bronze#", "gold#", "inferred_code", 0.7, [("amount", "bronze#.amount#", "transformation")]))
def scan_temp_view(spark, d):
    return _mappings(_document(spark, d, _VIEW))


_FAULTS = {
    "parse": "def (:\n# #",
    "io": 'import tool as tw\n@tw.task(dag="d#", inputs=None, outputs=["s.d.p.c#"])\ndef t(): pass\n',
    "star": 'import tool as tw\n@tw.sql(dag="d#", inputs=["s.d.p.a#"], outputs=["s.d.p.b#"], sql="INSERT INTO b# (x, y) SELECT * FROM a#")\ndef t(): pass\n',
    "arity": 'import tool as tw\n@tw.sql(dag="d#", inputs=["s.d.p.a#"], outputs=["s.d.p.b#"], sql="INSERT INTO b# (x, y) SELECT p FROM a#")\ndef t(): pass\n',
    "name": '@lineage(inputs=["s.d.p.a#"], outputs=[f"s.d.{x}.b#"])\ndef t(): pass\n',
    "engine": 'import tool as tw\n@tw.task(dag="d#", engine="pd", inputs=["s.d.p.a#"], outputs=["s.d.p.b#"], sql="SELECT 1")\ndef t(): pass\n',
}


@_query(
    "scan_diagnostics",
    """SELECT n_nationkey, fault, code, level FROM nation, (VALUES ('parse', 'E_PARSE', 'error'), ('read', 'E_READ', 'error'), ('io', 'E_MISSING_IO', 'error'), ('star', 'W_SQL_WILDCARD', 'warn'), ('arity', 'W_SQL_ARITY', 'warn'),
('name', 'W_NON_LITERAL', 'warn'), ('engine', 'W_SQL_NOT_PARSED', 'warn')) AS v(fault, code, level)""",
)
def scan_diagnostics(spark, d):
    """One faulty file of each kind for every nation; what later checks of the whole add isn't asked for."""
    rows = F.array(*[F.struct(F.lit(k).alias("fault"), _written(t).alias("source"), F.lit(None).cast("string").alias("error")) for k, t in _FAULTS.items()], F.struct(F.lit("read").alias("fault"), F.lit("").alias("source"), F.lit("not UTF-8").alias("error")))
    n = read(spark, d, "nation").select("n_nationkey", F.explode(rows).alias("f"))
    files = n.select(F.concat_ws("_", "f.fault", F.col("n_nationkey").cast("string")).alias("stem"), "f.source", "f.error").select(F.concat("stem", F.lit(".py")).alias("path"), "source", "error")
    found = scan(spark, files, Options(), finalize=False).diagnostics
    stem = F.regexp_extract("location.file", r"([a-z]+_\d+)\.py$", 1)
    return found.select(F.substring_index(stem, "_", -1).cast("int").alias("n_nationkey"), F.substring_index(stem, "_", 1).alias("fault"), "code", "level")


_GOLDEN = '''
LOAD = """INSERT INTO clean# (visit_id, visitor, spent, unit, seen_at)
SELECT raw_id::bigint, who, spent::numeric(10,2), unit, seen::timestamp FROM (SELECT *, row_number() OVER (PARTITION BY raw_id ORDER BY loaded) AS n FROM raw#) x WHERE n = 1 ON CONFLICT (visit_id) DO NOTHING;"""
DAILY = "INSERT INTO daily# (seen_on, visits, visitors, total, mean) SELECT seen_on, COUNT(*), COUNT(DISTINCT visitor), SUM(spent_usd), ROUND(AVG(spent_usd), 2) FROM rich# WHERE ok GROUP BY seen_on"
def enrich():
    import pandas as pd
    clean = pd.read_sql("SELECT * FROM clean#", con=None)
    rich = pd.DataFrame()
    for c in ["visit_id", "visitor", "spent", "unit"]:
        rich[c] = clean[c]
    rich["spent_usd"] = clean["spent"] * clean["unit"].map({}).fillna(1.0)
    rich["seen_on"] = clean["seen_at"]
    rich["ok"] = clean["spent"] > 0
    rich.to_sql("rich#", con=None)
with DAG(dag_id="visits#") as dag:
    a = PostgresOperator(task_id="load", sql=LOAD)
    b = PythonOperator(task_id="enrich", python_callable=enrich)
    c = PostgresOperator(task_id="daily", sql=DAILY)
'''
_PIPELINE = " UNION ALL ".join([
    _expected("raw#", "clean#", "inferred_sql", 0.85, [("visit_id", "raw#.raw_id", "transformation"), ("visitor", "raw#.who", "identity"), ("spent", "raw#.spent", "transformation"), ("unit", "raw#.unit", "identity"), ("seen_at", "raw#.seen", "transformation")]),
    _expected("clean#", "rich#", "inferred_code", 0.7, [*((c, f"clean#.{c}", "identity") for c in ("visit_id", "visitor", "spent", "unit")), ("spent_usd", "clean#.spent,clean#.unit", "transformation"), ("seen_on", "clean#.seen_at", "identity"), ("ok", "clean#.spent", "transformation")]),
    _expected("rich#", "daily#", "inferred_sql", 0.85, [("seen_on", "rich#.seen_on", "identity"), ("visits", "", "aggregation"), ("visitors", "rich#.visitor", "aggregation"), ("total", "rich#.spent_usd", "aggregation"), ("mean", "rich#.spent_usd", "transformation")]),
])


@_query("scan_pipeline", _PIPELINE)
def scan_pipeline(spark, d):
    """Three tasks from landing to daily figures: 17 mappings a nation."""
    return _mappings(_document(spark, d, _GOLDEN))


@_query("scan_pipeline_counts", "SELECT 3 * count(*) AS jobs, 4 * count(*) AS datasets, 3 * count(*) AS edges, 17 * count(*) AS mappings, 0 AS diagnostics FROM nation")
def scan_pipeline_counts(spark, d):
    doc = _document(spark, d, _GOLDEN, options=Options("ex", "Svc", "db", "public"))
    counts = [getattr(doc, k).agg(F.count("*").alias(n)) for k, n in (("jobs", "jobs"), ("datasets", "datasets"), ("edges", "edges"), ("column_edges", "mappings"), ("diagnostics", "diagnostics"))]
    out = counts[0]
    for c in counts[1:]:
        out = out.join(F.broadcast(c))  # one row each
    return out.withColumn("diagnostics", F.col("diagnostics").cast("int"))


@_query(
    "scan_gate",
    "SELECT 'd' || n_nationkey AS dag, 2 AS tasks_total, 1 AS tasks_with_lineage, 1 AS tasks_annotated, 1 AS edges_total, 0 AS high_confidence_edges, 0.5::DOUBLE AS task_coverage, 0.5::DOUBLE AS annotation_coverage, 0.0::DOUBLE AS high_confidence_fraction FROM nation",
)
def scan_gate(spark, d):
    """A found task with an edge and a declared one without, in one DAG."""
    doc = _document(spark, d, _task(_STATEMENTS["columns"]), _FAULTS["io"])
    jobs = doc.jobs.select("id", "dag", F.col("origin.source").alias("source"))
    edges = doc.edges.select("edge_id", "job", F.col("origin.source").alias("source"), "column_discovery")
    m = gate.metrics_by_dag(jobs, edges, doc.column_edges.select("edge_id"))
    return m.select("dag", *[F.col(c).cast("int").alias(c) for c in ("tasks_total", "tasks_with_lineage", "tasks_annotated", "edges_total", "high_confidence_edges")], "task_coverage", "annotation_coverage", "high_confidence_fraction")


@_query("scan_select_expressions", _expected("raw_#", "out_#", "inferred_code", 0.7, [("x", "raw_#.a#", "transformation"), ("b", "raw_#.b", "identity"), ("c#", "raw_#.b", "identity")]))
def scan_select_expressions(spark, d):
    return _mappings(_document(spark, d, _SELECTS))


# -- exports of what was found


@_query(
    "export_dot",
    """SELECT '  "' || n || '" [label="' || n || '", tooltip="' || n || '", fillcolor="#ffffff"];' AS line FROM (SELECT unnest(['raw_' || n_nationkey, 'out_' || n_nationkey]) AS n FROM nation)
UNION ALL SELECT '  "raw_' || n_nationkey || '" -> "out_' || n_nationkey || '" [label="sql", style=dashed, color=orange];' FROM nation""",
)
def export_dot(spark, d):
    nodes, edges = dot.lines(_document(spark, d, _task(_STATEMENTS["columns"])))
    return nodes.select("line").union(edges.select("line"))


@_query(
    "export_openlineage",
    f"""SELECT 'COMPLETE' AS type, 'd' || n_nationkey || '.load' AS job, 'raw_' || n_nationkey AS input, 'out_' || n_nationkey AS output, 'v' AS total_of, 'AGGREGATION' AS total_by, 'k' || n_nationkey AS id_of, 'IDENTITY' AS id_by, '{S.INFERRED_NOTE}' AS note FROM nation""",
)
def export_openlineage(spark, d):
    e = openlineage.events(_document(spark, d, _task(_STATEMENTS["columns"])))
    field = "$.outputs[0].facets.columnLineage.fields.{}.inputFields[0].{}"
    paths = {"type": "$.eventType", "job": "$.job.name", "input": "$.inputs[0].name", "output": "$.outputs[0].name", "note": "$.job.facets.documentation.description"}
    paths |= {f"{f}_{k}": field.format(f, p) for f in ("total", "id") for k, p in (("of", "field"), ("by", "transformations[0].subtype"))}
    return e.select(*[F.get_json_object("event", p).alias(k) for k, p in paths.items()])


@_query(
    "export_openmetadata",
    """SELECT 's.d.p.' || f || n_nationkey AS "from", 's.d.p.c' || n_nationkey AS "to", 's.d.p.c' || n_nationkey || '.z' AS first_column, CAST(NULL AS VARCHAR) AS skip FROM nation, (VALUES ('a'), ('b')) AS v(f)
UNION ALL SELECT 'raw_' || n_nationkey, 'out_' || n_nationkey, NULL, 'no four-part name' FROM nation""",
)
def export_openmetadata(spark, d):
    b = openmetadata.bodies(_document(spark, d, _DECLARED, _task(_STATEMENTS["columns"])))
    return b.select("from", "to", F.get_json_object("body", "$.edge.lineageDetails.columnsLineage[0].toColumn").alias("first_column"), "skip")


@_query("document_round_trip", _PIPELINE)
def document_round_trip(spark, d):
    """The pipeline's document as JSON, read again."""
    doc, uri = _document(spark, d, _GOLDEN), scratch_uri(spark) + "/document"
    spark.createDataFrame([(json.dumps(doc.as_dict()),)], "value string").coalesce(1).write.text(uri)
    return _mappings(Document.read(spark, uri))
