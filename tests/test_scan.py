import json
import os
import subprocess

import pytest
from tributary import cli, sinks
from tributary.sources import python_facts as P
from tributary.sources import scan as S
from tributary.sources.sql_lineage import SqlLineage, sql_lineage
from tributary.tables import Document

PIPELINE = '''
from airflow import DAG
LOAD = """INSERT INTO clean_visits (visit_id, visitor, spent, unit, seen_at)
SELECT raw_id::bigint, who, spent::numeric(10,2), unit, seen::timestamp FROM (SELECT *, row_number() OVER (PARTITION BY raw_id ORDER BY loaded) AS n FROM raw_visits) x WHERE n = 1 ON CONFLICT (visit_id) DO NOTHING;"""
DAILY = "INSERT INTO daily_visits (seen_on, visits, visitors, total, mean) SELECT seen_on, COUNT(*), COUNT(DISTINCT visitor), SUM(spent_usd), ROUND(AVG(spent_usd), 2) FROM rich_visits WHERE ok GROUP BY seen_on"

def enrich():
    import pandas as pd
    clean = pd.read_sql("SELECT * FROM clean_visits", con=None)
    rich = pd.DataFrame()
    rich["visit_id"] = clean["visit_id"]
    rich["visitor"] = clean["visitor"]
    rich["spent_usd"] = clean["spent"] * clean["unit"].map({}).fillna(1.0)
    rich["seen_on"] = clean["seen_at"]
    rich["ok"] = clean["spent"] > 0
    rich.to_sql("rich_visits", con=None)

with DAG(dag_id="visits") as dag:
    a = PostgresOperator(task_id="load", sql=LOAD)
    b = PythonOperator(task_id="enrich", python_callable=enrich)
    c = PostgresOperator(task_id="daily", sql=DAILY)
'''


def ask(spark):
    return lambda text: sql_lineage(spark, text).as_dict()


def flow(spark, body, consts=""):
    source = consts + "\ndef f(spark, df=None, name=None):\n" + "\n".join("    " + x for x in body.strip().split("\n"))
    tree = P.ast.parse(source)
    return P.analyze(tree.body[-1].body, P.Names(tree, "m", False, {}), source, ask(spark))


def cols(f):
    return {c.target: (c.sources, c.kind) for c in f.columns}


def test_golden_pipeline(spark, tmp_path):
    (tmp_path / "dags").mkdir()
    (tmp_path / "dags" / "visits.py").write_text(PIPELINE)
    doc = S.scan_path(spark, str(tmp_path / "dags"), S.Options("ex", "Svc", "db", "public"))
    d = doc.as_dict()
    assert [len(d[k]) for k in ("jobs", "datasets", "edges", "diagnostics")] == [3, 4, 3, 0]
    assert [len(e["column_lineage"]) for e in d["edges"]] == [5, 5, 5]
    assert {e["origin"]["source"] for e in d["edges"]} == {"inferred_sql", "inferred_code"}
    usd = next(m for e in d["edges"] for m in e["column_lineage"] if m["to_column"]["column"] == "spent_usd")
    assert [c["column"] for c in usd["from_columns"]] == ["spent", "unit"] and usd["transform_type"] == "transformation" and usd["origin"]["confidence"] == 0.7
    path = tmp_path / "out" / "doc.json"
    doc.write(str(path))
    again = Document.read(spark, str(path)).as_dict()
    assert again["edges"] == d["edges"] and again["datasets"] == d["datasets"]
    dot = sinks.export(doc, "graphviz").artifact
    assert dot.count("->") == 3 and dot.count("dashed") == 3
    events = json.loads(sinks.export(doc, "ol").artifact)
    assert len(events) == 3 and all(e["eventType"] == "COMPLETE" for e in events)
    fields = events[2]["outputs"][0]["facets"]["columnLineage"]["fields"]
    assert set(fields) == {"seen_on", "visitors", "total", "mean"}  # a count of rows has no source
    assert "inferred from SQL" in fields["total"]["inputFields"][0]["transformations"][0]["description"]


def test_catalogue_client(spark, tmp_path):
    (tmp_path / "v.py").write_text(PIPELINE)
    doc = S.scan_path(spark, str(tmp_path), S.Options("ex", "Svc", "db", "public"))
    dry = sinks.export(doc, "om")
    assert dry.sent == 0 and len(json.loads(dry.artifact)) == 3
    calls, waits = [], []

    def transport(method, url, token, body, timeout):
        calls.append((method, url))
        if method == "GET":
            return 200, json.dumps({"id": url[-6:]})
        return (503, "busy") if sum(m == "PUT" for m, _ in calls) == 1 else (200, "")

    live = sinks.export(doc, "om", dry_run=False, host="http://h", token="t", transport=transport, wait=waits.append)
    assert live.sent == 3 and live.failed == 0 and waits == [0.2] and sum(m == "GET" for m, _ in calls) == 4
    bad = sinks.export(doc, "om", dry_run=False, host="http://h", token="t", transport=lambda *a: (404, ""), wait=waits.append)
    assert bad.failed == 3 and bad.sent == 0
    assert sinks.export(S.scan_path(spark, str(tmp_path)), "om").skipped == 3
    with pytest.raises(KeyError):
        sinks.export(doc, "nowhere")


def test_declared_tasks(spark):
    source = '''
import tool as tw
@tw.task(dag="d", inputs=["s.d.p.a", "s.d.p.b"], outputs=["s.d.p.c"], column_map=[(["a.x", "b.y"], "z", "x + y"), ("q", "r")], copy=["r", "k"])
def t(): pass
@tw.task(inputs=None, outputs=["s.d.p.c"], engine="pd", sql="SELECT 1")
def u(): pass
'''
    d = S.scan_source(spark, "m.py", source).as_dict()
    first = [e for e in d["edges"] if e["from"].endswith(".a")][0]["column_lineage"]
    assert [(m["to_column"]["column"], m["transform_type"], m["origin"]["source"]) for m in first] == [("z", "transformation", "declared"), ("r", "identity", "declared"), ("k", "identity", "declared")]
    assert [m["to_column"]["column"] for e in d["edges"] if e["from"].endswith(".b") for m in e["column_lineage"]] == ["z"]
    codes = [x["code"] for x in d["diagnostics"]]
    assert codes == ["E_MISSING_IO", "W_SQL_NOT_PARSED"] and d["jobs"][1]["engine"] == "pandas"


def test_annotated_functions(spark, tmp_path):
    (tmp_path / "conf").mkdir()
    (tmp_path / "conf" / "__init__.py").write_text("")
    (tmp_path / "conf" / "names.py").write_text('RAW = "s.d.p.raw"\nALIAS = RAW\nLOOP = OTHER\nOTHER = LOOP\n')
    (tmp_path / "job.py").write_text('''
from conf.names import ALIAS as SRC
import conf.names as n
@lineage(inputs=[SRC, n.RAW], outputs=["s.d.p.out"])
def good(): pass
@lineage(inputs=["s.d.p.raw"], outputs=[f"s.{x}"])
def dynamic(): pass
@lineage
def bare(): pass
@lineage(inputs=["s.d.p.me"], outputs=["s.d.p.me"])
def loop(): pass
''')
    d = S.scan_path(spark, str(tmp_path)).as_dict()
    edges = {(e["from"], e["to"]): e["origin"] for e in d["edges"]}
    assert edges["s.d.p.raw", "s.d.p.out"]["source"] == "declared"
    assert edges["s.d.p.raw", 'f"s.{x}"']["confidence"] == 0.5 and ("s.d.p.me", "s.d.p.me") in edges
    assert len(d["jobs"]) == 4 and any(x["code"] == "W_NON_LITERAL" for x in d["diagnostics"])


def test_texts_beyond_what_is_sent(spark, tmp_path, monkeypatch):
    """Constants and lineage that lie in files give what those sent around give."""
    (tmp_path / "v.py").write_text(PIPELINE)
    (tmp_path / "names.py").write_text('RAW = "s.d.p.raw"\nALIAS = RAW\n')
    (tmp_path / "job.py").write_text('from names import ALIAS as SRC\n@lineage(inputs=[SRC], outputs=["s.d.p.out"])\ndef good(): pass\n')
    want = S.scan_path(spark, str(tmp_path)).as_dict()
    monkeypatch.setattr(S, "MAX_TEXT", 20)
    monkeypatch.setattr(S, "BUCKETS", 3)
    got = S.scan_path(spark, str(tmp_path)).as_dict()
    assert got == want and any(e["from"] == "s.d.p.raw" for e in got["edges"]) and len(got["jobs"]) == 4


def test_bad_files_give_diagnostics(spark, tmp_path):
    (tmp_path / "a.py").write_text("def (:\n")
    (tmp_path / "b.py").write_bytes(b"\xff\xfe\x00")
    (tmp_path / "c.txt").write_text("not python")
    codes = sorted(x["code"] for x in S.scan_path(spark, str(tmp_path)).as_dict()["diagnostics"])
    assert codes == ["E_PARSE", "E_READ"]


def test_gap_fill_and_helpers(spark, tmp_path):
    (tmp_path / "m.py").write_text('''
import tool as tw
@tw.task(inputs=["s.d.p.a"], outputs=["s.d.p.b"])
def one():
    helper()
@tw.task(inputs=["s.d.p.z"], outputs=["s.d.p.a"], copy=["x"])
def two(): pass
@tw.task(inputs=["s.d.p.b"], outputs=["s.d.p.c"], copy=["x"])
def three(): pass
def helper():
    df = spark.read.table("a")
    out = df.withColumn("w", F.upper(df.v))
    out.write.saveAsTable("b")
def lonely():
    df = spark.read.table("p")
    out = df.withColumnRenamed("i", "j")
    out.write.saveAsTable("q")
''')
    d = S.scan_path(spark, str(tmp_path)).as_dict()
    ab = next(e for e in d["edges"] if (e["from"], e["to"]) == ("s.d.p.a", "s.d.p.b"))
    found = {m["to_column"]["column"]: m["origin"] for m in ab["column_lineage"]}
    assert found["w"]["confidence"] == 0.7 and found["x"]["confidence"] == 0.4
    pq = next(e for e in d["edges"] if e["to"] == "q")
    assert pq["column_discovery"] and "job" not in pq and pq["column_lineage"][0]["to_column"]["column"] == "j"


def test_flow_of_spark_code(spark):
    f = flow(spark, '''
df = spark.read.table("bronze")
out = df.filter("x > 0").withColumn("usd", F.col("amount") * 2).withColumnRenamed("id", "key")
out.write.mode("append").saveAsTable("silver")
''')
    assert cols(f) == {"usd": (["bronze.amount"], "transformation"), "key": (["bronze.id"], "identity")}
    assert f.inputs == ["bronze"] and f.outputs == ["silver"] and f.engine == "spark" and {c.output_table for c in f.columns} == {"silver"}
    assert cols(flow(spark, 'o = df.select("a", F.col("b").alias("c"), F.col("d"))')) == {"a": (["a"], "identity"), "c": (["b"], "identity"), "d": (["d"], "identity")}
    assert cols(flow(spark, 'o = df.selectExpr("a * 1.08 AS x", "b")')) == {"x": (["a"], "transformation"), "b": (["b"], "identity")}
    assert cols(flow(spark, 'o = df.groupBy("r").agg(F.sum(F.col("v")).alias("t"))')) == {"r": (["r"], "identity"), "t": (["v"], "aggregation")}
    assert cols(flow(spark, 'o = df.groupby(["r"]).agg({"v": "sum"})'))["v"] == (["v"], "aggregation")
    assert cols(flow(spark, 'o = df.groupby("r").agg(n=("v", "max"))'))["n"] == (["v"], "aggregation")
    assert cols(flow(spark, 'o = df.rename(columns={"a": "b"}).assign(c=df["d"] + df["e"])')) == {"b": (["a"], "identity"), "c": (["d", "e"], "transformation")}


def test_flow_of_pandas_code(spark):
    f = flow(spark, '''
src = pd.read_sql("SELECT * FROM raw", con=None)
col = "total"
out = src[["a", "b"]]
out[col] = src["x"] + src["y"]
for c in ["p", "q"]:
    out[c] = src[c]
out["full"] = src.apply(lambda r: r["first"] + r.last, axis=1)
if name:
    out["k"] = src["k"]
else:
    out["k"] = src["k"]
out.to_sql("clean", con=None)
''')
    got = cols(f)
    assert got["total"] == (["raw.x", "raw.y"], "transformation") and got["p"] == (["raw.p"], "identity") and got["full"][0] == ["raw.first", "raw.last"]
    assert sum(c.target == "k" for c in f.columns) == 1 and f.engine == "pandas" and not f.opaque


@pytest.mark.parametrize("body,word", [
    ('out[name] = df["x"]', "non-literal column name"),
    ('out["c"] = df.apply(work)', '"c"'),
    ('o = df.withColumn("r", F.rand())', '"r"'),
    ('for c in names:\n    out[c] = df[c]', "can't unroll"),
    ('df.columns = ["a"]', "columns"),
    ("o = df.merge(x)", "merge"),
    ("o = df.groupBy('a').agg(F.sum('b'))", "alias"),
    ("o = df.rename(columns=m)", "rename"),
])
def test_opaque_code_is_noted(spark, body, word):
    f = flow(spark, body)
    assert any(word in d for _, d in f.opaque) and not [c for c in f.columns if c.target not in ("a",)]


def test_views_and_folded_sql(spark):
    f = flow(spark, '''
df = spark.read.table("bronze")
df.createOrReplaceTempView("v")
spark.sql(f"INSERT INTO {TARGET} SELECT CAST(amount AS INT) AS amount FROM v")
''', 'TARGET = "gold"')
    assert f.outputs == ["gold"] and f.inputs == ["bronze"] and cols(f) == {"amount": (["bronze.amount"], "transformation")}
    runtime = flow(spark, 'spark.sql(f"INSERT INTO {name} SELECT a FROM s")')
    assert runtime.outputs == [P.PLACEHOLDER] and cols(runtime) == {"a": (["s.a"], "identity")}
    assert not flow(spark, 'spark.sql(f"DROP TABLE {name}")').columns


def test_modules_and_names():
    assert P.module_path("/r", "/r/a/b.py") == "a.b" and P.module_path("/r", "/r/a/__init__.py") == "a" and P.module_path("/r", "/r/__init__.py") == "__init__"
    consts = P.constants(P.ast.parse("A='x'\nB=A\nC=B\nD=E\nE=D\nF=missing\nA2: str = 'y'"))
    assert consts == {"A": "x", "B": "x", "C": "x", "A2": "y"}
    assert SqlLineage().as_dict()["mappings"] == []


def test_gate_command(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda: spark)
    (tmp_path / "v.py").write_text(PIPELINE)
    assert cli.main(["gate", "--repo-path", str(tmp_path), "--json", "--min-coverage", "1.0"]) == 0
    out = json.loads(capsys.readouterr().out)
    assert out["passed"] and out["tasks_total"] == 3 and out["task_coverage"] == 1.0 and out["annotation_coverage"] == 0.0 and out["edges_total"] == 3 and out["high_confidence_edges"] == 0
    assert out["thresholds"] == {"min_task_coverage": 1.0, "min_annotation_coverage": 0.0, "min_high_confidence": 0.0} and out["checks"] == dict.fromkeys(("task_coverage", "annotation_coverage", "high_confidence_fraction"), True)
    assert out["per_dag"][0]["dag"] == "visits" and out["per_dag"][0]["column_edges"] == 0 == out["per_dag"][0]["column_mappings"]
    assert cli.main(["gate", "--repo-path", str(tmp_path), "--min-annotation-coverage", "0.5"]) == 1
    text = capsys.readouterr().out
    assert "gate: FAIL" in text and "[PASS] task_coverage" in text and "[FAIL] annotation_coverage 0.000 >= 0.500 (min)" in text
    assert cli.main(["gate", "--repo-path", str(tmp_path), "--format", "json", "--min-task-coverage", "0.5"]) == 0 and json.loads(capsys.readouterr().out)["passed"]
    monkeypatch.setenv("GATE_MIN_ANNOTATION_COVERAGE", "0.5")
    assert cli.main(["gate", "--repo-path", str(tmp_path)]) == 1
    assert cli.main(["gate", "--repo-path", str(tmp_path), "--min-annotation-coverage", "0"]) == 0
    monkeypatch.setenv("GATE_MIN_ANNOTATION_COVERAGE", "many")
    assert cli.main(["gate", "--repo-path", str(tmp_path)]) == 2
    monkeypatch.delenv("GATE_MIN_ANNOTATION_COVERAGE")
    assert cli.main(["gate", "--repo-path", str(tmp_path / "none")]) == 2


def test_git_snapshot(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), *a], check=True, capture_output=True)
    run("init", "-q")
    (tmp_path / "a.py").write_text("x = 1\n")
    run("add", ".")
    run("-c", "user.name=n", "-c", "user.email=e@x", "commit", "-qm", "m")
    (tmp_path / "a.py").write_text("x = 2\n")
    made = S.git_snapshot(spark, str(tmp_path), "HEAD")
    assert open(f"{made}/a.py").read() == "x = 1\n"
    assert len(S.scan_path(spark, made).as_dict()["diagnostics"]) == 0
    S.remove(spark, made)
    assert not os.path.exists(made)
    with pytest.raises(subprocess.CalledProcessError):
        S.git_snapshot(spark, str(tmp_path), "nothing")


def test_commands(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda: spark)
    (tmp_path / "v.py").write_text(PIPELINE)
    doc = str(tmp_path / "o" / "d.json")
    assert cli.main(["scan", str(tmp_path / "v.py"), "--out", doc, "--service", "S", "--database", "d", "--schema", "p", "--strict"]) == 0
    assert json.load(open(doc))["generated_at"].endswith("Z")
    assert cli.main(["validate", doc]) == 0
    assert cli.main(["graph", doc, "--out", str(tmp_path / "g.dot")]) == 0 and "digraph" in (tmp_path / "g.dot").read_text()
    assert cli.main(["export", doc, "--to", "om", "--fail-on-partial"]) == 0
    assert cli.main(["export", doc, "--to", "x"]) == 2
