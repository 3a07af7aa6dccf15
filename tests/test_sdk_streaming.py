import json
import time

from tributary import resolvers, sdk, streaming


def test_decorators_do_nothing():
    sdk.registry.clear()

    @sdk.task
    def a(x):
        return x + 1

    @sdk.task(inputs="one", outputs=[None, sdk.Dataset("s", "d", "p", "t"), 3], copy=["c"])
    def b():
        return 2

    @sdk.sql("SELECT 1", outputs=["o"])
    def c():
        return 3

    assert (a(1), b(), c()) == (2, 2, 3)
    assert [d.name for d in sdk.registry] == ["a", "b", "c"] and sdk.registry[1].inputs == ("one",) and sdk.registry[1].outputs == ("s.d.p.t", "3")
    assert sdk.registry[2].engine == "sql" and sdk.registry[2].sql == "SELECT 1"


def test_lineage_attribute_is_each_functions_own():
    @sdk.lineage(inputs=["a"], outputs="b")
    def f():
        pass

    @sdk.lineage
    def g():
        pass

    assert getattr(f, sdk.ATTRIBUTE) == {"name": "f", "inputs": ["a"], "outputs": ["b"], "description": None}
    assert getattr(g, sdk.ATTRIBUTE)["inputs"] == [] and getattr(f, sdk.ATTRIBUTE) is not getattr(g, sdk.ATTRIBUTE)
    assert sdk.lineage(inputs=["x"])(5) == 5
    sdk.configure(service="s", dag="d")
    assert sdk.config["service"] == "s" and "schema" not in sdk.config
    assert resolvers.resolvers() == []


def test_documents_merge_as_they_come(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "table")
    source.mkdir()
    (source / "1.json").write_text(json.dumps({"datasets": [{"name": "a", "schema": [{"name": "x"}], "origin": {"source": "inferred_sql"}}]}))
    streaming.start(spark, str(source), target, str(tmp_path / "cp")).awaitTermination(60)
    time.sleep(1.1)
    (source / "2.json").write_text(json.dumps({"datasets": [{"name": "a", "platform": "s3", "schema": [{"name": "y"}, {"name": "x"}], "origin": {"source": "declared"}}, {"name": "b"}]}))
    streaming.start(spark, str(source), target, str(tmp_path / "cp")).awaitTermination(60)
    got = {r.name: r for r in streaming.current(spark, target).collect()}
    assert set(got) == {"a", "b"} and [f.name for f in got["a"].schema] == ["x", "y"] and got["a"].platform == "s3" and got["a"].origin.source == "declared"
