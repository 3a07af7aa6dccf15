"""Scans of Python sources into the tables of a lineage document.

Files are parsed where they are read: a first pass finds constants and SQL texts, the driver has
Spark parse the distinct texts, and a second pass turns every file into rows. What follows (merging
datasets, deriving edges, back-filling schemas, gap-filling, validation) are the catalog's operators.
"""

from __future__ import annotations

import json
import os
import re
import shutil
import subprocess
import tempfile
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import islice

import pandas as pd
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .. import schemas as T
from ..operators import catalog, rules
from ..shipping import ship
from ..storage import file_system, scratch_uri, stored
from ..tables import Document
from . import python_facts as P
from .sql_lineage import LINEAGE_ROWS, SqlLineage, sql_lineage

#: Characters of constants, or of SQL texts, that are sent to the executors; more lie in files of the
#: shared folder, from which each process reads what it needs.
MAX_TEXT = 64 << 20
#: Files of the shared folder that such texts are spread over, at most.
BUCKETS = 10_000


@dataclass
class Options:
    namespace: str = "default"
    service: str | None = None
    database: str | None = None
    schema: str | None = None
    infer_code: bool = True
    precise: bool = True
    root: str = field(default="", compare=False)


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, source, error) of every Python file below a folder, or of one file, by path. A file
    that isn't UTF-8 gives an error row, not a failed job."""
    ship(spark)
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.py").load(root)
    text = F.try_validate_utf8("content") if hasattr(F, "try_validate_utf8") else F.decode("content", "UTF-8")
    path = F.regexp_replace("path", "^file:/+", "/")
    return listed.select(path.alias("path"), text.cast("string").alias("source")).select("path", "source", F.when(F.col("source").isNull(), "not UTF-8").alias("error"))


def git_snapshot(spark: SparkSession, repository: str, ref: str) -> str:
    """A new folder with a commit's files, in the folder that all executors share."""
    local = tempfile.mkdtemp(prefix="tributary-ref-")
    try:
        archive = subprocess.run(["git", "-C", repository, "archive", ref], capture_output=True, check=True)
        subprocess.run(["tar", "-x", "-C", local], input=archive.stdout, check=True, capture_output=True)
        target = scratch_uri(spark) + "/files"
        fs, path = file_system(spark, target)
        fs.copyFromLocalFile(file_system(spark, f"file://{local}")[1], path)
    finally:
        shutil.rmtree(local, ignore_errors=True)
    return re.sub("^file:/+", "/", target)


def _module(path: str, root: str) -> tuple[str, bool]:
    return P.module_path(root, path), path.endswith("__init__.py")


def _ask(files: DataFrame, root: str) -> tuple[dict | Shelf, DataFrame]:
    """Constants by module, and a table of the distinct SQL texts that an analysis asks for."""

    def constants(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, source in zip(b["path"], b["source"]):
                try:
                    found = P.constants(P.ast.parse(source or ""))
                except (SyntaxError, ValueError):
                    continue
                rows += [(_module(path, root)[0], k, v) for k, v in found.items()]
            yield pd.DataFrame(rows, columns=["module", "name", "value"])

    named = stored(files.select("path", "source").mapInPandas(constants, "module string, name string, value string"))
    if (named.agg(F.sum(F.length("value"))).first()[0] or 0) <= MAX_TEXT:
        known: dict | Shelf = {}
        for r in named.collect():  # at most MAX_TEXT
            known.setdefault(r["module"], {})[r["name"]] = r["value"]
    else:
        modules = named.select("module").distinct()  # names alone
        known = Shelf.of(named.select(F.col("module").alias("key"), "name", "value"), [r["module"] for r in modules.toLocalIterator()])

    def texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            asked: set[str] = set()

            def record(text: str) -> dict:
                asked.add(text)
                return SqlLineage().as_dict()

            for path, source in zip(b["path"], b["source"]):
                try:
                    found = P.scan_module(source or "", *_module(path, root), known, record)
                    asked.update(t.sql for t in found.tasks if t.sql)
                except (SyntaxError, ValueError):
                    pass
            yield pd.DataFrame({"sql": sorted(asked)}, dtype=object)

    asked = stored(files.select("path", "source").mapInPandas(texts, "sql string").distinct())
    return known, asked


def _answers(asked: DataFrame, precise: bool) -> dict | Shelf:
    """The lineage of SQL texts: Spark's parser is the driver's, so they pass through it, some at a time."""
    spark, few = asked.sparkSession, (asked.agg(F.sum(F.length("sql"))).first()[0] or 0) <= MAX_TEXT
    held, parts = {}, None
    rows = iter(asked.collect()) if few else asked.toLocalIterator()
    while part := [r["sql"] for r in islice(rows, LINEAGE_ROWS)]:
        found = {t: sql_lineage(spark, t, precise).as_dict() for t in part}
        if few:
            held |= found
            continue
        df = stored(spark.createDataFrame([(t, "lineage", json.dumps(f)) for t, f in found.items()], "key string, name string, value string"))
        parts = df if parts is None else parts.union(df)
    return held if parts is None else Shelf.of(parts, ())


class Shelf:
    """A mapping from a key to its named values, which lie in files of the shared folder by the key's
    hash. A process holds the few files that it read last."""

    def __init__(self, uri: str, buckets: int, keys: Iterable[str]) -> None:
        self.uri, self.buckets, self.keys, self.read = uri, buckets, keys, {}

    def __getstate__(self):
        return self.__dict__ | {"read": {}}

    @classmethod
    def of(cls, rows: DataFrame, keys: Iterable[str]) -> Shelf:
        """From (key, name, value) rows."""
        size = rows.agg(F.sum(F.length("key") + F.length("value"))).first()[0] or 0
        uri, buckets = scratch_uri(rows.sparkSession), max(1, min(BUCKETS, 4 * size // MAX_TEXT))

        def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: dict[int, dict] = {}
            for b in batches:
                for bucket, key, name, value in zip(b["bucket"], b["key"], b["name"], b["value"]):
                    held.setdefault(bucket, {}).setdefault(key, {})[name] = value
            for bucket, values in held.items():
                files, where = FileSystem.from_uri(f"{uri}/{bucket}.json")
                with files.open_output_stream(where) as f:
                    f.write(json.dumps(values).encode())
            yield pd.DataFrame({"n": [len(held)]})

        placed = rows.withColumn("bucket", F.pmod(F.crc32("key"), F.lit(buckets)).cast("int"))
        placed.repartition(buckets, "bucket").mapInPandas(write, "n int").agg(F.sum("n")).collect()
        return cls(uri, buckets, keys)

    def get(self, key: str, default=None):
        bucket = zlib.crc32(key.encode()) % self.buckets
        if bucket not in self.read:
            if len(self.read) > 3:
                self.read.pop(next(iter(self.read)))
            files, where = FileSystem.from_uri(f"{self.uri}/{bucket}.json")
            there = files.get_file_info(where).type.name == "File"
            self.read[bucket] = json.loads(files.open_input_file(where).read()) if there else {}
        return self.read[bucket].get(key, default)

    def __contains__(self, key: str) -> bool:
        return self.get(key) is not None

    def __getitem__(self, key: str) -> dict:
        return self.get(key)

    def __iter__(self) -> Iterator[str]:
        return iter(self.keys)


def _answer(answers: dict | Shelf, text: str) -> dict:
    found = answers.get(text)
    if isinstance(answers, Shelf) and found:
        found = json.loads(found["lineage"])
    return found or SqlLineage().as_dict()


def scan(spark: SparkSession, files: DataFrame, options: Options, finalize: bool = True) -> Document:
    """The document of (path, source, error) rows."""
    root = options.root
    known, asked = _ask(files, root)
    answers = _answers(asked, options.precise)
    held = spark.sparkContext.broadcast((known, answers))

    def facts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known_, answers_ = held.value
        for b in batches:
            rows = []
            for path, source, error in zip(b["path"], b["source"], b["error"]):
                ask = lambda t: _answer(answers_, t)
                out = Lowering(path, options, ask)
                if isinstance(error, str):
                    out.diagnostic("error", "E_READ", f"{path}: {error}", None)
                else:
                    try:
                        module = P.scan_module(source or "", *_module(path, root), known_, ask)
                        out.module(module)
                    except (SyntaxError, ValueError) as e:
                        out.diagnostic("error", "E_PARSE", f"{path}: {e}", getattr(e, "lineno", None))
                rows += [(path, i, kind, json.dumps(row)) for i, (kind, row) in enumerate(out.rows)]
            yield pd.DataFrame(rows, columns=["path", "i", "kind", "row"])

    found = stored(files.select("path", "source", "error").mapInPandas(facts, "path string, i int, kind string, row string"))
    # a place in the whole: files by path, rows by their number
    # only the names of the files meet in one task
    order = found.select("path").distinct().select("path", F.row_number().over(W.orderBy("path")).cast("bigint").alias("file"))
    placed = stored(found.join(order, "path").withColumn("seq", F.shiftleft("file", 24) + F.col("i")))
    document = Document.from_rows(spark, placed, options.namespace)
    return finish(document, options) if finalize else document


def scan_path(spark: SparkSession, root: str, options: Options | None = None) -> Document:
    options = options or Options()
    full = root if "://" in root else os.path.abspath(root)
    options.root = os.path.dirname(full) if full.endswith(".py") else full
    return scan(spark, read_files(spark, full), options)


def scan_source(spark: SparkSession, path: str, source: str, options: Options | None = None) -> Document:
    """One source in memory, without what concerns the whole document."""
    return scan(spark, spark.createDataFrame([(path, source, None)], "path string, source string, error string"), options or Options(), finalize=False)


def finish(doc: Document, options: Options) -> Document:
    """Edges from jobs, schemas from mappings, mappings from equal names, then the diagnostics."""
    derived = catalog.derive_edges(doc.jobs, doc.edges)
    doc = doc.add_edges(derived)
    doc = doc.replace(datasets=catalog.backfill_schemas(doc.datasets, doc.edges, doc.column_edges))
    if options.infer_code:
        doc = doc.add_same_names(catalog.fill_same_names(doc.datasets, doc.edges, doc.column_edges))
    missing = catalog.missing_lineage(doc.edges, doc.column_edges, doc.jobs).select("level", "code", "message", "location")
    invalid = rules.validate(doc.datasets, doc.jobs, doc.edges, doc.column_edges).select("level", "code", F.col("subject").alias("message"), F.lit(None).cast(T.LOCATION).alias("location"))
    return doc.add_diagnostics(missing.union(invalid))


class Lowering:
    """Rows of one file: datasets, jobs, edges, mappings and diagnostics, in order."""

    def __init__(self, path: str, options: Options, ask) -> None:
        self.path, self.options, self.ask, self.rows = path, options, ask, []
        self.config: dict = {}

    def diagnostic(self, level: str, code: str, message: str, line: int | None) -> None:
        self.rows.append(("diagnostic", {"level": level, "code": code, "message": message, "location": {"file": self.path, "line": line}}))

    def origin(self, source: str, confidence: float | None = None, note: str | None = None, line: int | None = None) -> dict:
        return {"source": source, "confidence": confidence, "note": note, "location": {"file": self.path, "line": line} if line else None}

    def name(self, dataset: str) -> str:
        parts = [self.config.get(k) or getattr(self.options, k) for k in ("service", "database", "schema")]
        return ".".join([*parts, dataset]) if "." not in dataset and all(parts) else dataset

    def module(self, m: P.Module) -> None:
        self.config = m.config
        jobs: dict[str, dict] = {}
        for t in m.tasks:
            if not t.column_only:
                jobs[t.name] = self.task(t)
        for t in m.tasks:
            if t.column_only:
                self.helper(t, jobs.get(t.enclosing) if t.enclosing else None)

    def structural(self, t: P.Task, engine: str) -> dict:
        if t.discovered:
            sql = engine == "sql"
            return self.origin(T.SQL if sql else T.CODE, T.SQL_CONFIDENCE if sql else T.CODE_CONFIDENCE, "discovered from operators", t.line)
        return self.origin(T.DECLARED, None, "annotation" if t.lineage else None, t.line if t.lineage else None)

    def task(self, t: P.Task) -> dict:
        engine = _engine(t.engine) if t.engine else "sql" if t.sql else "python"
        dag = t.dag or self.config.get("dag") or "default"
        origin = self.structural(t, engine)
        inputs, outputs = [self.name(x) for x in t.inputs], [self.name(x) for x in t.outputs]
        for d in dict.fromkeys([*inputs, *outputs]):
            self.rows.append(("dataset", {"name": d, "origin": origin}))
        job = {"id": f"{dag}.{t.name}", "name": t.name, "dag": dag, "engine": engine, "location": {"file": self.path, "line": t.line}, "description": t.description, "sql": t.sql, "inputs": inputs, "outputs": outputs, "origin": origin}
        self.rows.append(("job", job))
        self.hygiene(t, engine, inputs, outputs)
        if not t.lineage:
            quoted = {m[1] for m in t.column_map}
            for line, detail in t.opaque:
                if not any(f'"{q}"' in detail for q in quoted):
                    self.diagnostic("warn", "W_OPAQUE_COLUMN", detail, line)
        edge_origin = self.origin(T.CODE, T.NONLITERAL_CONFIDENCE, "a name that isn't literal", t.line) if t.lineage and t.nonliteral else origin
        sql = self.sql(t, engine)
        for o in outputs:
            mappings = self.mappings(t, inputs, o, len(outputs), sql, engine)
            for k, i in enumerate(inputs):
                if i == o and edge_origin["source"] != T.DECLARED:
                    continue
                mine = [m for m in mappings if any(r["dataset"] == i for r in m["from_columns"]) or (not m["from_columns"] and k == 0)]
                self.rows.append(("edge", {"from": i, "to": o, "job": job["id"], "transform": {"kind": t.transform or engine, "description": t.description, "sql": t.sql}, "column_discovery": False, "origin": edge_origin, "mappings": mine}))
        return job

    def sql(self, t: P.Task, engine: str) -> dict | None:
        """Lineage of a task's query, with notes on what it refuses."""
        if engine != "sql" or not t.sql:
            return None
        found = self.ask(t.sql)
        if found["wildcard"]:
            self.diagnostic("warn", "W_SQL_WILDCARD", f"task {t.name} projects * into a list of columns", t.line)
        if found["arity"]:
            self.diagnostic("warn", "W_SQL_ARITY", f"task {t.name} projects {found['arity'][0]} values into {found['arity'][1]} columns", t.line)
        return found

    def hygiene(self, t: P.Task, engine: str, inputs: list[str], outputs: list[str]) -> None:
        if not t.lineage and (not inputs or not outputs):
            self.diagnostic("error", "E_MISSING_IO", f"task {t.name} lacks {'inputs' if not inputs else 'outputs'}", t.line)
        if t.sql and engine != "sql":
            self.diagnostic("warn", "W_SQL_NOT_PARSED", f"task {t.name} has SQL but runs on {engine}", t.line)
        for k in [*t.unresolved, *t.nonliteral]:
            self.diagnostic("warn", "W_NON_LITERAL", f"{k} of task {t.name} isn't a literal or constant", t.line)
        if not t.lineage:
            for d in [*inputs, *outputs]:
                if len(d.split(".")) != 4 or not all(d.split(".")):
                    self.diagnostic("warn", "W_BAD_FQN", f"{d} doesn't have four parts", t.line)

    def ref(self, inputs: list[str], text: str) -> dict | None:
        table, _, column = text.rpartition(".")
        hit = next((i for i in inputs if table and (i == table or i.rsplit(".", 1)[-1] == table)), None)
        dataset = hit or (inputs[0] if inputs else None)
        return {"dataset": dataset, "column": column} if dataset else None

    def mapping(self, refs: list[str], inputs: list[str], output: str, target: str, function: str | None, kind: str, origin: dict) -> dict:
        sources = [r for r in (self.ref(inputs, x) for x in refs) if r]
        return {"from_columns": sources, "to_column": {"dataset": output, "column": target}, "function": function, "transform_type": kind, "origin": origin}

    def mappings(self, t: P.Task, inputs: list[str], output: str, n_outputs: int, sql: dict | None, engine: str) -> list[dict]:
        """Declared ones, then those of SQL, then of code; the first of a target wins across tiers."""
        out = [self.mapping(s, inputs, output, target, label, P.classify(label, len(s)), self.origin(T.DECLARED)) for s, target, label in t.column_map]
        done = {m["to_column"]["column"] for m in out}
        fits = lambda table: output == table or output.rsplit(".", 1)[-1] == table
        tiers: list[tuple] = []
        if sql and (sql["target"] is None or fits(sql["target"])):
            tiers += [([f"{tb}.{c}" if tb else c for tb, c in m["sources"]], m["target"], m["function"], m["kind"], T.SQL, T.SQL_CONFIDENCE) for m in sql["mappings"]]
        if self.options.infer_code:
            tiers += [(c.sources, c.target, c.function, c.kind, T.CODE, T.CODE_CONFIDENCE) for c in t.columns if (fits(c.output_table) if c.output_table else n_outputs == 1)]
        for refs, target, function, kind, source, confidence in tiers:
            if target not in done:
                done.add(target)
                out.append(self.mapping(refs, inputs, output, target, function, kind, self.origin(source, confidence)))
        return out

    def helper(self, t: P.Task, job: dict | None) -> None:
        """A function in which columns are found: on the caller's edge, or on edges of its own tables."""
        if not self.options.infer_code:
            return
        rest = []
        for c in t.columns:
            place = None
            if job and job["inputs"]:
                outs = job["outputs"]
                place = outs[0] if len(outs) == 1 else next((o for o in outs if c.output_table and (o == c.output_table or o.rsplit(".", 1)[-1] == c.output_table)), None)
            if place is None:
                rest.append(c)
                continue
            self.rows.append(("attributed", {"job": job["id"], "to": place, "mapping": self.mapping(c.sources, job["inputs"], place, c.target, c.function, c.kind, self.origin(T.CODE, T.CODE_CONFIDENCE, None, t.line))}))
        pairs: dict[tuple[str, str], list] = {}
        for c in rest:
            if c.output_table:
                for table in dict.fromkeys(s.rsplit(".", 1)[0] for s in c.sources if "." in s):
                    pairs.setdefault((table, c.output_table), []).append(c)
        origin = self.origin(T.CODE, T.CODE_CONFIDENCE, "column discovery", t.line)
        for (i, o), columns in pairs.items():
            a, b = self.name(i), self.name(o)
            for d in (a, b):
                self.rows.append(("dataset", {"name": d, "origin": origin}))
            maps = [self.mapping([s for s in c.sources if s.rsplit(".", 1)[0] == i], [a], b, c.target, c.function, c.kind, self.origin(T.CODE, T.CODE_CONFIDENCE)) for c in columns]
            self.rows.append(("edge", {"from": a, "to": b, "job": job["id"] if job else None, "transform": {"kind": t.engine or "python", "description": None, "sql": None}, "column_discovery": True, "origin": origin, "mappings": maps}))


def _engine(text: str) -> str:
    t = text.strip().lower()
    return {"pd": "pandas", "pyspark": "spark", "py": "python", "shell": "bash"}.get(t, t if t in ("sql", "pandas", "spark", "python", "bash") else "unknown")


def remove(spark: SparkSession, uri: str) -> None:
    fs, path = file_system(spark, uri)
    fs.delete(path, True)
