"""A lineage document as tables, and its JSON form."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import schemas as T
from .functions.scalars import origin
from .operators import catalog
from .storage import stored

PRODUCER = "tributary"


def _empty(spark: SparkSession, ddl: str) -> DataFrame:
    return spark.createDataFrame([], T.parse(ddl))


@dataclass
class Document:
    """datasets, jobs, edges, column_edges and diagnostics, with the document's own members."""

    datasets: DataFrame
    jobs: DataFrame
    edges: DataFrame
    column_edges: DataFrame
    diagnostics: DataFrame
    namespace: str = "default"
    head: dict = field(default_factory=dict)

    def replace(self, **tables) -> Document:
        return replace(self, **tables)

    @classmethod
    def from_rows(cls, spark: SparkSession, rows: DataFrame, namespace: str) -> Document:
        """From (seq, kind, row) with JSON rows, as a scan yields them."""

        def of(kind: str, ddl: str) -> DataFrame:
            return rows.where(F.col("kind") == kind).select("seq", F.from_json("row", T.parse(ddl)).alias("r")).select("seq", "r.*")

        field_ = "array<struct<name:string,type:string,description:string>>"
        named = of("dataset", f"name string, origin {T.ORIGIN}")
        full = named.select("seq", "name", *[F.lit(None).cast("string").alias(c) for c in ("namespace", "platform", "fqn")], F.array().cast(field_).alias("schema"), "origin")
        datasets = catalog.upsert_datasets(full).withColumn("facets", F.lit(None).cast("map<string,string>"))
        jobs = of("job", f"id string, name string, dag string, engine string, location {T.LOCATION}, description string, sql string, inputs array<string>, outputs array<string>, origin {T.ORIGIN}").withColumn("namespace", F.lit(None).cast("string"))
        mapping = f"struct<from_columns:array<{T.REF}>,to_column:{T.REF},function:string,transform_type:string,origin:{T.ORIGIN}>"
        raw = of("edge", f"`from` string, `to` string, job string, transform {T.TRANSFORM}, column_discovery boolean, origin {T.ORIGIN}, mappings array<{mapping}>")
        edges = raw.withColumnRenamed("seq", "edge_id").drop("mappings")
        direct = raw.select(F.col("seq").alias("edge_id"), F.posexplode("mappings").alias("ordinal", "m")).select("edge_id", "ordinal", "m.*")
        # columns found in helpers: on each edge of the caller that a source is on, unless mapped there
        attributed = of("attributed", f"job string, `to` string, mapping {mapping}").join(edges.select("edge_id", "job", "to", "from"), ["job", "to"])
        mine = attributed.where((F.size("mapping.from_columns") == 0) | F.exists("mapping.from_columns", lambda r: r["dataset"] == F.col("from")))
        extra = mine.select("edge_id", (F.lit(1_000_000) + F.row_number().over(W.partitionBy("edge_id").orderBy("seq"))).cast("int").alias("ordinal"), "mapping.*")
        extra = extra.join(direct.select("edge_id", F.col("to_column.column").alias("done")), (extra.edge_id == direct.edge_id) & (extra.to_column["column"] == F.col("done")), "left_anti")
        diagnostics = of("diagnostic", f"level string, code string, message string, location {T.LOCATION}")
        return cls(datasets, jobs, edges, direct.unionByName(extra), diagnostics, namespace)

    def add_edges(self, derived: DataFrame) -> Document:
        """With edges that ``derive_edges`` found, after the others."""
        from_job = self.jobs.select(F.col("id").alias("job"), "description", "sql", F.col("origin").alias("o"), "engine")
        top = self.edges.agg(F.coalesce(F.max("edge_id"), F.lit(0)).alias("top"))
        # increasing along sorted ranges: an order without a single task
        ordered = derived.join(from_job, "job", "left").repartitionByRange("from", "to").sortWithinPartitions("from", "to")
        first = top.first()["top"]
        new = ordered.select(
            (F.lit(first + 1) + F.monotonically_increasing_id()).alias("edge_id"), "from", "to", "job", F.struct(F.col("engine").alias("kind"), "description", "sql").alias("transform"), F.lit(False).alias("column_discovery"), F.col("o").alias("origin")
        )
        # numbers are given once: the ranges of another run may be cut elsewhere
        return self.replace(edges=self.edges.unionByName(stored(new)))

    def add_same_names(self, filled: DataFrame) -> Document:
        ref = lambda d: F.struct(F.col(d).alias("dataset"), F.col("column").alias("column"))
        place = F.row_number().over(W.partitionBy("edge_id").orderBy("column")) + 2_000_000
        new = filled.select("edge_id", place.cast("int").alias("ordinal"), F.array(ref("from")).alias("from_columns"), ref("to").alias("to_column"), F.lit("direct copy").alias("function"), F.lit("identity").alias("transform_type"), origin(F.lit(T.CODE), T.SAME_NAME_CONFIDENCE, "same name").alias("origin"))
        return self.replace(column_edges=self.column_edges.unionByName(new))

    def add_diagnostics(self, more: DataFrame) -> Document:
        return self.replace(diagnostics=self.diagnostics.unionByName(more.withColumn("seq", F.lit(1 << 40)), allowMissingColumns=True))

    # -- JSON
    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Document:
        """From a JSON document; members may be missing. Many documents at once are united."""
        d = spark.read.schema(T.parse(T.DOCUMENT)).json(path, multiLine=True).withColumn("file", F.col("_metadata.file_path"))
        # only the names of the files meet in one task
        numbers = d.select("file").distinct().select("file", ((F.row_number().over(W.orderBy("file")) - 1) * (1 << 32)).alias("base"))
        part = lambda c: d.select("file", F.posexplode(c).alias("pos", "r")).join(numbers, "file").withColumn("seq", F.col("base") + F.col("pos"))
        datasets = part("datasets").select("seq", "r.*")
        jobs = part("jobs").select("seq", "r.*")
        raw = part("edges").select(F.col("seq").alias("edge_id"), "r.*")
        maps = raw.select("edge_id", F.posexplode("column_lineage").alias("ordinal", "m")).select("edge_id", "ordinal", "m.*")
        maps = maps.withColumn("from_columns", F.coalesce("from_columns", F.array().cast(f"array<{T.REF}>")))
        edges = raw.drop("column_lineage").withColumn("column_discovery", F.coalesce("column_discovery", F.lit(False)))
        none = F.array().cast("array<string>")
        jobs = jobs.withColumns({"inputs": F.coalesce("inputs", none), "outputs": F.coalesce("outputs", none), "dag": F.coalesce("dag", F.lit("default"))})
        schema = F.array().cast("array<struct<name:string,type:string,description:string>>")
        datasets = datasets.withColumn("schema", F.coalesce("schema", schema))
        head = d.select("weave_version", "producer", "generated_at", "namespace").first()
        return cls(datasets, jobs, edges, maps, part("diagnostics").select("seq", "r.*"), (head and head["namespace"]) or "default", head.asDict() if head else {})

    def as_dict(self) -> dict:
        """The document, in order, without empty and missing members. Small enough for one process, as
        the file that it becomes."""
        rows = lambda df, key: [_bare(json.loads(r[0])) for r in df.orderBy(key).select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in ("seq",)]))).collect()]
        maps = self.column_edges.groupBy("edge_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", F.struct("from_columns", "to_column", "function", "transform_type", "origin").alias("m")))), lambda x: x["m"]).alias("column_lineage"))
        edges = self.edges.join(maps, "edge_id", "left")
        out = {"weave_version": T.VERSION, "producer": PRODUCER, "namespace": self.namespace} | {k: v for k, v in self.head.items() if v is not None}
        out["datasets"], out["jobs"] = rows(self.datasets, "seq"), rows(self.jobs, "seq")
        out["edges"] = rows(edges, "edge_id")
        for e in out["edges"]:
            e.pop("edge_id")
            if not e.get("column_discovery"):
                e.pop("column_discovery", None)
        out["diagnostics"] = rows(self.diagnostics, ["seq", "code", "message"])
        return out

    def write(self, path: str | None) -> str:
        text = json.dumps(self.as_dict(), indent=2, ensure_ascii=False)
        if path:
            from pathlib import Path

            Path(path).parent.mkdir(parents=True, exist_ok=True)
            Path(path).write_text(text)
        return text


def _bare(x):
    if isinstance(x, dict):
        return {k: v for k, v in ((k, _bare(v)) for k, v in x.items()) if v is not None and v != [] and v != {}}
    if isinstance(x, list):
        return [_bare(v) for v in x]
    return round(x, 6) if isinstance(x, float) else x
