"""One COMPLETE event per job, with the column lineage of its outputs."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import catalog
from .report import Report

RUN_EVENT = "https://openlineage.io/spec/2-0-2/OpenLineage.json#/$defs/RunEvent"
COLUMNS = "https://openlineage.io/spec/facets/1-2-0/ColumnLineageDatasetFacet.json#/$defs/ColumnLineageDatasetFacet"
DOCUMENTATION = "https://openlineage.io/spec/facets/1-0-1/DocumentationJobFacet.json#/$defs/DocumentationJobFacet"


def input_fields(doc):
    """(job, output, field, at, entry): an entry for each source of a mapping onto its own output.
    A target that two edges map has the sources of both."""
    ns = doc.datasets.select(F.col("name").alias("dataset"), F.coalesce("namespace", F.lit(doc.namespace)).alias("ns"))
    j = doc.column_edges.join(doc.edges.where("job is not null").select("edge_id", "job", F.col("to").alias("output")), "edge_id").where(F.col("to_column.dataset") == F.col("output"))
    kind = S.openlineage_transform(F.col("transform_type"))
    rows = j.select("job", "output", F.col("to_column.column").alias("field"), "edge_id", "ordinal", kind.alias("k"), S.display_function(F.col("function"), F.col("origin.source")).alias("description"), F.posexplode("from_columns").alias("p", "r"))
    step = F.struct(F.col("k.type").alias("type"), F.col("k.subtype").alias("subtype"), F.lit(False).alias("masking"), "description")
    entry = F.struct(F.coalesce("ns", F.lit(doc.namespace)).alias("namespace"), F.col("r.dataset").alias("name"), F.col("r.column").alias("field"), F.array(step).alias("transformations"))
    return rows.withColumn("dataset", F.col("r.dataset")).join(ns, "dataset", "left").select("job", "output", "field", F.struct("edge_id", "ordinal", "p").alias("at"), entry.alias("entry"))


def events(doc, producer: str = "tributary", time: str = "1970-01-01T00:00:00Z"):
    """(seq, event): JSON of each job's event."""
    listed = input_fields(doc).groupBy("job", "output", "field").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "entry"))), lambda x: x["entry"]).alias("inputFields"))
    fields = listed.groupBy("job", "output").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", F.struct("inputFields"))))).alias("fields"))
    ns = doc.datasets.select(F.col("name").alias("name"), F.coalesce("namespace", F.lit(doc.namespace)).alias("namespace"))
    jobs = doc.jobs.select("seq", "id", F.coalesce("namespace", F.lit(doc.namespace)).alias("job_ns"), "inputs", "outputs")

    def side(column: str):
        x = jobs.select("id", F.posexplode(column).alias("p", "name")).join(ns, "name", "left").withColumn("namespace", F.coalesce("namespace", F.lit(doc.namespace)))
        if column == "inputs":
            item = F.struct("namespace", "name")
        else:
            x = x.join(fields.select(F.col("job").alias("id"), F.col("output").alias("name"), "fields"), ["id", "name"], "left")
            facet = F.struct(F.lit(producer).alias("_producer"), F.lit(COLUMNS).alias("_schemaURL"), "fields")
            item = F.struct("namespace", "name", F.when(F.col("fields").isNotNull(), F.struct(facet.alias("columnLineage"))).alias("facets"))
        return x.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", F.struct(item.alias("i")).alias("x"))), lambda a, b: F.when(a["p"] < b["p"], -1).when(a["p"] > b["p"], 1).otherwise(0)), lambda v: v["x"]["i"]).alias(column + "_"))

    inferred = catalog.with_inferred(doc.edges, doc.column_edges).where("has_inferred and job is not null").select(F.col("job").alias("id")).distinct().withColumn("inferred", F.lit(True))
    j = jobs.join(side("inputs"), "id", "left").join(side("outputs"), "id", "left").join(inferred, "id", "left")
    note = F.struct(F.lit(producer).alias("_producer"), F.lit(DOCUMENTATION).alias("_schemaURL"), F.lit(S.INFERRED_NOTE).alias("description"))
    job = F.struct(F.col("job_ns").alias("namespace"), F.col("id").alias("name"), F.when(F.col("inferred"), F.struct(note.alias("documentation"))).alias("facets"))
    event = F.struct(
        F.lit("COMPLETE").alias("eventType"), F.lit(time).alias("eventTime"), F.lit(RUN_EVENT).alias("schemaURL"), F.lit(producer).alias("producer"), F.struct(S.run_id(F.col("id")).alias("runId")).alias("run"), job.alias("job"),
        F.col("inputs_").alias("inputs"), F.col("outputs_").alias("outputs"),
    )
    return j.select("seq", F.to_json(event).alias("event"))


def export(doc, producer: str | None = None, **_) -> Report:
    time = doc.head.get("generated_at") or "1970-01-01T00:00:00Z"
    found = [json.loads(r.event) for r in events(doc, producer or doc.head.get("producer") or "tributary", time).orderBy("seq").collect()]
    for e in found:
        e.setdefault("inputs", [])
        e.setdefault("outputs", [])
    return Report("openlineage", json.dumps(found, indent=2, ensure_ascii=False), [f"{len(found)} events"], sent=len(found))
