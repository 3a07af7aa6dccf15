"""Coverage metrics of a document, by DAG and in all, and their check against thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import ratio

COUNTERS = ("tasks_total", "tasks_with_lineage", "tasks_annotated", "edges_total", "high_confidence_edges", "column_edges", "column_mappings")


def _by_dag(jobs: DataFrame, edges: DataFrame, mappings: DataFrame | None) -> DataFrame:
    """Seven counters per DAG. ``edges``: edge_id, job, source, column_discovery; ``mappings``: edge_id,
    or None where edges have their number in n_mappings. Only mappings of discovery edges count.

    Jobs and edges are counted apart, each with map-side combine, and meet in a full join: an edge
    whose job is unknown counts for the DAG ``default``, which may have no jobs.
    """
    linked = edges.select(F.col("job").alias("id")).where("id is not null").distinct().withColumn("linked", F.lit(1))
    per_job = jobs.join(linked, "id", "left").groupBy("dag").agg(
        F.count("*").alias("tasks_total"), F.count("linked").alias("tasks_with_lineage"), F.count_if(F.col("source") == "declared").alias("tasks_annotated")
    )
    dag_of = jobs.groupBy("id").agg(F.min("dag").alias("dag"))
    if mappings is not None:
        edges = edges.join(mappings.groupBy("edge_id").agg(F.count("*").alias("n_mappings")), "edge_id", "left")
    e = edges.join(dag_of.withColumnRenamed("id", "job"), "job", "left").withColumn("dag", F.coalesce("dag", F.lit("default")))
    real = ~F.col("column_discovery")
    counted = e.groupBy("dag").agg(
        F.count_if(real).alias("edges_total"), F.count_if(real & (F.col("source") == "declared")).alias("high_confidence_edges"), F.count_if(F.col("column_discovery")).alias("column_edges"),
        F.sum(F.when(F.col("column_discovery"), F.col("n_mappings"))).alias("column_mappings"),
    )
    both = per_job.join(counted, "dag", "full")
    return both.select("dag", *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in COUNTERS])


def _ratios() -> list[Column]:
    c = F.col
    return [
        ratio(c("tasks_with_lineage"), c("tasks_total"), 0.0).alias("task_coverage"),
        ratio(c("tasks_annotated"), c("tasks_total"), 0.0).alias("annotation_coverage"),
        ratio(c("high_confidence_edges"), c("edges_total"), 1.0).alias("high_confidence_fraction"),
    ]


def metrics_by_dag(jobs: DataFrame, edges: DataFrame, mappings: DataFrame | None = None) -> DataFrame:
    return _by_dag(jobs, edges, mappings).select("*", *_ratios())


def metrics(jobs: DataFrame, edges: DataFrame, mappings: DataFrame | None = None) -> DataFrame:
    """The same over all DAGs, in one row; an empty document has coverage 0 and confidence 1."""
    total = _by_dag(jobs, edges, mappings).agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in COUNTERS])
    return total.select("*", *_ratios())


def verdict(total: DataFrame, min_coverage: float = 0.0, min_annotation: float = 0.0, min_high_confidence: float = 0.0) -> DataFrame:
    """One row per check: actual value, threshold, and whether it is reached."""
    checks = (("task_coverage", min_coverage), ("annotation_coverage", min_annotation), ("high_confidence_fraction", min_high_confidence))
    rows = F.array(*[F.struct(F.lit(k).alias("check"), F.col(k).alias("actual"), F.lit(float(v)).alias("threshold"), (F.col(k) >= v).alias("passed")) for k, v in checks])
    return total.select(F.explode(rows).alias("c")).select("c.*")
