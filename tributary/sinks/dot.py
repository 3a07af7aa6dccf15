"""Graphviz: nodes in order, edges in topological order; the lines are built by Spark expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import catalog, graph
from .report import Report


def lines(doc):
    """(nodes, edges): DataFrames of a line each, with their order."""
    quoted = lambda c: F.concat(F.lit('"'), S.dot_escape(F.col(c)), F.lit('"'))
    label = F.concat(F.lit('"'), S.dot_escape(S.last_segment(F.col("name"))), F.lit('"'))
    nodes = doc.datasets.select("seq", F.concat(F.lit("  "), quoted("name"), F.lit(" [label="), label, F.lit(", tooltip="), quoted("name"), F.lit(', fillcolor="'), S.platform_color(F.col("platform")), F.lit('"];')).alias("line"))
    e = graph.topological(catalog.with_inferred(doc.edges, doc.column_edges))
    style = F.when(F.col("has_inferred"), "style=dashed, color=orange").otherwise("style=solid, color=black")
    kind = S.dot_escape(F.coalesce("transform.kind", F.lit("")))
    return nodes, e.select("rank", "edge_id", F.concat(F.lit("  "), quoted("from"), F.lit(" -> "), quoted("to"), F.lit(' [label="'), kind, F.lit('", '), style, F.lit("];")).alias("line"))


def export(doc, **_) -> Report:
    nodes, edges = lines(doc)
    a = [r.line for r in nodes.orderBy("seq").select("line").collect()]
    b = [r.line for r in edges.orderBy("rank", "edge_id").select("line").collect()]
    head = ["digraph lineage {", "  rankdir=LR;", '  node [shape=box, style="rounded,filled", fontname="Helvetica"];', '  edge [fontname="Helvetica"];']
    return Report("dot", "\n".join([*head, *a, *b, "}", ""]), [f"{len(a)} nodes, {len(b)} edges"])
