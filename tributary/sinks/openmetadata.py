"""Lineage requests for a metadata catalogue: bodies by Spark, and a driver-side client that is off by default."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import catalog, graph
from .report import Report

RETRIED = {429, 500, 502, 503, 504}


def bodies(doc, service: str | None = None):
    """(rank, edge_id, from, to, skip, body): a request for each edge, or why there is none."""
    d = doc.datasets.select("name", S.fqn_parts(F.coalesce("fqn", "name")).alias("parts")).dropDuplicates(["name"])
    known = lambda side: d.select(F.col("name").alias(side), F.lit(True).alias(f"{side}_known"), F.when(F.col("parts").isNotNull(), S.service_override(F.col("parts"), service)).alias(f"{side}_fqn"))
    maps = doc.column_edges.groupBy("edge_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", F.struct("from_columns", "to_column", "function", "origin").alias("m")))), lambda x: x["m"]).alias("maps"))
    e = graph.topological(catalog.with_inferred(doc.edges, doc.column_edges)).join(maps, "edge_id", "left").join(known("from"), "from", "left").join(known("to"), "to", "left")
    skip = F.when(F.col("from_known").isNull() | F.col("to_known").isNull(), "dataset not found").when(F.col("from_fqn").isNull() | F.col("to_fqn").isNull(), "no four-part name")
    entity = lambda c: F.struct(F.lit("table").alias("type"), F.col(c).alias("fullyQualifiedName"))
    none = F.array().cast("array<struct<fromColumns:array<string>,toColumn:string,function:string>>")
    details = F.struct(
        F.coalesce(S.columns_lineage(F.col("from_fqn"), F.col("to_fqn"), F.col("from"), F.col("maps")), none).alias("columnsLineage"), S.edge_description(F.col("transform.description"), F.col("has_inferred")).alias("description"), F.col("transform.sql").alias("sqlQuery")
    )
    body = F.to_json(F.struct(F.struct(entity("from_fqn").alias("fromEntity"), entity("to_fqn").alias("toEntity"), details.alias("lineageDetails")).alias("edge")))
    return e.select("rank", "edge_id", F.coalesce("from_fqn", "from").alias("from"), F.coalesce("to_fqn", "to").alias("to"), skip.alias("skip"), F.when(skip.isNull(), body).alias("body"))


def send(method: str, url: str, token: str, body: str | None, timeout: float) -> tuple[int, str]:
    request = urllib.request.Request(url, None if body is None else body.encode(), {"Authorization": f"Bearer {token}", "Content-Type": "application/json"}, method=method)
    try:
        with urllib.request.urlopen(request, timeout=timeout) as r:
            return r.status, r.read().decode()
    except urllib.error.HTTPError as e:
        return e.code, e.read().decode(errors="replace")


def retried(call: Callable[[], tuple[int, str]], retries: int, wait: Callable[[float], None] = time.sleep) -> tuple[int, str]:
    """A call again after passing failures, with pauses that double up to eight seconds."""
    for n in range(retries + 1):
        try:
            status, text = call()
        except OSError as e:
            status, text = 0, str(e)
        if status not in RETRIED | {0} or n == retries:
            return status, text
        wait(min(8.0, 0.2 * 2**n))
    return 0, ""


def export(doc, dry_run: bool = True, host: str | None = None, token: str | None = None, service: str | None = None, timeout: float = 30, retries: int = 3, transport=send, wait=time.sleep, **_) -> Report:
    """Without a host and token, or with ``dry_run``, nothing is sent."""
    rows = bodies(doc, service).orderBy("rank", "edge_id").collect()
    live = not dry_run and host and token
    report, out, ids = Report("openmetadata", ""), [], {}

    def table_id(fqn: str) -> str | None:
        if fqn not in ids:
            status, text = retried(lambda: transport("GET", f"{host}/v1/tables/name/{urllib.parse.quote(fqn, safe='')}", token, None, timeout), retries, wait)
            ids[fqn] = json.loads(text).get("id") if status == 200 else None
        return ids[fqn]

    for r in rows:
        if r["skip"]:
            report.actions.append(f"skip {r['from']} -> {r['to']}: {r['skip']}")
            report.skipped += 1
            continue
        body = json.loads(r["body"])
        out.append(body)
        if not live:
            report.actions.append(f"would PUT {r['from']} -> {r['to']}")
            continue
        a, b = table_id(r["from"]), table_id(r["to"])
        if a is None or b is None:
            report.actions.append(f"failed {r['from']} -> {r['to']}: table unknown to the catalogue")
            report.failed += 1
            continue
        body["edge"]["fromEntity"], body["edge"]["toEntity"] = {"type": "table", "id": a}, {"type": "table", "id": b}
        status, text = retried(lambda body=body: transport("PUT", f"{host}/v1/lineage", token, json.dumps(body), timeout), retries, wait)
        if 200 <= status < 300:
            report.sent += 1
            report.actions.append(f"PUT {r['from']} -> {r['to']}")
        else:
            report.failed += 1
            report.actions.append(f"failed {r['from']} -> {r['to']}: {status} {text[:200]}")
    report.artifact = json.dumps(out, indent=2, ensure_ascii=False)
    return report
