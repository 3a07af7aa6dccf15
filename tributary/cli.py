"""Command line: scan, validate, export, graph and gate."""

from __future__ import annotations

import argparse
import json
import os
import sys
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import sinks
from .operators import gate, rules
from .sources import scan as S
from .tables import Document


def session() -> SparkSession:
    spark = SparkSession.builder.appName("tributary").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _emit(text: str, path: str | None) -> None:
    if path:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_text(text)
    else:
        print(text)


def _diagnostics(rows) -> int:
    """Prints them and their number to stderr; how many are errors."""
    found = rows.select("level", "code", "message").collect()
    for r in found:
        print(f"[{r.level.capitalize()}] {r.code}: {r.message}", file=sys.stderr)
    errors = sum(r.level == "error" for r in found)
    print(f"{errors} errors, {len(found) - errors} warnings", file=sys.stderr)
    return errors


def _invalid(doc: Document):
    return rules.validate(doc.datasets, doc.jobs, doc.edges, doc.column_edges).withColumnRenamed("subject", "message")


def token(args) -> str | None:
    """From a file, else the option, else the environment."""
    if args.token_file:
        return Path(args.token_file).read_text().strip()
    return args.token or os.environ.get("CATALOG_TOKEN")


def threshold(option: float | None, variable: str) -> float:
    if option is not None:
        return option
    text = os.environ.get(variable)
    return float(text) if text else 0.0


def cmd_scan(args) -> int:
    options = S.Options(args.namespace, args.service, args.database, args.schema, not args.no_infer_code, not args.compat)
    doc = S.scan_path(session(), args.path, options)
    doc.head["generated_at"] = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    _emit(doc.write(None), args.out)
    return int(bool(_diagnostics(doc.diagnostics)) and args.strict)


def cmd_validate(args) -> int:
    return int(bool(_diagnostics(_invalid(Document.read(session(), args.document)))))


def cmd_export(args) -> int:
    doc = Document.read(session(), args.document)
    try:
        report = sinks.export(doc, args.to, dry_run=not args.live, host=args.host, token=token(args), service=args.service, producer=args.producer, timeout=args.timeout, retries=args.retries)
    except KeyError as e:
        print(e.args[0], file=sys.stderr)
        return 2
    for a in report.actions:
        print(a, file=sys.stderr)
    _emit(report.artifact, args.out)
    return int(args.fail_on_partial and (report.failed > 0 or report.skipped > 0))


def cmd_graph(args) -> int:
    _emit(sinks.export(Document.read(session(), args.document), "dot").artifact, args.out)
    return 0


def cmd_gate(args) -> int:
    try:
        limits = [threshold(o, v) for o, v in ((args.min_coverage, "GATE_MIN_COVERAGE"), (args.min_annotation_coverage, "GATE_MIN_ANNOTATION_COVERAGE"), (args.min_high_confidence, "GATE_MIN_HIGH_CONFIDENCE"))]
    except ValueError as e:
        print(f"bad threshold: {e}", file=sys.stderr)
        return 2
    path, made = args.repo_path, None
    try:
        if args.git_ref:
            try:
                path = made = S.git_snapshot(session(), args.repo_path, args.git_ref)
            except Exception as e:
                print(f"no snapshot of {args.git_ref}: {e}", file=sys.stderr)
                return 2
        if not made and not os.path.exists(path):
            print(f"no such path: {path}", file=sys.stderr)
            return 2
        doc = S.scan_path(session(), path)
        jobs = doc.jobs.select("id", "dag", F.col("origin.source").alias("source"))
        edges = doc.edges.select("edge_id", "job", F.col("origin.source").alias("source"), "column_discovery")
        total = gate.metrics(jobs, edges, doc.column_edges.select("edge_id"))
        row = total.first().asDict()
        checks = [r.asDict() for r in gate.verdict(total, *limits).collect()]
        dags = [r.asDict() for r in gate.metrics_by_dag(jobs, edges, doc.column_edges.select("edge_id")).orderBy("dag").collect()]  # a row a DAG
    finally:
        if made:
            S.remove(session(), made)
    passed = all(c["passed"] for c in checks)
    mark = lambda ok: "PASS" if ok else "FAIL"
    if args.json or args.format == "json":
        named = {"min_" + c["check"].removesuffix("_fraction"): c["threshold"] for c in checks}
        print(json.dumps(row | {"thresholds": named, "checks": {c["check"]: c["passed"] for c in checks}, "passed": passed, "per_dag": dags}, indent=2))
        return int(not passed)
    for k, v in row.items():
        print(f"  {k:25} {v:.3f}" if isinstance(v, float) else f"  {k:25} {v}")
    for d in dags:
        shares = ", ".join(f"{k} {d[k]:.3f}" for k in ("task_coverage", "annotation_coverage", "high_confidence_fraction"))
        print(f"    {d['dag']}: {shares} of {d['tasks_total']} tasks and {d['edges_total']} edges; {d['column_edges']} column edges, {d['column_mappings']} mappings")
    for c in checks:
        print(f"  [{mark(c['passed'])}] {c['check']} {c['actual']:.3f} >= {c['threshold']:.3f} (min)")
        if not c["passed"]:
            print(f"gate failed: {c['check']} {c['actual']:.3f} < min {c['threshold']:.3f}", file=sys.stderr)
    print(f"gate: {mark(passed)}")
    return int(not passed)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tributary", description=__doc__)
    sub = p.add_subparsers(required=True)
    a = sub.add_parser("scan")
    a.add_argument("path")
    a.add_argument("--out")
    a.add_argument("--namespace", default="default")
    for o in ("--service", "--database", "--schema"):
        a.add_argument(o)
    for o in ("--strict", "--no-infer-code", "--compat"):
        a.add_argument(o, action="store_true")
    a.set_defaults(run=cmd_scan)
    a = sub.add_parser("validate")
    a.add_argument("document")
    a.set_defaults(run=cmd_validate)
    a = sub.add_parser("export")
    a.add_argument("document")
    a.add_argument("--to", required=True)
    for o in ("--out", "--host", "--token", "--token-file", "--service", "--producer"):
        a.add_argument(o)
    a.add_argument("--timeout", type=float, default=30)
    a.add_argument("--retries", type=int, default=3)
    for o in ("--live", "--fail-on-partial"):
        a.add_argument(o, action="store_true")
    a.set_defaults(run=cmd_export)
    a = sub.add_parser("graph")
    a.add_argument("document")
    a.add_argument("--out")
    a.set_defaults(run=cmd_graph)
    a = sub.add_parser("gate")
    a.add_argument("--repo-path", default=".")
    a.add_argument("--git-ref")
    a.add_argument("--json", action="store_true")
    a.add_argument("--format", choices=("text", "json"), default="text")
    a.add_argument("--min-task-coverage", "--min-coverage", dest="min_coverage", type=float)
    for o in ("--min-annotation-coverage", "--min-high-confidence"):
        a.add_argument(o, type=float)
    a.set_defaults(run=cmd_gate)
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    return args.run(args)
