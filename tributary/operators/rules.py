"""Validation: every rule is an anti-join, a window or a filter that yields diagnostic rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

_COLUMNS = ("level", "code", "subject")


def _row(df: DataFrame, level: str, code: str, subject) -> DataFrame:
    return df.select(F.lit(level).alias("level"), F.lit(code).alias("code"), subject.alias("subject"))


def duplicate_datasets(datasets: DataFrame) -> DataFrame:
    """Each repeat of a name: n - 1 rows. Counts meet in an aggregation, so a hot name is no hot task."""
    again = datasets.groupBy("name").count().where("count > 1")
    return _row(again.select("name", F.explode(F.sequence(F.lit(2), F.col("count")))), "error", "E_DUP_DATASET", F.col("name"))


def _each(counted: DataFrame) -> DataFrame:
    """Diagnostics with ``times`` as that many rows."""
    return counted.select(*_COLUMNS, F.explode(F.sequence(F.lit(1).cast("bigint"), "times"))).select(*_COLUMNS)


def _counted(df: DataFrame, level: str, code: str, subject) -> DataFrame:
    return df.groupBy(subject.alias("subject")).agg(F.sum("times").alias("times")).select(F.lit(level).alias("level"), F.lit(code).alias("code"), "subject", "times")


def _unknown_names(names: DataFrame, datasets: DataFrame, level: str, code: str) -> DataFrame:
    # counted within tasks first: what is joined is as long as the list of names, however often each is used
    used = names.groupBy("name").agg(F.count("*").alias("times"))
    return _counted(used.join(datasets.select("name").distinct(), "name", "left_anti"), level, code, F.col("name"))


def count_unknown_endpoints(edges: DataFrame, datasets: DataFrame) -> DataFrame:
    """``unknown_endpoints`` with the number of their ``times``, a row each."""
    return _unknown_names(edges.select(F.explode(F.array("from", "to")).alias("name")), datasets, "error", "E_UNKNOWN_DATASET")


def unknown_endpoints(edges: DataFrame, datasets: DataFrame) -> DataFrame:
    return _each(count_unknown_endpoints(edges, datasets))


def misplaced_columns(edges: DataFrame, column_edges: DataFrame | None = None) -> DataFrame:
    """References that aren't on their edge's ends: a target elsewhere, and each mapping with a source
    elsewhere. Mappings are in ``column_edges`` or, without it, in the edges' own array ``mappings``."""
    ref = lambda r: F.concat_ws(".", r["dataset"], r["column"])
    if column_edges is None:
        targets = F.filter(F.transform("mappings", lambda m: m["to_column"]), lambda r: r["dataset"] != F.col("to"))
        sources = F.filter(F.flatten(F.transform("mappings", lambda m: F.coalesce(m["from_columns"], F.array().cast("array<struct<dataset:string,column:string>>")))), lambda r: r["dataset"] != F.col("from"))
        return _row(edges.select(F.explode(F.concat(F.transform(targets, ref), F.transform(sources, ref))).alias("s")), "warn", "W_COLUMN_ENDPOINT", F.col("s"))
    j = column_edges.join(edges.select("edge_id", "from", "to"), "edge_id")
    target = _row(j.where(F.col("to_column.dataset") != F.col("to")), "warn", "W_COLUMN_ENDPOINT", ref(F.col("to_column")))
    source = j.select("from", F.explode("from_columns").alias("r")).where(F.col("r.dataset") != F.col("from"))
    return target.union(_row(source, "warn", "W_COLUMN_ENDPOINT", ref(F.col("r"))))


def count_unknown_columns(column_edges: DataFrame, datasets: DataFrame) -> DataFrame:
    """``unknown_columns`` with the number of their ``times``, a row each."""
    refs = column_edges.select(F.explode(F.concat(F.array("to_column"), "from_columns")).alias("r")).select("r.dataset", "r.column")
    # counted within tasks first: what is joined is as long as the list of columns, however often each is used
    used = refs.groupBy("dataset", "column").agg(F.count("*").alias("times"))
    schemas = datasets.where(F.size("schema") > 0).select(F.col("name").alias("dataset"), "schema").dropDuplicates(["dataset"])
    j = used.join(schemas, "dataset").where(~F.exists("schema", lambda f: f["name"] == F.col("column")))
    return _counted(j, "warn", "W_UNKNOWN_COLUMN", F.concat_ws(".", "dataset", "column"))


def unknown_columns(column_edges: DataFrame, datasets: DataFrame) -> DataFrame:
    """References to a known dataset with a schema that lacks the column."""
    return _each(count_unknown_columns(column_edges, datasets))


def count_undeclared_io(jobs: DataFrame, datasets: DataFrame) -> DataFrame:
    """``undeclared_io`` with the number of their ``times``, a row each."""
    return _unknown_names(jobs.select(F.explode(F.concat("inputs", "outputs")).alias("name")), datasets, "warn", "W_JOB_DATASET")


def undeclared_io(jobs: DataFrame, datasets: DataFrame) -> DataFrame:
    return _each(count_undeclared_io(jobs, datasets))


def missing_io(jobs: DataFrame) -> DataFrame:
    bare = jobs.where(~F.col("annotated") & ((F.size("inputs") == 0) | (F.size("outputs") == 0)))
    return _row(bare, "error", "E_MISSING_IO", F.col("id"))


def bad_names(jobs: DataFrame) -> DataFrame:
    """Each use of a dataset whose name hasn't four parts, but for annotated jobs."""
    io = jobs.where(~F.col("annotated")).select(F.explode(F.concat("inputs", "outputs")).alias("name"))
    return _row(io.where(F.size(F.split("name", r"\.", -1)) != 4), "warn", "W_BAD_FQN", F.col("name"))


def sql_not_parsed(jobs: DataFrame) -> DataFrame:
    return _row(jobs.where(F.col("sql").isNotNull() & (F.col("engine") != "sql")), "warn", "W_SQL_NOT_PARSED", F.col("id"))


def opaque_columns(notes: DataFrame, targets: DataFrame) -> DataFrame:
    """Notes (job, detail) unless a declared target of the job stands quoted in them."""
    listed = targets.groupBy("job").agg(F.collect_set("target").alias("targets"))
    j = notes.join(listed, "job", "left")
    covered = F.exists(F.coalesce("targets", F.array().cast("array<string>")), lambda t: F.contains(F.col("detail"), F.concat(F.lit('"'), t, F.lit('"'))))
    return _row(j.where(~covered), "warn", "W_OPAQUE_COLUMN", F.col("detail"))


def validate(datasets: DataFrame, jobs: DataFrame, edges: DataFrame, column_edges: DataFrame) -> DataFrame:
    """All rules of a finished document."""
    out = duplicate_datasets(datasets)
    for more in (unknown_endpoints(edges, datasets), misplaced_columns(edges, column_edges), unknown_columns(column_edges, datasets), undeclared_io(jobs, datasets)):
        out = out.union(more)
    return out


def has_errors(diagnostics: DataFrame) -> DataFrame:
    return diagnostics.agg(F.coalesce(F.max((F.col("level") == "error").cast("int")), F.lit(0)).cast("boolean").alias("has_errors"))


def numbered(diagnostics: DataFrame) -> DataFrame:
    """A repeat's number among equal rows."""
    return diagnostics.withColumn("n", F.row_number().over(W.partitionBy(*_COLUMNS).orderBy(F.lit(1))))
