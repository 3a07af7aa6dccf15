"""Operators over the tables of a lineage document. First-seen order is always an explicit column.

Mappings are a table of their own, ``column_edges``, joined by edge_id; without it, edges have theirs
in order in an array ``mappings`` of the same members, and nothing is joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.scalars import is_inferred, last_segment, origin
from ..storage import spread


def _field(*names: str) -> list[Column]:
    return [F.col(f"`{n}`") for n in names]


def find_dataset(datasets: DataFrame, name: str) -> DataFrame:
    return datasets.where(F.col("name") == F.lit(name))


def effective_namespace(datasets: DataFrame, document: Column) -> DataFrame:
    return datasets.withColumn("effective_namespace", F.coalesce("namespace", document))


def upsert_datasets(rows: DataFrame) -> DataFrame:
    """One row per name of (seq, name, namespace, platform, fqn, schema, origin): the first value of
    each member, columns united in order, and a declared origin before an inferred one.

    All of it is one aggregation with map-side combine; a name's columns are deduplicated before
    they are listed, so the list is as long as the schema.
    """
    first = lambda c: F.min_by(F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("v"))), F.when(F.col(c).isNotNull(), F.col("seq")))["v"].alias(c)
    rank = F.struct(F.when(F.col("origin.source") == "declared", 0).otherwise(1).alias("r"), F.col("seq").alias("s"))
    merged = rows.groupBy("name").agg(F.min("seq").alias("seq"), *[first(c) for c in ("namespace", "platform", "fqn")], F.min_by("origin", rank).alias("origin"))
    fields = rows.select("name", "seq", F.posexplode("schema").alias("pos", "field")).groupBy("name", F.col("field.name").alias("column")).agg(F.min(F.struct("seq", "pos", "field")).alias("f"))
    schemas = fields.groupBy("name").agg(F.transform(F.array_sort(F.collect_list("f")), lambda f: f["field"]).alias("schema"))
    return merged.join(schemas, "name", "left").withColumn("schema", F.coalesce("schema", F.array().cast("array<struct<name:string,type:string,description:string>>")))


def merge_origins(rows: DataFrame, key: str) -> DataFrame:
    """Per key of (seq, origin): declared before inferred, then the higher confidence, then the first."""
    best = F.struct(F.when(F.col("origin.source") == "declared", 1).otherwise(0).alias("d"), F.coalesce("origin.confidence", F.lit(0.0)).alias("c"), (-F.col("seq")).alias("s"))
    return rows.groupBy(key).agg(F.max_by("origin", best).alias("origin"))


def derive_edges(jobs: DataFrame, edges: DataFrame) -> DataFrame:
    """(from, to, job, source) for each job's inputs x outputs that no edge has yet: the first job in
    order wins; inferred jobs make no self-loops."""
    pairs = jobs.select("seq", F.col("id").alias("job"), F.col("origin.source").alias("source"), F.posexplode("inputs").alias("i", "from"), "outputs")
    pairs = pairs.select("seq", "job", "source", "i", "from", F.posexplode("outputs").alias("o", "to"))
    pairs = pairs.where((F.col("from") != F.col("to")) | (F.col("source") == "declared"))
    # the place of a pair in its job is one number, as rows of pairs are nearly all that is exchanged
    place = (F.shiftleft(F.col("i").cast("bigint"), 31) + F.col("o")).alias("place")
    first = pairs.groupBy("from", "to").agg(F.min(F.struct("seq", place, "job", "source")).alias("f")).select("from", "to", "f.job", "f.source")
    return first.join(edges.select("from", "to").distinct(), ["from", "to"], "left_anti")


def upstream_of(edges: DataFrame, target: str) -> DataFrame:
    return edges.where(F.col("to") == F.lit(target)).select(F.col("from").alias("dataset"))


def downstream_of(edges: DataFrame, source: str) -> DataFrame:
    return edges.where(F.col("from") == F.lit(source)).select(F.col("to").alias("dataset"))


def observed_columns(edges: DataFrame, column_edges: DataFrame | None) -> DataFrame:
    """(dataset, column, at) that mappings of real edges name, at their first place: targets before sources."""
    real = edges.where(~F.col("column_discovery"))
    real = real.select("edge_id", F.explode("mappings").alias("m")).select("edge_id", "m.*") if column_edges is None else column_edges.join(real.select("edge_id"), "edge_id", "left_semi")
    at = lambda k, p: F.struct(F.col("edge_id").alias("e"), F.col("ordinal").alias("o"), F.lit(k).alias("k"), p.alias("p"))
    to = real.select("to_column.dataset", "to_column.column", at(0, F.lit(0)).alias("at"))
    source = real.select("edge_id", "ordinal", F.posexplode("from_columns").alias("p", "r")).select("r.dataset", "r.column", at(1, F.col("p")).alias("at"))
    return to.union(source).groupBy("dataset", "column").agg(F.min("at").alias("at"))


def backfill_schemas(datasets: DataFrame, edges: DataFrame, column_edges: DataFrame | None = None) -> DataFrame:
    """Datasets whose schemas also hold the columns that mappings name, in first-seen order."""
    known = datasets.select(F.col("name").alias("dataset"), F.explode("schema").alias("f")).select("dataset", F.col("f.name").alias("column"))
    new = observed_columns(edges, column_edges).join(known, ["dataset", "column"], "left_anti")
    # as long as one dataset's own list of columns
    added = new.groupBy(F.col("dataset").alias("name")).agg(F.array_sort(F.collect_list(F.struct("at", "column"))).alias("new"))
    field = lambda x: F.struct(x["column"].alias("name"), F.lit(None).cast("string").alias("type"), F.lit(None).cast("string").alias("description"))
    return datasets.join(added, "name", "left").withColumn("schema", F.when(F.col("new").isNull(), F.col("schema")).otherwise(F.concat("schema", F.transform("new", field)))).drop("new")


def fill_same_names(datasets: DataFrame, edges: DataFrame, column_edges: DataFrame) -> DataFrame:
    """(edge_id, from, to, column): identity mappings for target columns that an edge doesn't map and
    that its source has too. Equi-joins and an anti-join; edges of column discovery are left alone."""
    columns = datasets.select(F.col("name").alias("dataset"), F.explode("schema").alias("f")).select("dataset", F.col("f.name").alias("column")).distinct()
    real = edges.where(~F.col("column_discovery")).select("edge_id", "from", "to")
    shared = real.join(columns.withColumnRenamed("dataset", "to"), "to").join(columns.withColumnRenamed("dataset", "from"), ["from", "column"])
    mapped = column_edges.select("edge_id", F.col("to_column.column").alias("column"))
    return shared.join(mapped, ["edge_id", "column"], "left_anti").select("edge_id", "from", "to", "column")


def missing_lineage(edges: DataFrame, column_edges: DataFrame | None, jobs: DataFrame) -> DataFrame:
    """Edges without any mapping and without a note of their declaration: a warning at their job."""
    bare = edges.where(F.col("origin.note").isNull() & ~F.col("column_discovery"))
    bare = bare.where(F.coalesce(F.size("mappings"), F.lit(0)) <= 0) if column_edges is None else bare.join(column_edges.select("edge_id"), "edge_id", "left_anti")
    at = jobs.select(F.col("id").alias("job"), "location").dropDuplicates(["job"])
    message = F.concat(F.lit("no column lineage for "), last_segment(F.col("from")), F.lit(" -> "), last_segment(F.col("to")))
    return bare.join(at, "job", "left").select("edge_id", F.lit("warn").alias("level"), F.lit("W_NO_COLUMN_LINEAGE").alias("code"), message.alias("message"), "location")


def with_inferred(edges: DataFrame, column_edges: DataFrame | None = None) -> DataFrame:
    """Edges with ``has_inferred``: their origin or that of any of their mappings is inferred."""
    if column_edges is None:
        return edges.withColumn("has_inferred", is_inferred(F.col("origin.source")) | F.coalesce(F.exists("mappings", lambda m: is_inferred(m["origin"]["source"])), F.lit(False)))
    some = column_edges.groupBy("edge_id").agg(F.max(is_inferred(F.col("origin.source")).cast("int")).alias("m"))
    return edges.join(some, "edge_id", "left").withColumn("has_inferred", is_inferred(F.col("origin.source")) | (F.coalesce("m", F.lit(0)) == 1)).drop("m")


def distribute(mappings: DataFrame, inputs: DataFrame) -> DataFrame:
    """(job, ordinal, target, input): a mapping goes to each input that one of its sources is on, and
    one without sources to the job's first input. ``mappings``: job, ordinal, target, from_columns;
    ``inputs``: job, pos, input."""
    placed = mappings.select("job", "ordinal", "target", F.explode(F.array_distinct(F.transform("from_columns", lambda r: r["dataset"]))).alias("input")).join(inputs.select("job", "input").distinct(), ["job", "input"])
    first = inputs.groupBy("job").agg(F.min_by("input", F.struct("pos", "input")).alias("input"))
    loose = mappings.where(F.size("from_columns") == 0).select("job", "ordinal", "target").join(first, "job")
    return placed.select("job", "ordinal", "target", "input").unionByName(loose)


def attribute(helpers: DataFrame, jobs: DataFrame) -> DataFrame:
    """Columns found in a helper, on the outputs of the job that calls it: (job, target, dataset,
    attributed). ``helpers``: job, output_table, target. A column is the job's if it has one output,
    or where the table is the output's last segment; else ``dataset`` is the table itself."""
    known = jobs.select(F.col("id").alias("job"), "outputs")
    j = helpers.join(known, "job", "left")
    hit = F.filter(F.coalesce("outputs", F.array().cast("array<string>")), lambda o: (F.substring_index(o, ".", -1) == F.col("output_table")) | (o == F.col("output_table")))
    place = F.when(F.size("outputs") == 1, F.element_at("outputs", 1)).otherwise(F.get(hit, F.lit(0)))
    return j.select("job", "target", F.coalesce(place, F.col("output_table")).alias("dataset"), place.isNotNull().alias("attributed"))


def discovery_edges(leftovers: DataFrame) -> DataFrame:
    """(from, to, job, n_mappings): an edge for each table pair that carries at least one leftover
    mapping (job, output_table, target, source_tables). Flagged as found by column discovery."""
    pairs = leftovers.select("job", "target", F.col("output_table").alias("to"), F.explode(F.array_distinct("source_tables")).alias("from"))
    # spread first: one exchange, and no task collects all groups of a large split in its memory
    return spread(pairs, "from", "to", "job").groupBy("from", "to", "job").agg(F.countDistinct("target").alias("n_mappings"), F.lit(True).alias("column_discovery"))


def _tier() -> Column:
    return F.when(F.col("source") == "declared", 0).when(F.col("source") == "inferred_sql", 1).otherwise(2)


def by_precedence(mappings: DataFrame) -> DataFrame:
    """Of (edge, target, source, seq, …): declared ones all stay; of the others the first by SQL, then
    code, and only where the target isn't declared."""
    w = W.partitionBy("edge", "target").orderBy(_tier(), "seq")
    ranked = mappings.withColumn("k", F.row_number().over(w)).withColumn("first_tier", F.min(_tier()).over(W.partitionBy("edge", "target")))
    return ranked.where((F.col("k") == 1) | ((F.col("first_tier") == 0) & (F.col("source") == "declared"))).drop("k", "first_tier")


def match_input(inputs: Column, table: Column) -> Column:
    """The first input that is the table, by its whole name or last segment; else null."""
    return F.get(F.filter(inputs, lambda i: (F.substring_index(i, ".", -1) == table) | (i == table)), F.lit(0))


def resolve_source(inputs: Column, ref: Column) -> Column:
    """``table.column`` or ``column`` -> the dataset it is on and its column: a table that isn't among
    the inputs, or none, means the first input."""
    dotted = F.contains(ref, F.lit("."))
    column = F.when(dotted, F.substring_index(ref, ".", -1)).otherwise(ref)
    table = F.when(dotted, F.regexp_replace(ref, r"\.[^.]*$", ""))
    return F.struct(F.coalesce(match_input(inputs, table), F.get(inputs, F.lit(0))).alias("dataset"), column.alias("column"))


def structural_origin(jobs: DataFrame) -> DataFrame:
    """Origins of tasks: ``discovered`` ones by their engine, annotated ones declared with a note."""
    sql = F.col("engine") == "sql"
    found = origin(F.when(sql, "inferred_sql").otherwise("inferred_code"), F.when(sql, 0.85).otherwise(0.7), "discovered from operators")
    noted = origin(F.lit("declared"), None, "annotation")
    return jobs.withColumn("origin", F.when(F.col("discovered"), found).when(F.col("annotated"), noted).otherwise(origin(F.lit("declared"), None)))
