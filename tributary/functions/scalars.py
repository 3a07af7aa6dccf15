"""Scalar functions as built-in Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = ["fqn_parts", "table_fqn", "column_fqn", "last_segment", "percent_encode", "dot_escape", "run_id", "platform_color", "annotate", "display_function", "engine_of", "openlineage_transform", "edge_description", "rfc3339", "collapse", "shorten", "classify_label", "expand_fqn", "service_override", "columns_lineage", "ratio", "origin", "is_inferred"]

_NULL = "cast(null as string)"


def fqn_parts(name: Column) -> Column:
    """service, database, schema and table of a name of exactly four parts; else null."""
    p = F.split(name, r"\.", -1)
    whole = (F.size(p) == 4) & ~F.exists(p, lambda x: x == "")
    return F.when(whole, F.struct(p[0].alias("service"), p[1].alias("database"), p[2].alias("schema"), p[3].alias("table")))


def table_fqn(parts: Column) -> Column:
    return F.concat_ws(".", parts["service"], parts["database"], parts["schema"], parts["table"])


def column_fqn(parts: Column, column: Column) -> Column:
    return F.concat_ws(".", table_fqn(parts), column)


def last_segment(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def percent_encode(text: Column) -> Column:
    """RFC 3986: all bytes but the unreserved ones. Spark's function encodes forms, so three signs differ."""
    return F.replace(F.replace(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def dot_escape(text: Column) -> Column:
    out = text
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def _fnv(bytes_: Column, seed: Column) -> Column:
    """FNV-1a of 64 bits in two halves of 32, so that no product overflows: the prime is 2**40 + 0x1B3."""
    mask = F.lit(0xFFFFFFFF).cast("bigint")

    def step(acc: Column, b: Column) -> Column:
        low = acc["l"].bitwiseXOR(b)
        wide = low * F.lit(0x1B3)
        high = (acc["h"] * F.lit(0x1B3) + F.shiftright(wide, 32) + F.shiftleft(low, 8)).bitwiseAND(mask)
        return F.struct(high.alias("h"), wide.bitwiseAND(mask).alias("l"))

    return F.aggregate(bytes_, seed, step)


def run_id(text: Column) -> Column:
    """A deterministic id of 32 hexadecimal digits as 8-4-4-4-12: the text hashed from the usual
    offset, and again from that result."""
    hexes = F.hex(F.encode(text, "UTF-8"))
    n = (F.length(hexes) / 2).cast("int")
    at = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: i < n)
    bytes_ = F.transform(at, lambda i: F.conv(F.substring(hexes, i * 2 + 1, F.lit(2)), 16, 10).cast("bigint"))
    first = _fnv(bytes_, F.struct(F.lit(0xCBF29CE4).cast("bigint").alias("h"), F.lit(0x84222325).cast("bigint").alias("l")))
    second = _fnv(bytes_, first)
    pad = lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))
    both = F.concat(*[pad(x[k]) for x in (first, second) for k in ("h", "l")])
    cut = lambda i, n: F.substring(both, i, n)
    return F.concat_ws("-", cut(1, 8), cut(9, 4), cut(13, 4), cut(17, 4), cut(21, 12))


_COLORS = {"postgres": "#cfe2f3", "postgresql": "#cfe2f3", "delta": "#d9ead3", "deltalake": "#d9ead3", "s3": "#fff2cc", "kafka": "#f4cccc", "snowflake": "#d0e0e3", "mysql": "#fce5cd"}


def platform_color(platform: Column) -> Column:
    """A node's fill: white without a platform, grey for one that isn't known."""
    out = F.when(platform.isNull(), "#ffffff")
    for name, color in _COLORS.items():
        out = out.when(F.lower(platform) == name, color)
    return out.otherwise("#eeeeee")


def is_inferred(source: Column) -> Column:
    return F.coalesce(source != "declared", F.lit(False))


def annotate(label: Column, source: Column) -> Column:
    """A label with the way it was inferred."""
    suffix = F.when(source == "inferred_sql", "(inferred from SQL)").when(source == "inferred_code", "(inferred from code)")
    return F.when(suffix.isNull(), label).when(label.isNull() | (label == ""), suffix).otherwise(F.concat(label, F.lit(" "), suffix))


def display_function(function: Column, source: Column) -> Column:
    return F.when(is_inferred(source), annotate(function, source)).otherwise(function)


def engine_of(text: Column) -> Column:
    t = F.lower(F.trim(text))
    return F.when(t == "sql", "sql").when(t.isin("pandas", "pd"), "pandas").when(t.isin("spark", "pyspark"), "spark").when(t.isin("python", "py"), "python").when(t.isin("bash", "shell"), "bash").otherwise("unknown")


def openlineage_transform(kind: Column) -> Column:
    return (
        F.when(kind == "identity", F.struct(F.lit("DIRECT").alias("type"), F.lit("IDENTITY").alias("subtype")))
        .when(kind == "aggregation", F.struct(F.lit("DIRECT").alias("type"), F.lit("AGGREGATION").alias("subtype")))
        .when(kind == "indirect", F.struct(F.lit("INDIRECT").alias("type"), F.lit("GROUP_BY").alias("subtype")))
        .otherwise(F.struct(F.lit("DIRECT").alias("type"), F.lit("TRANSFORMATION").alias("subtype")))
    )


INFERRED_NOTE = "Part of this lineage was inferred by static analysis."


def edge_description(description: Column, inferred: Column) -> Column:
    noted = F.when(description.isNull(), F.lit(INFERRED_NOTE)).otherwise(F.concat(F.lit(INFERRED_NOTE + "\n\n"), description))
    return F.when(inferred, noted).otherwise(description)


def rfc3339(seconds: Column) -> Column:
    """In UTC, whatever the session's zone. Years of more than four digits have no sign, as SQL's strftime writes them."""
    whole = F.floor(seconds).cast("bigint")
    rest = F.pmod(whole, F.lit(86400))
    date = F.date_add(F.lit("1970-01-01").cast("date"), ((whole - rest) / 86400).cast("int"))
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    year = F.year(date)
    text = F.when(year.between(0, 9999), F.lpad(year.cast("string"), 4, "0")).otherwise(year.cast("string"))
    clock = [two(F.floor(rest / 3600).cast("int")), two((F.floor(rest / 60) % 60).cast("int")), two((rest % 60).cast("int"))]
    return F.concat(text, F.lit("-"), two(F.month(date)), F.lit("-"), two(F.dayofmonth(date)), F.lit("T"), clock[0], F.lit(":"), clock[1], F.lit(":"), clock[2], F.lit("Z"))


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def shorten(text: Column, limit: int = 80) -> Column:
    t = collapse(text)
    return F.when(F.length(t) > limit, F.concat(F.substring(t, 1, limit - 3), F.lit("…"))).otherwise(t)


def classify_label(label: Column, n_sources: Column, precise: bool = False) -> Column:
    """identity, aggregation or transformation of a declared mapping's label.

    ``precise`` asks for whole words; otherwise a part of a word is enough, as in DISCOUNT.
    """
    u = F.upper(label)
    aggregate = r"\b(COUNT|SUM|AVG|MIN|MAX|GROUP BY)\b" if precise else "COUNT|SUM|AVG|MIN|MAX|GROUP BY"
    low = F.lower(F.trim(label))
    return (
        F.when(label.isNull(), F.when(n_sources <= 1, "identity").otherwise("transformation"))
        .when(u.rlike(aggregate), "aggregation")
        .when((low == "direct copy") | low.startswith("rename") | (low == "identity"), "identity")
        .otherwise("transformation")
    )


def expand_fqn(name: Column, service: Column, database: Column, schema: Column) -> Column:
    """A bare name becomes one of four parts if all three defaults are there; dotted ones stay."""
    full = service.isNotNull() & database.isNotNull() & schema.isNotNull() & ~F.contains(name, F.lit("."))
    return F.when(full, F.concat_ws(".", service, database, schema, name)).otherwise(name)


def service_override(parts: Column, service: str | None) -> Column:
    return table_fqn(parts.withField("service", F.coalesce(F.lit(service), parts["service"])))


def columns_lineage(from_fqn: Column, to_fqn: Column, edge_from: Column, mappings: Column) -> Column:
    """Catalogue entries of an edge's mappings: sources on the edge's own input; sourceless ones are left out."""
    entry = lambda m: F.struct(
        F.transform(F.filter(m["from_columns"], lambda r: r["dataset"] == edge_from), lambda r: F.concat_ws(".", from_fqn, r["column"])).alias("fromColumns"),
        F.concat_ws(".", to_fqn, m["to_column"]["column"]).alias("toColumn"),
        display_function(m["function"], m["origin"]["source"]).alias("function"),
    )
    return F.filter(F.transform(mappings, entry), lambda e: F.size(e["fromColumns"]) > 0)


def ratio(n: Column, d: Column, empty: float) -> Column:
    return F.when(d == 0, F.lit(empty)).otherwise(n.cast("double") / F.nullif(d, F.lit(0)))


def origin(source: Column, confidence: Column | float | None, note: Column | str | None = None) -> Column:
    conf = confidence if isinstance(confidence, Column) else F.lit(confidence)
    text = note if isinstance(note, Column) else F.lit(note)
    return F.struct(source.alias("source"), conf.cast("float").alias("confidence"), text.cast("string").alias("note"), F.lit(None).cast("struct<file:string,line:int>").alias("location"))
