"""Schemas of a lineage document's tables. Names are compared as strings, never as identifiers."""

from __future__ import annotations

from pyspark.sql import types as T

LOCATION = "struct<file:string,line:int>"
ORIGIN = f"struct<source:string,confidence:float,note:string,location:{LOCATION}>"
REF = "struct<dataset:string,column:string>"
TRANSFORM = "struct<kind:string,description:string,sql:string>"

DATASETS = f"seq bigint, name string, namespace string, platform string, fqn string, schema array<struct<name:string,type:string,description:string>>, facets map<string,string>, origin {ORIGIN}"
JOBS = f"seq bigint, id string, name string, namespace string, dag string, engine string, location {LOCATION}, description string, sql string, inputs array<string>, outputs array<string>, origin {ORIGIN}"
EDGES = f"edge_id bigint, `from` string, `to` string, job string, transform {TRANSFORM}, column_discovery boolean, origin {ORIGIN}"
COLUMN_EDGES = f"edge_id bigint, ordinal int, from_columns array<{REF}>, to_column {REF}, function string, transform_type string, origin {ORIGIN}"
DIAGNOSTICS = f"seq bigint, level string, code string, message string, location {LOCATION}"


def parse(ddl: str) -> T.StructType:
    return T._parse_datatype_string(ddl)


_FIELD = "struct<name:string,type:string,description:string>"
_COLUMN_EDGE = f"struct<from_columns:array<{REF}>,to_column:{REF},function:string,transform_type:string,origin:{ORIGIN}>"
#: The document as JSON holds it; members may be missing.
DOCUMENT = (
    f"weave_version string, producer string, generated_at string, namespace string, "
    f"datasets array<struct<name:string,namespace:string,platform:string,fqn:string,schema:array<{_FIELD}>,facets:map<string,string>,origin:{ORIGIN}>>, "
    f"jobs array<struct<id:string,name:string,namespace:string,dag:string,engine:string,location:{LOCATION},description:string,sql:string,inputs:array<string>,outputs:array<string>,origin:{ORIGIN}>>, "
    f"edges array<struct<`from`:string,`to`:string,job:string,transform:{TRANSFORM},column_lineage:array<{_COLUMN_EDGE}>,column_discovery:boolean,origin:{ORIGIN}>>, "
    f"diagnostics array<struct<level:string,code:string,message:string,location:{LOCATION}>>"
)

DECLARED, SQL, CODE = "declared", "inferred_sql", "inferred_code"
#: Confidence of what is inferred: from SQL, from code, from names that aren't literal, from equal names.
SQL_CONFIDENCE, CODE_CONFIDENCE, NONLITERAL_CONFIDENCE, SAME_NAME_CONFIDENCE = 0.85, 0.7, 0.5, 0.4
VERSION = "0.1"
