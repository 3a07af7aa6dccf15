"""Tables, and scratch files in the folder that all executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..shipping import ship
from ..storage import scratch_uri, stored

__all__ = ["integer_ids", "ready", "scratch_uri", "stored", "table"]

#: Rows and bytes of the batches that go to Python: whole texts may be long, and executors small.
BATCH_ROWS, BATCH_BYTES = 2_500, 16 << 20


def ready(spark: SparkSession) -> None:
    """Ships the package and keeps batches small; a session's own smaller sizes stay."""
    ship(spark)
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{key}"
        now = str(spark.conf.get(name)).rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(name, str(most))


def integer_ids(docs: DataFrame) -> None:
    """Raises a TypeError unless doc_id is an integer column, for operators that need its order."""
    if docs.schema["doc_id"].dataType.simpleString() not in ("bigint", "int", "smallint", "tinyint"):
        raise TypeError("doc_id must be an integer")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ready(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
