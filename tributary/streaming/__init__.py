"""An extension: documents that arrive as JSON files, merged into a table of datasets as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as T
from ..operators.catalog import upsert_datasets
from ..storage import file_system


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(T.parse(T.DOCUMENT)).option("multiLine", True).json(folder)


def merge_into(path: str):
    """A batch writer that unites a batch's datasets with the table at ``path``, first seen first. Each
    batch becomes a version of its own: a table, and last an empty file that marks it as whole, so a
    lost batch can be run again. All of it lies in the table's own file system, which executors share."""

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        none = F.array().cast("array<struct<name:string,type:string,description:string>>")
        rows = batch.select(F.posexplode("datasets").alias("p", "r")).select((F.lit(epoch).cast("bigint") * (1 << 32) + F.col("p")).alias("seq"), "r.name", "r.namespace", "r.platform", "r.fqn", F.coalesce("r.schema", none).alias("schema"), "r.origin")
        old = current(spark, path, before=epoch)
        merged = upsert_datasets(rows if old is None else old.select(*rows.columns).unionByName(rows))
        merged.select(*rows.columns).write.mode("overwrite").parquet(f"{path}/v{epoch}")
        fs, mark = file_system(spark, f"{path}/v{epoch}.whole")
        fs.create(mark, True).close()
        for v in [v for v in _versions(spark, path) if v < epoch - 1]:
            for name in (f"v{v}.whole", f"v{v}"):
                fs, gone = file_system(spark, f"{path}/{name}")
                fs.delete(gone, True)

    return write


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Epochs of the whole versions, a few."""
    fs, folder = file_system(spark, path)
    if not fs.exists(folder):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(folder)]
    return sorted(int(n[1:-6]) for n in names if n.startswith("v") and n.endswith(".whole"))


def current(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The last whole version (of an epoch below ``before``)."""
    found = [v for v in _versions(spark, path) if before is None or v < before]
    return spark.read.parquet(f"{path}/v{found[-1]}") if found else None


def start(spark: SparkSession, folder: str, path: str, checkpoint: str):
    """Runs over what is there and ends; start it again for what comes."""
    fs, target = file_system(spark, path)
    fs.mkdirs(target)
    return documents(spark, folder).writeStream.foreachBatch(merge_into(path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
