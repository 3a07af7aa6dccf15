"""The modelled operations, executed: landing events to bronze, silver and gold, and their like."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .encodings import read

RATES = {"USD": 1.00, "EUR": 1.08, "GBP": 1.27, "THB": 0.028}


def bronze(spark: SparkSession, d: str) -> DataFrame:
    """The first event of each user and type, cast (INSERT ... SELECT over a numbered derived table)."""
    return spark.sql(
        """
        SELECT CAST(event_id AS BIGINT) AS event_id, CAST(user_id AS STRING) AS customer_name, CAST(value AS DECIMAL(12, 2)) AS amount,
               CASE event_type WHEN 'click' THEN 'USD' WHEN 'view' THEN 'EUR' WHEN 'signup' THEN 'GBP' WHEN 'purchase' THEN 'THB' ELSE 'XXX' END AS currency, ts AS event_ts
        FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM {events})
        WHERE rn = 1""",
        events=read(spark, d, "events"),
    )


def silver(spark: SparkSession, d: str) -> DataFrame:
    b = bronze(spark, d)
    rate = F.lit(1.0)
    for code, value in RATES.items():
        rate = F.when(F.col("currency") == code, value).otherwise(rate)
    return b.withColumns({"amount_usd": F.round(F.col("amount").cast("double") * rate, 6), "event_date": F.to_date("event_ts"), "is_valid": F.col("amount") > 0}).drop("event_ts")


def gold(spark: SparkSession, d: str) -> DataFrame:
    return silver(spark, d).where("is_valid").groupBy("event_date").agg(
        F.count("*").alias("total_transactions"), F.countDistinct("customer_name").alias("unique_customers"), F.round(F.sum("amount_usd"), 2).alias("total_revenue_usd"), F.round(F.avg("amount_usd"), 2).alias("avg_transaction_usd")
    )


def merge(target: DataFrame, source: DataFrame, on: str, update: list[str], delete=None) -> DataFrame:
    """MERGE INTO as a full outer join: matched rows take the source's columns, new ones are inserted,
    and matched rows for which ``delete`` holds over the source go."""
    t = target.select(on, *[F.col(c).alias(f"t_{c}") for c in update], F.lit(1).alias("in_t"))
    s = source.select(on, *[F.col(c).alias(f"s_{c}") for c in update], F.lit(1).alias("in_s"))
    j = t.join(s, on, "full")
    if delete is not None:
        j = j.where(~F.coalesce(delete & F.col("in_t").isNotNull(), F.lit(False)))
    return j.select(on, *[F.when(F.col("in_s").isNotNull(), F.col(f"s_{c}")).otherwise(F.col(f"t_{c}")).alias(c) for c in update])
