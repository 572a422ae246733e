"""Two versions of the given tables, and dated snapshots of them, to run the operators on.

Version B keeps every row of the table: some keys move (so a row is removed and another added), some
values change, some become NULL. The SQL twins of these definitions are in `registered.py`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tables(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return {n: table(spark, sf_dir, n) for n in names}


def _every(key: str, n: int) -> Column:
    return F.col(key) % n == 0


def _moved(key: str, n: int) -> Column:
    return F.when(_every(key, n) & (F.col(key) > 0), -F.col(key)).otherwise(F.col(key)).alias(key)


def orders_versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All columns of orders; their dates are DATE in one version and TIMESTAMP in the other."""
    orders = table(spark, sf_dir, "orders")
    key = "o_orderkey"
    a = orders.select(
        key, "o_custkey", "o_orderstatus", "o_totalprice",
        F.when(~_every(key, 43), F.col("o_orderpriority")).alias("o_orderpriority"),
        F.col("o_orderdate").cast("date").alias("o_orderdate"),
    )
    b = orders.select(
        _moved(key, 89),
        F.when(_every(key, 30), F.col("o_custkey") + 1).otherwise(F.col("o_custkey")).alias("o_custkey"),
        F.when(_every(key, 53), "X").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"),
        F.when(_every(key, 29), F.col("o_totalprice") + 100)
        .when(_every(key, 31), F.col("o_totalprice") - 37.5)
        .otherwise(F.col("o_totalprice")).alias("o_totalprice"),
        F.when(~_every(key, 41), F.col("o_orderpriority")).alias("o_orderpriority"),
        F.when(_every(key, 37), F.date_trunc("day", "o_orderdate") + F.expr("INTERVAL 1 DAY"))
        .otherwise(F.date_trunc("day", "o_orderdate")).cast("timestamp").alias("o_orderdate"),
    )
    return a, b


def part_versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    part = table(spark, sf_dir, "part")
    key = "p_partkey"
    b = part.select(
        _moved(key, 97), "p_name",
        F.when(_every(key, 23), F.concat("p_brand", F.lit("-new"))).otherwise(F.col("p_brand")).alias("p_brand"),
        "p_type", "p_size",
        F.when(_every(key, 19), F.col("p_retailprice") + 0.5).otherwise(F.col("p_retailprice")).alias("p_retailprice"),
    )
    return part, b


def null_key_versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers of which every third has lost its key in both versions."""
    customer = table(spark, sf_dir, "customer")
    lost = F.when(~_every("c_custkey", 3), F.col("c_custkey")).alias("c_custkey")
    more = F.when(_every("c_custkey", 20), F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal"))
    return customer.withColumn("c_custkey", lost), customer.withColumn("c_acctbal", more).withColumn("c_custkey", lost)


def lineitem_versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Line items by a key that repeats."""
    line = table(spark, sf_dir, "lineitem")
    more = F.when(_every("l_orderkey", 50), F.col("l_quantity") + 1).otherwise(F.col("l_quantity"))
    return line, line.withColumn("l_quantity", more)


def events_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as daily snapshots; every seventh value is missing."""
    return table(spark, sf_dir, "events").select(
        F.date_format("ts", "yyyy-MM-dd").alias("snapshot"),
        "event_id", "user_id", "event_type",
        F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"),
    )


def daily_catalog(daily: DataFrame) -> DataFrame:
    """One row per snapshot with its position; the numbering is over distinct dates only."""
    dates = daily.select("snapshot").distinct()
    return dates.select("snapshot", (F.row_number().over(Window.orderBy("snapshot")) - 1).alias("order_idx"))


def number_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event values spelt in the awkward ways numbers are found in text columns."""
    text = F.col("value").cast("string")
    spelt = (
        F.when(F.col("event_id") % 4 == 0, F.concat(F.replace(text, F.lit("."), F.lit(",")), F.lit(" %")))
        .when(F.col("event_id") % 4 == 1, F.concat(F.lit("('"), text, F.lit("',)")))
        .when(F.col("event_id") % 4 == 2, F.concat(F.lit(" Decimal('"), text, F.lit("') ")))
        .otherwise(text)
    )
    return table(spark, sf_dir, "events").select("event_id", "event_type", spelt.alias("amount"))


def order_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names as a landing folder would hold them, one per order, dated in various ways."""
    date = F.col("o_orderdate")
    kind = F.col("o_orderkey") % 5
    name = (
        F.when(kind == 0, F.concat(F.date_format(date, "yyyy-MM-dd"), F.lit("_db"), F.col("o_custkey"), F.lit("x.parquet")))
        .when(kind == 1, F.concat(F.lit("db "), F.date_format(date, "dd-MM-yyyy"), F.lit(".csv")))
        .when(kind == 2, F.concat(F.lit("db_"), F.date_format(date, "yyyyMMdd"), F.lit(".orc")))
        .when(kind == 3, F.concat(F.lit("db_2026-13-40_"), F.col("o_orderstatus"), F.lit(".json")))
        .otherwise(F.concat(F.lit("Old DB "), F.col("o_orderstatus"), F.lit(".txt")))
    )
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", name.alias("file_name"), F.concat(F.col("o_orderpriority"), F.lit("/"), name).alias("relpath"),
        (F.col("o_totalprice") * 100).cast("bigint").alias("size_bytes"), date.alias("mtime"),
    )
