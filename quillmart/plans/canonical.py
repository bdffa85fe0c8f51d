"""Canonical products, sales and purchases over the star-schema tables; money is in whole cents, so sums do not depend on their order."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(amount: Column) -> Column:
    return F.floor(amount * 100 + 0.5)


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("product_id"), F.col("p_name").alias("product_name"), F.col("p_type").alias("category"), F.col("p_brand").alias("brand"), cents(F.col("p_retailprice")).alias("price"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = products(spark, sf_dir).select("product_id", "product_name")
    lines = table(spark, sf_dir, "lineitem").withColumn("product_id", F.col("l_partkey").cast("string"))
    return lines.join(part, "product_id").withColumn("is_active", F.col("l_returnflag") != "R").withColumn("quantity", F.col("l_quantity").cast("long"))


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("date"))
    customer = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("customer"))
    lines = _lines(spark, sf_dir).join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey"))
    return lines.select("date", "customer", "product_id", "product_name", "quantity", cents(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("total"), "is_active")


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("supplier"), "s_nationkey")
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), (F.col("n_regionkey") + 1).alias("delivery_days"))
    lines = _lines(spark, sf_dir).join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(nation, "s_nationkey")
    return lines.select(F.to_date("l_shipdate").alias("date"), "supplier", "delivery_days", "product_id", "product_name", "quantity", cents(F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_cost"), cents(F.col("l_extendedprice")).alias("total"), "is_active")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder named by spark.checkpoint.dir and read it again. Only a local session without that setting, as in tests, gets a temporary folder."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[[\d*, ]+\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(root)
    path = f"{root}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def running_total(df: DataFrame, value: str, order: list[Column], name: str) -> DataFrame:
    """df with the running total of `value` along a total order, without one task for all rows: rows are range-partitioned, totals of partitions shift the totals inside them."""
    ranged = stored(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "running")
    parts = ranged.groupBy("_part").agg(F.sum(value).alias("_sum"))
    before = parts.select("_part", F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.sum(value).over(Window.partitionBy("_part").orderBy(*order))
    return ranged.withColumn(name, inside).join(F.broadcast(before), "_part").withColumn(name, F.col(name) + F.col("_before")).drop("_part", "_before")
