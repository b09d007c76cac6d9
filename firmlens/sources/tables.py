"""Reading fact, dimension and result tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from firmlens.functions.columns import join_key

PANEL_SCHEMA = T.StructType(
    [T.StructField("company", T.StringType()), T.StructField("year", T.IntegerType())]
    + [T.StructField(c, T.DoubleType()) for c in "a ni rev cfo rec ppe roa cogs inv".split()]
)


def require_columns(df: DataFrame, columns: list[str], label: str = "table") -> DataFrame:
    lost = [c for c in columns if c not in df.columns]
    if lost:
        raise ValueError(f"{label} lacks columns {lost}; it has {df.columns}")
    return df


def path_exists(spark: SparkSession, path: str) -> bool:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None, required: bool = True) -> DataFrame:
    """Parquet folder/file or CSV; a missing optional table is an empty frame of ``schema``."""
    if not path_exists(spark, path):
        if required:
            raise FileNotFoundError(path)
        return spark.createDataFrame([], schema)
    if os.path.splitext(path.rstrip("/"))[1] == ".csv":
        reader = spark.read.option("header", True)
        return (reader.schema(schema) if schema else reader).csv(path)
    df = spark.read.parquet(path)
    return require_columns(df, schema.fieldNames(), path).select(*schema.fieldNames()) if schema else df


def read_panel(spark: SparkSession, path: str) -> DataFrame:
    df = read_table(spark, path)
    require_columns(df, PANEL_SCHEMA.fieldNames(), "firm-year panel")
    return df.withColumn("company", join_key("company"))


def driver_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def firm_year_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Firm-year panel derived from the order tables: one row per (customer, order year).

    Every fact side is reduced before it meets a dimension: line items to orders, orders to firm-years.
    A customer holding a third of all orders is thus one row per year when the customer join happens.
    """
    t = lambda name: driver_table(spark, sf_dir, name)
    li = t("lineitem").join(t("part").select("p_partkey", "p_retailprice"), F.col("l_partkey") == F.col("p_partkey"))
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    cost = F.col("l_quantity") * F.col("p_retailprice")
    shipped = F.col("l_linestatus") == "F"
    per_order = li.groupBy("l_orderkey").agg(
        F.sum(net).alias("rev"),
        F.sum(cost).alias("cogs"),
        F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_extendedprice")).otherwise(0.0)).alias("rec"),
        F.sum(F.when(shipped, F.col("l_extendedprice")).otherwise(0.0)).alias("ppe"),
        F.sum(F.when(F.col("l_linestatus") == "O", cost).otherwise(0.0)).alias("inv"),
        F.sum(F.when(shipped, net - cost).otherwise(0.0)).alias("cfo"),
    )
    orders = t("orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", F.year("o_orderdate").cast("int").alias("year")
    )
    firm_year = (
        orders.join(per_order, F.col("o_orderkey") == F.col("l_orderkey"))
        .groupBy("o_custkey", "year")
        .agg(F.sum("o_totalprice").alias("a"), *[F.sum(c).alias(c) for c in ("rev", "cogs", "rec", "ppe", "inv", "cfo")])
    )
    return (
        firm_year.join(firm_dimension(spark, sf_dir), "o_custkey")
        .select(
            "company", "year", "industry", "se", "a", (F.col("rev") - F.col("cogs")).alias("ni"), "rev", "cfo", "rec",
            "ppe", ((F.col("rev") - F.col("cogs")) / F.col("a")).alias("roa"), "cogs", "inv",
        )
    )


def firm_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per firm with a unique key."""
    c, n = driver_table(spark, sf_dir, "customer"), driver_table(spark, sf_dir, "nation")
    return c.join(n, c.c_nationkey == n.n_nationkey).select(
        F.col("c_custkey").alias("o_custkey"),
        F.col("c_custkey").cast("string").alias("company"),
        F.col("c_mktsegment").alias("industry"),
        F.col("n_regionkey").alias("se"),
        F.col("n_name").alias("exchange"),
    )
