"""The driver's tables seen as particles, snapshots, vectors, cells and commands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenfold.plans.tables import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def particles(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """``lineitem``: quantity, discount and tax are places; the four keys make the id. ``dealt`` for long work on each row:
    a table of fewer row groups than cores is then dealt out to all."""
    keys = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    li = table(spark, sf_dir, "lineitem").select(*keys, "l_quantity", "l_discount", "l_tax", "l_extendedprice", "l_returnflag")
    li = spread(li) if dealt else li
    pid = ((F.col("l_orderkey") * 262144 + F.col("l_partkey")) * 16384 + F.col("l_suppkey")) * 8 + F.col("l_linenumber")
    return li.select(
        pid.alias("pid"),
        F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2).alias("type"),
        F.col("l_quantity").alias("x"),
        (F.col("l_discount") * 500 + 0.0).alias("y"),
        (F.col("l_tax") * 500 + 0.0).alias("z"),
        (0.5 + F.col("l_quantity") / 50).alias("r"),
        F.col("l_extendedprice").alias("i"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("e"),
        F.col("l_returnflag").alias("species"),
    )


def snapshot(spark: SparkSession, sf_dir: str, day: int) -> DataFrame:
    """``events`` of one day of January 2024; a user's events repeat the user's id."""
    ev = table(spark, sf_dir, "events").filter((F.col("ts") >= F.lit(f"2024-01-{day:02d}").cast("timestamp")) & (F.col("ts") < F.lit(f"2024-01-{day + 1:02d}").cast("timestamp")))
    kind = F.when(F.col("event_type") < "m", 0).otherwise(1)
    return ev.select(
        F.col("user_id").alias("id"), kind.alias("type"), F.hour("ts").cast("double").alias("x"), F.col("value").alias("y"), F.minute("ts").cast("double").alias("z"), F.lit(1.0).alias("r"),
        F.col("value").alias("i"), (F.col("value") / 10).alias("e"), (F.col("value") / 100).alias("vx"), F.lit(0.5).alias("vy"), (F.hour("ts") / 24.0).alias("vz"), F.col("event_id").alias("eid"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = lambda k: F.col("embedding")[k].cast("double")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pid"), F.col("label").alias("type"), e(0).alias("x"), e(1).alias("y"), e(2).alias("z"), e(3).alias("c1"), e(4).alias("c2"), e(5).alias("c3"))


def commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.select("ts", F.col("event_id").alias("id"), F.col("event_type").alias("key"), F.get_json_object("props", "$.k").alias("value"))


def nth_of(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    return df.withColumn("nth", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
