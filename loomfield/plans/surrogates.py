"""Point, trajectory and ray tables made from the relational test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RETURN_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame, block, pt, x, y, z, value, weight, off_ns: 60 frames in 6 temporal blocks."""
    # the frame is a column before the window, so that later ones over it need no other shuffle; the rest is made after it
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 60).cast("int").alias("frame"), *RETURN_ORDER, "l_discount", "l_tax")
    rows = rows.withColumn("pt", F.row_number().over(Window.partitionBy("frame").orderBy(*RETURN_ORDER)) - 1)
    return rows.select(
        "frame", F.floor(F.col("frame") / 10).cast("int").alias("block"), "pt",
        (F.col("l_quantity") + 0.37 * F.col("l_linenumber")).alias("x"), (F.col("l_extendedprice") / 2000.0).alias("y"), (F.col("l_discount") * 100.0 + 0.13).alias("z"),
        (1.0 - 2.0 * F.col("l_tax") / 0.08).alias("value"), (1.5 - 5.0 * F.col("l_discount")).alias("weight"), (F.col("l_partkey") * 997 % 100_000_000).alias("off_ns"),
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted samples of the frames that are not held out."""
    return returns_plain(spark, sf_dir).where("frame % 10 <> 5 AND weight > 0")


def returns_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returns without their order in the frame: no shuffle."""
    frame = (F.col("l_orderkey") % 60).cast("int")
    return table(spark, sf_dir, "lineitem").select(
        frame.alias("frame"), F.floor(frame / 10).cast("int").alias("block"),
        (F.col("l_quantity") + 0.37 * F.col("l_linenumber")).alias("x"), (F.col("l_extendedprice") / 2000.0).alias("y"), (F.col("l_discount") * 100.0 + 0.13).alias("z"),
        (1.0 - 2.0 * F.col("l_tax") / 0.08).alias("value"), (1.5 - 5.0 * F.col("l_discount")).alias("weight"), (F.col("l_partkey") * 997 % 100_000_000).alias("off_ns"),
    )


def trajectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, event_id, t_ns, position and a quaternion about z."""
    e = table(spark, sf_dir, "events")
    t = F.unix_micros(F.col("ts").cast("timestamp")) * 1000
    half = F.col("value") / 2
    return e.select("user_id", "event_id", t.alias("t_ns"), F.col("value").alias("px"), (F.col("event_id") % 100).cast("double").alias("py"), F.col("user_id").cast("double").alias("pz"), F.lit(0.0).alias("qx"), F.lit(0.0).alias("qy"), F.sin(half).alias("qz"), F.cos(half).alias("qw"))


def cloud(spark: SparkSession, sf_dir: str, odd: bool | None = None) -> DataFrame:
    """pid and the first three dimensions of the embeddings times ten."""
    e = table(spark, sf_dir, "embeddings")
    if odd is not None:
        e = e.where(F.col("vec_id") % 2 == int(odd))
    return e.select(F.col("vec_id").alias("pid"), *[(F.col("embedding")[i].cast("double") * 10).alias(a) for i, a in enumerate("xyz")], "label")
