"""When does output come: a server that works off arrivals one after the other."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def served(arrivals: DataFrame) -> DataFrame:
    """Arrivals (i, arrived, work; integers of one unit) with start, ready, lag and backlog.

    What arrives waits for all before it: ready is the work so far plus the largest delay of a start, a
    running maximum. The backlog is what had arrived by a start and still waited, this one left out. One
    replay is one sequence, so its few rows per scan are in one window.
    """
    w = Window.partitionBy(F.lit(1)).orderBy("i")
    rows = arrivals.withColumn("done", F.sum("work").over(w))
    rows = rows.withColumn("ready", F.max(F.col("arrived") - F.col("done") + F.col("work")).over(w) + F.col("done"))
    rows = rows.withColumn("start", F.col("ready") - F.col("work")).withColumn("lag", F.col("start") - F.col("arrived"))
    # merge arrivals and starts by time: an arrival at the time of a start counts
    came = rows.select(F.col("arrived").alias("t"), F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("i"), F.lit(1).alias("one"))
    went = rows.select(F.col("start").alias("t"), F.lit(1).alias("kind"), F.col("i").cast("bigint").alias("i"), F.lit(0).alias("one"))
    order = Window.partitionBy(F.lit(1)).orderBy("t", "kind", "i").rowsBetween(Window.unboundedPreceding, 0)
    there = came.unionByName(went).withColumn("came", F.sum("one").over(order)).where("kind = 1").select("i", "came")
    place = F.row_number().over(w)
    return rows.withColumn("place", place).join(there, "i").select("i", "arrived", "work", "start", "ready", "lag", (F.col("came") - F.col("place")).alias("backlog"))


def latency_summary(rows: DataFrame) -> DataFrame:
    """One row: n, median, p95 and most of ready - arrived, the medians of its thirds and the largest backlog."""
    w = Window.partitionBy(F.lit(1)).orderBy("i")
    late = rows.withColumns({"late": (F.col("ready") - F.col("arrived")).cast("double"), "place": F.row_number().over(w), "all": F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))})
    third = F.least(F.floor((F.col("place") - 1) * 3 / F.col("all")), F.lit(2))
    late = late.withColumn("third", third)
    medians = [F.expr(f"percentile(late, 0.5) FILTER (WHERE third = {i})").alias(f"median_{i + 1}") for i in range(3)]
    return late.agg(F.count(F.lit(1)).alias("n"), F.expr("percentile(late, 0.5)").alias("median"), F.expr("percentile(late, 0.95)").alias("p95"), F.max("late").alias("most"), *medians, F.max("backlog").alias("backlog"))
