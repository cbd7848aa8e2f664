"""Sensor positions beyond ten thousand."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomfield.plans import registry
from loomfield.plans import surrogates as S


def test_no_sensor_position_is_dropped(spark, monkeypatch):
    n = 10_050
    at = spark.range(n).select(F.explode(F.array((F.col("id") * 20).alias("a"), F.col("id") * 20 + 5)).alias("frame"), (F.col("id") * 100.0).alias("x"))
    monkeypatch.setattr(S, "returns_plain", lambda spark, d: at.select("frame", "x", F.lit(0.0).alias("y"), F.lit(1.0).alias("value")))
    assert registry.QUERIES["roi_metrics"](spark, "").count() == n
