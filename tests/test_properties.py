"""Properties of the spatial operators that hold without an oracle."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from loomfield.functions import keys as K
from loomfield.operators import field, scans, surface

EDGE = [0, 1, -1, (1 << 20) - 1, -(1 << 20)]


def test_key_roundtrip_at_the_edges(spark):
    rows = spark.createDataFrame([(x, y, z) for x in EDGE for y in EDGE for z in EDGE], "x long, y long, z long")
    k = rows.select("x", "y", "z", K.pack(F.col("x"), F.col("y"), F.col("z")).alias("k"))
    back = k.select("x", "y", "z", *[c.alias(f"k{a}") for a, c in zip("xyz", K.unpack(F.col("k")))])
    assert back.where("x <> kx OR y <> ky OR z <> kz").count() == 0
    assert k.select("k").distinct().count() == len(EDGE) ** 3


def test_key_out_of_range_is_an_error(spark):
    with pytest.raises(Exception, match="OVERFLOW"):
        spark.createDataFrame([(1 << 20, 0, 0)], "x long, y long, z long").select(K.pack(F.col("x"), F.col("y"), F.col("z"))).collect()


def test_mask_bit_63_is_the_sign(spark):
    assert spark.range(1).select(K.mask_bit(F.lit(63)), K.mask_bit(F.lit(64))).first()[:] == (-(1 << 63), 1)


def test_splat_keeps_weight(spark):
    rnd = random.Random(1)
    rows = spark.createDataFrame([(rnd.uniform(-5, 5), rnd.uniform(-5, 5), rnd.uniform(-5, 5), 0.5, 1.0) for _ in range(200)], "x double, y double, z double, value double, weight double")
    total = field.splat(rows, []).agg(F.sum("weight_sum")).first()[0]
    assert abs(total - 200) < 0.05
    exact = spark.createDataFrame([(2.0, -3.0, 0.0, 1.0, 1.0)], rows.schema)
    assert field.splat(exact, []).count() == 1


@pytest.mark.parametrize("n", [0, 1, 5, 6, 37])
def test_even_subsample_matches_its_definition(spark, n):
    rows = spark.range(n).select(F.lit(0).alias("frame"), F.col("id").alias("pt"))
    got = sorted(r["pt"] for r in scans.even_subsample(rows, 5).collect())
    want = list(range(n)) if n <= 5 else sorted({*(i * (n - 1) // 4 for i in range(4)), n - 1})
    assert got == want


def test_even_subsample_of_a_long_scan(spark):
    n, most = 400_000, 12_000  # places times most leave 32 bits
    rows = spark.range(n).select(F.lit(0).alias("frame"), F.col("id").cast("int").alias("pt"))
    got = sorted(r["pt"] for r in scans.even_subsample(rows, most).collect())
    assert got == sorted({*(i * (n - 1) // (most - 1) for i in range(most - 1)), n - 1})


def test_jacobi_leaves_isolated_nodes_without_confidence(spark):
    rows = spark.createDataFrame([(K.STEP["x"] * 9, 0.7, 0.1, 0.0, True)], "k long, s double, target double, c double, inside boolean")
    assert field.jacobi(rows, 2).first()["s"] == 0.7


def test_cube_needs_three_corners(spark):
    two = spark.createDataFrame([(10 * K.STEP["x"], -0.5), (11 * K.STEP["x"], 0.5)], "k long, s double")
    assert surface.cube_vertices(two).count() == 0


def test_node_touched_by_65_blocks_counts_65(spark):
    rows = spark.range(65).select(F.col("id").cast("int").alias("block"), F.lit(5).cast("long").alias("k"), F.lit(1.0).alias("value_sum"), F.lit(1.0).alias("weight_sum"))
    r = field.merge_blocks(rows).first()
    assert r["hit_count"] == 65 and r["mask"] == -1
