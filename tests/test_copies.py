"""Scans whose returns often lie at the same place."""

from __future__ import annotations

import duckdb
import pytest

from loomfield.operators import scores, support
from loomfield.plans.catalog import ORACLES, QUERIES
from tests.oracle import differences

TINY = "/root/testdata/sf0.001/lineitem.parquet"
NAMES = ["knn_scan", "support_limits", "scan_samples", "sampled_nodes"]


def repeated(folder: str, times: str) -> str:
    """Rows that are repeated with shifted keys in their own frame, ``times`` by row."""
    copies = f"SELECT r.* REPLACE (l_orderkey + i * 60000 AS l_orderkey) FROM '{TINY}' r, (SELECT unnest(range(20)) AS i) WHERE i < {times}"
    duckdb.sql(f"COPY ({copies}) TO '{folder}/lineitem.parquet'")
    return str(folder)


@pytest.mark.parametrize("name", NAMES)
def test_some_returns_have_copies(spark, tmp_path, name):
    # only where cells hold many places: the plane of a line hangs on the order of sums
    d = repeated(tmp_path, "CASE WHEN l_orderkey % 60 < 30 OR l_quantity NOT BETWEEN 15 AND 35 OR l_extendedprice NOT BETWEEN 16000 AND 40000 OR l_partkey % 3 = 0 THEN 1 WHEN l_partkey % 3 = 1 THEN 3 ELSE 12 END")
    assert differences(spark, name, d, QUERIES, ORACLES) == []


def test_places_of_many_copies_ask_no_neighbours(spark, tmp_path, monkeypatch):
    asked = []
    plain = scores.nearest
    monkeypatch.setattr(scores, "nearest", lambda points, *a, **b: asked.append(points.count()) or plain(points, *a, **b))
    d = repeated(tmp_path, "9")
    rows = QUERIES["knn_scan"](spark, d)
    assert rows.where("dist2 <> 0").isEmpty() and rows.count() == 8 * spark.read.parquet(f"{d}/lineitem.parquet").count()
    assert asked == []


@pytest.mark.parametrize("name", ["sampled_nodes", "scan_samples", "support_limits"])
def test_places_of_many_copies_make_no_pairs(spark, tmp_path, monkeypatch, name):
    monkeypatch.setattr(support, "support_limits", lambda *a, **b: pytest.fail("pairs of a place with itself"))
    assert not QUERIES[name](spark, repeated(tmp_path, "9")).isEmpty()


def test_ids_of_a_place_come_in_bounded_arrays(spark):
    points = spark.range(25).selectExpr("0 AS frame", "int(id) AS pt", "1.0D AS x", "if(id = 7, 2.0D, 1.0D) AS y", "if(id = 9, double('nan'), 0.0D) AS z")
    rows = scores.copies(points, ["frame"], "pt", 10)
    got = sorted((r["at"], r["ids"]) for r in rows.collect())
    assert got == [(0, [0, 1, 2, 3, 4, 5, 6, 8]), (0, list(range(10, 20))), (0, list(range(20, 25))), (7, [7]), (9, [9])]
    place = {r["at"]: (r["n"], r["first"]) for r in scores.places(rows, ["frame"], 8).collect()}
    assert place == {0: (23, [0, 1, 2, 3, 4, 5, 6, 8]), 7: (1, [7]), 9: (1, [9])}
    near = {r["at"]: [(x["d2"], x["id"], x["at"]) for x in r["near"]] for r in scores.nearest_places(scores.places(rows, ["frame"], 8), 8, 0.5, ["frame"]).collect()}
    assert near == {0: [(0.0, i, 0) for i in (0, 1, 2, 3, 4, 5, 6, 8)], 7: [(0.0, 7, 7), *((1.0, i, 0) for i in (0, 1, 2, 3, 4, 5, 6))]}
