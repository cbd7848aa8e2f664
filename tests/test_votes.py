"""Votes of whole scans against brute force."""

from __future__ import annotations

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomfield.functions import keys as K
from loomfield.operators import field, scans, votes
from loomfield.plans import mapping, registry
from loomfield.plans import surrogates as S
from loomfield.plans.catalog import ORACLES, QUERIES
from tests.oracle import differences

TINY = "/root/testdata/sf0.001"
AROUND = list(itertools.product((-1, 0, 1), repeat=3))


def brute_votes(nodes: dict, ends: dict, clearance: float, radius: float) -> dict:
    """Free scans of each node (x, y, z) -> normal or None by walking every ray from the origin in steps of one."""
    free: dict = {}
    for rays in ends.values():
        passed, hit = set(), set()
        for e in np.array(rays):
            length = np.sqrt(e @ e)
            if length <= clearance:
                continue
            u = e / length
            at = {tuple(v) for v in np.rint(np.outer(np.arange(np.floor(length + clearance + 1) + 1), u)).astype(int).tolist()}
            near = sorted({(x + i, y + j, z + k) for x, y, z in at for i, j, k in AROUND} & nodes.keys())
            for p in near:
                v, n = np.array(p, float), nodes[p]
                along, p2 = v @ u, v @ v
                if p2 <= clearance * clearance:
                    continue
                close = along > 0 and p2 - along * along <= radius * radius
                if close and abs(length - along) < clearance:
                    hit.add(p)
                if n is None:
                    passes = close and length >= along + clearance
                else:
                    facing = n @ u
                    t = n @ v / facing if abs(facing) > 1e-6 else -1.0
                    passes = t > 0 and ((u * t - v) ** 2).sum() <= radius * radius and length >= t + clearance
                if passes:
                    passed.add(p)
        for k in passed - hit:
            free[k] = free.get(k, 0) + 1
    return free


def test_pass_votes_of_whole_scans(spark):
    place = lambda k: ((k >> 42) - (1 << 20), (k >> 21 & (1 << 21) - 1) - (1 << 20), (k & (1 << 21) - 1) - (1 << 20))
    n = field.cut(registry.nodes(spark, TINY))
    rays = field.cut(S.returns(spark, TINY).where("frame % 10 <> 5 AND pt < 40"))
    with_normals = n.select("k").join(field.normals(n), "k", "left")
    nodes = {place(r["k"]): None if r["nx"] is None else np.array([r["nx"], r["ny"], r["nz"]]) for r in with_normals.collect()}
    ends: dict = {}
    for r in rays.collect():
        ends.setdefault(r["frame"], []).append((r["x"], r["y"], r["z"]))
    asked = rays.select(F.col("frame").alias("scan"), F.col("pt").alias("ray"), *[F.lit(0.0).alias(f"o{a}") for a in "xyz"], *[F.col(a).alias(f"e{a}") for a in "xyz"])
    want = brute_votes(nodes, ends, 2.5, 1.5)
    got = votes.pass_votes(with_normals, asked, 1.0, 2.5, 1.5)
    assert {place(r["k"]): r["n_free"] for r in got.collect()} == want
    counted = votes.scan_votes(with_normals, asked, 1.0, 2.5, 1.5, count_rays=True)
    assert {place(r["k"]): r["n"] for r in counted.groupBy("k").agg(F.count("scan").alias("n")).collect()} == want
    assert counted.where("n_rays < 1").isEmpty()


def test_shuffled_nodes_give_the_same_votes(spark):
    nodes = spark.range(3, 40, 4).select(F.col("id") * K.STEP["x"] + F.lit(K.STEP["x"] * (1 << 20) + K.STEP["y"] * (1 << 20) + (1 << 20)))
    nodes = nodes.toDF("k")
    rays = spark.createDataFrame([(i % 4, 0.0, 0.0, 0.0, 12.0 + i, 0.1 * i, 0.0) for i in range(24)], "scan int, ox double, oy double, oz double, ex double, ey double, ez double")
    got = [sorted(map(tuple, votes.pass_votes(nodes, rays, 1.0, 2.5, 1.5, normals=False, broadcast_nodes=n).collect())) for n in (0, 100)]
    assert got[0] and got[0] == got[1]


def test_pass_votes_budget_is_the_reference_one(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(scans, "even_subsample", lambda points, most, *_: asked.append(most) or points)
    registry.QUERIES["pass_votes"](spark, TINY)
    assert asked == [12_000]


def test_regions_sum_samples_once(spark, monkeypatch):
    asked = []
    plain = field.prefixes
    monkeypatch.setattr(field, "prefixes", lambda *a: asked.append(1) or plain(*a))
    mapping.region(spark, TINY)
    assert asked == [1]


@pytest.mark.parametrize("name", ["pass_votes", "block_votes", "ray_reach", "solve_region", "solved_region", "unit_evidence"])
def test_all_rays_of_long_scans_vote(spark, monkeypatch, name):
    monkeypatch.setattr(registry, "MAX_RAYS_PER_SCAN", 7)
    assert differences(spark, name, TINY, QUERIES, ORACLES) == []


def test_first_rays_only_spare_tests(spark):
    n = registry.nodes(spark, TINY)
    nodes = field.cut(n.select("k").join(field.normals(n), "k", "left"))
    rays = field.cut(registry.rays(S.returns_plain(spark, TINY)))
    want = sorted(map(tuple, votes.scan_votes(nodes, rays, 1.0, 2.5, 1.5).collect()))
    for first in (rays.where("ex < 20"), rays, rays.where("false")):
        assert sorted(map(tuple, votes.scan_votes(nodes, rays, 1.0, 2.5, 1.5, first=first).collect())) == want
