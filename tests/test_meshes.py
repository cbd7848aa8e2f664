"""Joins of rays and points with triangles, and connected parts, on small meshes."""

from __future__ import annotations

import random

import pytest

from loomfield.operators import meshes, scans, surface


def tri(spark, *corners):
    kind = "struct<x:double,y:double,z:double>"
    return spark.createDataFrame([tuple(tuple(map(float, p)) for p in t) for t in corners], f"pa {kind}, pb {kind}, pc {kind}")


def test_first_hit_of_a_ray(spark):
    t = tri(spark, ((0, 0, 5), (4, 0, 5), (0, 4, 5)), ((0, 0, 9), (4, 0, 9), (0, 4, 9)), ((20, 0, 0), (21, 0, 0), (20, 1, 0)))
    rays = spark.createDataFrame([(1, 1.0, 1.0, 0.0, 1.0, 1.0, 12.0), (2, 3.0, 3.0, 0.0, 3.0, 3.0, 12.0), (3, 1.0, 1.0, 12.0, 1.0, 1.0, 0.0), (4, 1.0, 1.0, 0.0, 1.0, 1.0, 4.0)], "id long, ox double, oy double, oz double, ex double, ey double, ez double")
    assert {r["id"]: r["t"] for r in meshes.ray_hits(rays, t, 2.0).collect()} == {1: 5.0, 3: 3.0}


def test_distance_over_faces_edges_and_corners(spark):
    t = tri(spark, ((0, 0, 0), (4, 0, 0), (0, 4, 0)))
    points = spark.createDataFrame([(1, 1.0, 1.0, 2.0), (2, 2.0, -3.0, 0.0), (3, -3.0, -4.0, 0.0), (4, 1.0, 1.0, 30.0)], "pid long, x double, y double, z double")
    assert {r["pid"]: round(r["d"], 9) for r in meshes.surface_distance(points, t, 6.0).collect()} == {1: 2.0, 2: 3.0, 3: 5.0}


def test_components_are_those_of_the_edges(spark):
    rnd = random.Random(1)
    faces = [(i, i + 1, i + 2) for i in range(20)] + [tuple(100 + x for x in rnd.sample(range(60), 3)) for _ in range(14)]
    root: dict[int, int] = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b, c in faces:
        for v in (b, c):
            low, high = sorted((find(a), find(v)))
            root[high] = low
    got = {r["v"]: r["label"] for r in surface.components(spark.createDataFrame(faces, "a long, b long, c long")).collect()}
    assert got == {v: find(v) for v in list(root)}


def test_frame_selections():
    assert scans.parse_frames("train:0-9, 12,20-22:skip5mod10") == [(0, 10, True), (12, 13, False), (20, 23, True)]
    for bad in ("5-3", "3,2", "x", "1-4,4"):
        with pytest.raises(ValueError):
            scans.parse_frames(bad)
