"""Free-space votes: which nodes do rays pass, and which do they hit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomfield.functions import keys as K

from .cut import cut


def _tested(nodes: DataFrame, rays: DataFrame, voxel: float, clearance: float, radius: float, normals: bool, on: list[str], carried: list[str], prefilter: int, few: bool, ends: bool = False) -> DataFrame:
    """(carried, k, pass, hit) of each step of a ray that meets a node of its ``on``; with ``ends`` only of steps that can meet a hit node."""
    hint = (lambda df: F.broadcast(df)) if few else (lambda df: df)
    d = {a: F.col(f"e{a}") - F.col(f"o{a}") for a in "xyz"}
    length = F.sqrt(d["x"] * d["x"] + d["y"] * d["y"] + d["z"] * d["z"])
    r = rays.select(*carried, "ox", "oy", "oz", *[(c / length).alias(f"u{a}") for a, c in d.items()], length.alias("len")).where(F.col("len") > clearance)
    # a step meets nodes up to 1.5 voxels away on each axis
    start = F.greatest(F.lit(0), F.floor((F.col("len") - clearance) / voxel).cast("int") - 3) if ends else F.lit(0)
    steps = F.sequence(start, F.floor((F.col("len") + clearance + voxel) / voxel).cast("int"))
    r = r.select("*", F.explode(steps).alias("i"))
    at = [F.rint((F.col(f"o{a}") + F.col(f"u{a}") * F.col("i") * voxel) / voxel).cast("bigint") for a in "xyz"]
    r = r.select(*carried, "ox", "oy", "oz", "ux", "uy", "uz", "len", K.pack(*at).alias("v"))
    cubes = nodes.select(*on, F.explode(K.offsets(K.AROUND)).alias("s"), "k").select(*on, K.block_of(F.col("k") + F.col("s"), prefilter).alias("cube")).distinct()
    r = r.withColumn("cube", K.block_of(F.col("v"), prefilter)).join(hint(cubes), [*on, "cube"], "left_semi").drop("cube")
    asked = r.withColumn("step", F.explode(K.offsets(K.AROUND))).withColumn("k", F.col("v") + F.col("step")).drop("v", "step")
    met = asked.join(hint(nodes), [*on, "k"])
    # one column a step, as later ones use the earlier several times
    met = met.withColumns({f"p{a}": c * voxel - F.col(f"o{a}") for a, c in zip("xyz", K.unpack(F.col("k")))})
    dot = lambda u, v: sum((F.col(f"{u}{a}") * F.col(f"{v}{a}") for a in "xyz"), F.lit(0.0))
    met = met.withColumns({"along": dot("p", "u"), "p2": dot("p", "p")})
    # no filter here: the optimizer would write all of this into the join's condition again and again
    close = (F.col("p2") > clearance * clearance) & (F.col("along") > 0) & (F.col("p2") - F.col("along") * F.col("along") <= radius * radius)
    passes = close & (F.col("len") >= F.col("along") + clearance)
    if normals:
        met = met.withColumns({"facing": dot("n", "u"), "plane": dot("n", "p")})
        met = met.withColumn("t", F.when(F.abs("facing") > 1e-6, F.col("plane") / F.col("facing")))
        side2 = sum(((F.col(f"u{a}") * F.col("t") - F.col(f"p{a}")) * (F.col(f"u{a}") * F.col("t") - F.col(f"p{a}")) for a in "xyz"), F.lit(0.0))
        crosses = (F.col("p2") > clearance * clearance) & (F.col("t") > 0) & (side2 <= radius * radius) & (F.col("len") >= F.col("t") + clearance)
        passes = F.when(F.col("nx").isNotNull(), F.coalesce(crosses, F.lit(False))).otherwise(passes)
    hits = close & (F.abs(F.col("len") - F.col("along")) < clearance)
    return met.select(*carried, "k", passes.alias("pass"), hits.alias("hit"))


def scan_votes(nodes: DataFrame, rays: DataFrame, voxel: float, clearance: float, radius: float, normals: bool = True, by: list[str] | None = None, least_rays: int = 1, count_rays: bool = False, prefilter: int = 8, broadcast_nodes: int = 1_000_000, first: DataFrame | None = None) -> DataFrame:
    """(by, k, scan): scans with ``least_rays`` rays that pass the node and none that hits it; if asked also those rays as n_rays.

    A ray becomes one row per voxel step; steps in cubes of ``prefilter`` voxels without a node near are
    dropped before each of the rest asks the 27 nodes around it, an equi-join on keys; the exact tests
    are residuals. Up to ``broadcast_nodes`` nodes are broadcast, so that steps stay in the task of their
    ray; more are joined by a shuffle. ``nodes``: by, k and, with ``normals``, nx, ny, nz; ``rays``: by, scan,
    ox..oz, ex..ez, and ray where rays are counted.

    ``first`` are some of the rays of long scans. They are asked for hits before the others: a hit decides a node
    of a scan, whatever the other rays are, so all rays are then tested only against the nodes that stay open.
    """
    by = by or []
    nodes = cut(nodes)  # it is counted, makes the cubes and meets the rays
    few = nodes.count() <= broadcast_nodes
    on, single = by, ["ray"] if count_rays or least_rays > 1 else []
    if first is not None:
        hit = _tested(nodes, first, voxel, clearance, radius, False, by, [*by, "scan"], prefilter, few, ends=True)
        hit = hit.groupBy(*by, "k", "scan").agg(F.max("hit").alias("hit")).where("hit").select(*by, "k", "scan")
        ends = [f(f"o{a}").alias(f"{m}{a}") for a in "xyz" for m, f in (("low", F.min), ("high", F.max))]
        seen = F.broadcast(rays.groupBy(*by, "scan").agg(*ends))  # a row a scan, each of thousands of rays
        pairs = nodes.join(seen, by) if by else nodes.crossJoin(seen)
        # a node within the clearance of all places that rays start from is neither passed nor hit
        far = [F.greatest(F.abs(c * voxel - F.col(f"low{a}")), F.abs(c * voxel - F.col(f"high{a}"))) for a, c in zip("xyz", K.unpack(F.col("k")))]
        pairs = pairs.where(sum((c * c for c in far), F.lit(0.0)) > clearance * clearance).select(*nodes.columns, "scan")
        nodes, on = cut(pairs.join(hit, [*by, "k", "scan"], "left_anti")), [*by, "scan"]
        open_pairs = nodes.count()
        few, prefilter = open_pairs <= broadcast_nodes, 1 if open_pairs * 27 <= broadcast_nodes else prefilter
    tests = _tested(nodes, rays, voxel, clearance, radius, normals, on, [*by, "scan", *single], prefilter, few)
    per_scan = tests.groupBy(*by, "k", "scan", *single).agg(F.max("pass").alias("pass"), F.max("hit").alias("hit"))
    if not single:  # one ray is enough, and meeting a node in several steps changes nothing
        return per_scan.where("pass AND NOT hit").select(*by, "k", "scan")
    counted = per_scan.groupBy(*by, "k", "scan").agg(F.count_if("pass").alias("n_rays"), F.max("hit").alias("hit"))
    return counted.where((F.col("n_rays") >= least_rays) & ~F.col("hit")).select(*by, "k", "scan", "n_rays")


def pass_votes(nodes: DataFrame, rays: DataFrame, voxel: float, clearance: float, radius: float, normals: bool = True, broadcast_nodes: int = 1_000_000, first: DataFrame | None = None) -> DataFrame:
    """(k, n_free): in how many scans a ray passes the node and none hits it."""
    return scan_votes(nodes, rays, voxel, clearance, radius, normals, broadcast_nodes=broadcast_nodes, first=first).groupBy("k").agg(F.count(F.lit(1)).alias("n_free"))


def candidates(c: str = "value_sum", w: str = "weight_sum") -> Column:
    """Nodes inside the fused surface: only they can be voted on."""
    return (F.col(w) > 0) & (F.col(c) <= 0)


def block_votes(nodes: DataFrame, rays: DataFrame, voxel: float, clearance: float, radius: float, least_rays: int = 1, count_rays: bool = False, first: DataFrame | None = None) -> DataFrame:
    """(c, k, n_scans): nodes that temporal block c votes on, once whatever its scans; if asked also n_rays.

    ``nodes`` has the candidates of each block with their normals, ``rays`` the block c they belong to.
    """
    found = scan_votes(nodes, rays, voxel, clearance, radius, by=["c"], least_rays=least_rays, count_rays=count_rays, first=first)
    return found.groupBy("c", "k").agg(F.count(F.lit(1)).alias("n_scans"), *([F.sum("n_rays").alias("n_rays")] if count_rays else []))


def along_ray(returns: DataFrame, voxel: float) -> DataFrame:
    """Samples along each ray around its return: values fall from +1 to -1 through the surface.

    ``returns``: id, x, y, z, dx, dy, dz (unit ray), range, cosine, trunc, tau, conf.
    """
    half = F.greatest(F.lit(2), F.ceil(F.col("trunc") / voxel)).cast("int")
    rows = returns.where((F.col("range") > F.col("trunc") + 1e-6) & (F.col("conf") > 0)).select("*", half.alias("half")).select("*", F.explode(F.sequence(-F.col("half"), F.col("half"))).alias("i"))
    offset = F.col("trunc") * F.col("i") / F.col("half")
    cosine = F.greatest(F.least(F.abs("cosine"), F.lit(1.0)), F.lit(0.05))
    value = F.greatest(F.least(-offset * cosine / F.col("trunc"), F.lit(1.0)), F.lit(-1.0))
    thick = offset * cosine / F.col("tau")
    return rows.select("id", "i", *[(F.col(a) + F.col(f"d{a}") * offset).alias(a) for a in "xyz"], value.alias("value"), ((1 - 0.35 * F.abs(value)) * F.col("conf") * F.exp(-0.5 * thick * thick)).alias("weight"))
