"""DuckDB SQL for the registered queries of the spatial operators."""

from __future__ import annotations

_RET = """r0 AS (SELECT CAST(l_orderkey % 60 AS INTEGER) AS frame, CAST((l_orderkey % 60) // 10 AS INTEGER) AS block,
  row_number() OVER (PARTITION BY l_orderkey % 60 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) - 1 AS pt,
  l_quantity + 0.37e0 * l_linenumber AS x, l_extendedprice / 2000e0 AS y, l_discount * 100e0 + 0.13e0 AS z,
  1e0 - 2e0 * l_tax / 0.08e0 AS value, 1.5e0 - 5e0 * l_discount AS weight, l_partkey * 997 % 100000000 AS off_ns FROM lineitem)"""
_TRAJ = """tr AS (SELECT user_id, event_id, epoch_us(ts) * 1000 AS t_ns, value AS px, CAST(event_id % 100 AS DOUBLE) AS py, CAST(user_id AS DOUBLE) AS pz,
  0e0 AS qx, 0e0 AS qy, sin(value / 2) AS qz, cos(value / 2) AS qw FROM events)"""
_CLOUD = "cl AS (SELECT vec_id AS pid, embedding[1]::DOUBLE * 10 AS x, embedding[2]::DOUBLE * 10 AS y, embedding[3]::DOUBLE * 10 AS z, label FROM embeddings)"
_O, _X, _Y = 1 << 20, 1 << 42, 1 << 21


def cell(c: str, size: float | None = None) -> str:
    return f"CAST(floor({c}) AS BIGINT)" if size is None else f"CAST(floor(({c}) / {size}e0) AS BIGINT)"


def pack(x: str, y: str, z: str) -> str:
    return f"(({x} + {_O}) * {_X} + ({y} + {_O}) * {_Y} + ({z} + {_O}))"


def key(size: float | None = None) -> str:
    return pack(cell("x", size), cell("y", size), cell("z", size))


def unpack(k: str) -> tuple[str, str, str]:
    return f"({k} // {_X} - {_O})", f"({k} // {_Y} % {_Y} - {_O})", f"({k} % {_Y} - {_O})"


def block_of(k: str, cells: int) -> str:
    return pack(*[f"CAST(floor({c} / {cells}e0) AS BIGINT)" for c in unpack(k)])


def q(*ctes: str, body: str) -> str:
    return "WITH " + ", ".join(ctes) + " " + body


def r6(c: str, name: str, n: int = 6) -> str:
    return f"round({c}, {n}) AS {name}"


_SMP = "smp AS (SELECT frame, block, x, y, z, value, weight FROM r0 WHERE frame % 10 <> 5 AND weight > 0)"


def _spl(name: str, by: str, src: str = "smp") -> str:
    return f"""{name} AS (SELECT {by} k, sum(value * w) AS value_sum, sum(w) AS weight_sum, max(w) AS weight_max FROM (
  SELECT {by} value, {pack('bx + i', 'by_ + j', 'bz + kk')} AS k,
    weight * (CASE WHEN i = 1 THEN x - bx ELSE 1 - (x - bx) END) * (CASE WHEN j = 1 THEN y - by_ ELSE 1 - (y - by_) END) * (CASE WHEN kk = 1 THEN z - bz ELSE 1 - (z - bz) END) AS w
  FROM (SELECT *, {cell('x')} AS bx, {cell('y')} AS by_, {cell('z')} AS bz FROM {src}), (SELECT unnest([0, 1]) AS i), (SELECT unnest([0, 1]) AS j), (SELECT unnest([0, 1]) AS kk)) WHERE w > 1e-5 GROUP BY {by} k)"""


_BLK = _spl("sb", "block,")
_BND = "bnd AS (SELECT block, k, value_sum * least(weight_max, weight_sum) / weight_sum AS value_sum, least(weight_max, weight_sum) AS weight_sum FROM sb)"
_FUS = "fus AS (SELECT k, sum(value_sum) AS value_sum, sum(weight_sum) AS weight_sum, count(DISTINCT block) AS hit_count, bit_or(1::BIGINT << block) AS mask FROM bnd GROUP BY k)"
_NOD = "nod AS MATERIALIZED (SELECT k, round(coalesce(value_sum / nullif(weight_sum, 0), 0), 6) AS s, round(weight_sum, 6) AS w, hit_count AS h FROM fus)"
_FIELD = (_RET, _SMP, _BLK, _BND, _FUS, _NOD)
_VOT = "vot AS (SELECT k, w, h, s AS s0, CASE WHEN w > 0 AND s <= 0 THEN k % 3 ELSE 0 END AS p FROM nod)"
_H = "(CASE WHEN w > 0 THEN h / 3e0 ELSE 0e0 END)"
_P = "(p / 3e0)"
_MIRROR = f"CASE WHEN {_H} + {_P} > 0 AND s0 <= 0 THEN -greatest(abs(s0), 0.012e0) * ({_H} - {_P}) / ({_H} + {_P}) ELSE s0 END"
_FACES = f"(SELECT unnest([{_X}, -{_X}, {_Y}, -{_Y}, 1, -1]) AS step)"
_AROUND = f"(SELECT a * {_X} + b * {_Y} + c AS step FROM (SELECT unnest([-1, 0, 1]) AS a), (SELECT unnest([-1, 0, 1]) AS b), (SELECT unnest([-1, 0, 1]) AS c))"


def _jacobi() -> str:
    ctes = [*_FIELD, _VOT, f"j0 AS MATERIALIZED (SELECT k, s0 AS s, {_MIRROR} AS target, {_H} + {_P} AS c, {block_of('k', 8)} % 2 = 0 AS inside FROM vot)"]
    for i in range(3):
        ctes.append(f"m{i} AS (SELECT a.k, sum(b.s) AS nv, count(*) AS deg FROM (SELECT k, k + step AS o FROM j{i}, {_FACES}) a JOIN j{i} b ON b.k = a.o GROUP BY a.k)")
        ctes.append(
            f"j{i + 1} AS MATERIALIZED (SELECT k, CASE WHEN inside AND c + la > 0 THEN s + 0.8e0 * ((c * target + la * coalesce(nv / deg, 0)) / (c + la) - s) ELSE s END AS s, target, c, inside "
            f"FROM (SELECT j{i}.*, nv, deg, CASE WHEN coalesce(deg, 0) > 0 THEN 1e0 ELSE 0e0 END AS la FROM j{i} LEFT JOIN m{i} USING (k)))"
        )
    return q(*ctes, body=f"SELECT k, {r6('s + 3e-8', 's', 4)} FROM j3")


_MOM = lambda name, sizes, by, where="TRUE": f"""{name} AS (SELECT {by} level, k, count(*) AS n, sum(dx) AS sx, sum(dy) AS sy, sum(dz) AS sz, sum(dx * dx) AS mxx, sum(dx * dy) AS mxy, sum(dx * dz) AS mxz, sum(dy * dy) AS myy, sum(dy * dz) AS myz, sum(dz * dz) AS mzz FROM (
  SELECT frame, level, {pack('cx', 'cy', 'cz')} AS k, x - (cx + 0.5e0) * size AS dx, y - (cy + 0.5e0) * size AS dy, z - (cz + 0.5e0) * size AS dz FROM (
    SELECT frame, x, y, z, level, size, CAST(floor(x / size) AS BIGINT) AS cx, CAST(floor(y / size) AS BIGINT) AS cy, CAST(floor(z / size) AS BIGINT) AS cz
    FROM r0, (VALUES {', '.join(f'({i}, {s}e0)' for i, s in enumerate(sizes))}) AS l(level, size) WHERE {where})) GROUP BY {by} level, k)"""  # noqa: E731
_LEVELS = (2.0, 4.0, 8.0)

_ASOF = """seg AS (SELECT *, lead(t_ns) OVER w AS t1, lead(px) OVER w AS px1, lead(py) OVER w AS py1, lead(pz) OVER w AS pz1, lead(qz) OVER w AS qz1, lead(qw) OVER w AS qw1 FROM tr WINDOW w AS (PARTITION BY user_id ORDER BY t_ns)),
a AS (SELECT q.user_id, q.event_id AS query_id, q.t_ns + 1800000000000 AS t FROM tr q),
j AS (SELECT a.user_id, a.query_id, a.t, s.* EXCLUDE (user_id) FROM a ASOF JOIN seg s ON a.user_id = s.user_id AND a.t >= s.t_ns),
f AS (SELECT *, t = t_ns AS ex, CASE WHEN t = t_ns THEN 0e0 ELSE (t - t_ns) / CAST(t1 - t_ns AS DOUBLE) END AS f FROM j WHERE t = t_ns OR (t1 IS NOT NULL AND t1 - t_ns <= 43200000000000)),
d AS (SELECT *, CASE WHEN ex THEN qz ELSE qz1 END AS bz, CASE WHEN ex THEN qw ELSE qw1 END AS bw FROM f),
e AS (SELECT *, CASE WHEN qz * bz + qw * bw < 0 THEN -1e0 ELSE 1e0 END AS sg, least(abs(qz * bz + qw * bw), 1e0) AS dd FROM d),
g AS (SELECT *, CASE WHEN dd > 0.9995e0 THEN 1 - f ELSE sin((1 - f) * acos(dd)) / sin(acos(dd)) END AS wa, sg * CASE WHEN dd > 0.9995e0 THEN f ELSE sin(f * acos(dd)) / sin(acos(dd)) END AS wb FROM e),
h AS (SELECT *, wa * qz + wb * bz AS z, wa * qw + wb * bw AS w FROM g)"""

_NEAR = """n AS (SELECT user_id, event_id AS query_id, t_ns FROM tr WHERE event_id % 3 = 0), s AS (SELECT user_id, t_ns FROM tr WHERE event_id % 3 <> 0),
b AS (SELECT n.*, s.t_ns AS b FROM n ASOF LEFT JOIN s ON n.user_id = s.user_id AND n.t_ns >= s.t_ns),
a AS (SELECT b.*, s.t_ns AS a FROM b ASOF LEFT JOIN s ON b.user_id = s.user_id AND b.t_ns <= s.t_ns),
c AS (SELECT user_id, query_id, t_ns, CASE WHEN b IS NOT NULL AND (a IS NULL OR t_ns - b <= a - t_ns) THEN b ELSE a END AS nearest_ns FROM a WHERE coalesce(a, b) IS NOT NULL),
pn AS (SELECT user_id, query_id, nearest_ns, abs(t_ns - nearest_ns) AS distance_ns FROM c)"""

_RAY = "ray AS (SELECT frame * 10000000 + pt AS id, x, y, z, x / sqrt(x*x + y*y + z*z) AS dx, y / sqrt(x*x + y*y + z*z) AS dy, z / sqrt(x*x + y*y + z*z) AS dz, sqrt(x*x + y*y + z*z) AS range, 0.5e0 + frame % 3 AS trunc, weight AS conf FROM r0)"
_HELD = """ho AS (SELECT frame, CASE WHEN e < 5 THEN '0-5' WHEN e < 15 THEN '5-15' WHEN e < 30 THEN '15-30' ELSE '30+' END AS band, e AS expected,
 CASE WHEN off_ns % 7 <> 0 THEN e + (off_ns % 31 - 15) / 100e0 END AS hit FROM (SELECT *, sqrt(x*x + y*y + z*z) AS e FROM r0 WHERE frame % 10 = 5)),
df AS (SELECT *, hit - expected AS diff FROM ho)"""
_METRICS = ", ".join(["count(*) AS n", "round(avg(CASE WHEN hit IS NOT NULL THEN 1e0 ELSE 0e0 END), 6) AS hit_share", "round(quantile_cont(abs(diff), 0.5), 6) AS median", "round(quantile_cont(abs(diff), 0.9), 6) AS p90"] + [f"round(avg(CASE WHEN {c} THEN 1e0 ELSE 0e0 END), 6) AS {n}_{cm}" for cm in (2, 5, 10) for n, c in (("agree", f"abs(diff) <= {cm} / 100e0"), ("violate", f"diff < -({cm} / 100e0)"), ("missing", f"diff > {cm} / 100e0 OR diff IS NULL"))])
_CORNERS = [(i, j, k) for i in (0, 1) for j in (0, 1) for k in (0, 1)]


def _step(c: tuple[int, int, int]) -> int:
    return c[0] * _X + c[1] * _Y + c[2]


def _cubes() -> list[str]:
    """Cubes from all near nodes (not from crossing edges), so that the plan differs from the query's."""
    wide = ", ".join(f"coalesce(max(CASE WHEN i = {i} THEN s END), 1e0) AS v{i}" for i in range(8))
    edges = [(a, b) for a in range(8) for b in range(8) if a < b and sum(x != y for x, y in zip(_CORNERS[a], _CORNERS[b])) == 1]
    on = [f"((v{a} < 0) <> (v{b} < 0))" for a, b in edges]
    t = [f"least(greatest(v{a} / (v{a} - v{b}), 0e0), 1e0)" for a, b in edges]
    n = " + ".join(f"CASE WHEN {c} THEN 1 ELSE 0 END" for c in on)
    mean = [" + ".join(f"CASE WHEN {c} THEN {float(_CORNERS[a][d])}e0 + {_CORNERS[b][d] - _CORNERS[a][d]} * {x} ELSE 0e0 END" for c, x, (a, b) in zip(on, t, edges)) for d in range(3)]
    corner = ", ".join(f"({i}, {_step(c)})" for i, c in enumerate(_CORNERS))
    return [
        "gat AS (SELECT k, s FROM nod WHERE w >= 0.1)",
        f"wid AS (SELECT k - step AS cube, count(*) AS observed, {wide} FROM gat, (VALUES {corner}) AS c(i, step) GROUP BY 1 HAVING count(*) >= 3)",
        f"cub AS (SELECT cube, observed, {n} AS n, {', '.join(f'({m}) AS m{a}' for a, m in zip('xyz', mean))} FROM wid)",
        "ver AS MATERIALIZED (SELECT cube, CAST(observed AS INTEGER) AS observed, CAST(n AS INTEGER) AS n, mx / n AS x, my / n AS y, mz / n AS z FROM cub WHERE n > 0)",
    ]


_TURN = [[0.955336489125606, -0.29552020666133955, 0.0], [0.29552020666133955, 0.955336489125606, 0.0], [0.0, 0.0, 1.0]]
_SHIFT = (1.0, -2.0, 0.5)
_TP = [f"({r[0]}e0 * x + {r[1]}e0 * y + {r[2]}e0 * z + {s}e0)" for r, s in zip(_TURN, _SHIFT)]
_U = "(CASE WHEN abs(dz) > 0.9e0 THEN {a} ELSE {b} END)"


def _basis(src: str) -> list[str]:
    """Across a unit direction (dx, dy, dz) of ``src``."""
    # d x (1, 0, 0) = (0, dz, -dy); d x (0, 0, 1) = (dy, -dx, 0)
    return [
        f"u0 AS (SELECT *, CASE WHEN abs(dz) > 0.9 THEN 0e0 ELSE dy END AS ax, CASE WHEN abs(dz) > 0.9 THEN dz ELSE -dx END AS ay, CASE WHEN abs(dz) > 0.9 THEN -dy ELSE 0e0 END AS az FROM {src})",
        "u1 AS (SELECT * EXCLUDE (ax, ay, az), ax / sqrt(ax*ax + ay*ay + az*az) AS ux, ay / sqrt(ax*ax + ay*ay + az*az) AS uy, az / sqrt(ax*ax + ay*ay + az*az) AS uz FROM u0)",
        "u2 AS (SELECT *, dy * uz - dz * uy AS vx, dz * ux - dx * uz AS vy, dx * uy - dy * ux AS vz FROM u1)",
    ]


_DIR = "dir AS (SELECT frame, pt, x / sqrt(x*x + y*y + z*z) AS dx, y / sqrt(x*x + y*y + z*z) AS dy, z / sqrt(x*x + y*y + z*z) AS dz FROM r0)"
_BEF = [_spl("sbb", "block,", "(SELECT * FROM smp WHERE block < 5)"), "bbd AS (SELECT block, k, value_sum * least(weight_max, weight_sum) / weight_sum AS value_sum, least(weight_max, weight_sum) AS weight_sum FROM sbb)", "bef AS (SELECT k, round(coalesce(sum(value_sum) / nullif(sum(weight_sum), 0), 0), 6) AS s_old, round(sum(weight_sum), 6) AS w_old FROM bbd GROUP BY k)", "dirt AS (SELECT coalesce(n.k, b.k) AS k FROM nod n FULL JOIN bef b ON n.k = b.k WHERE s IS NULL OR s_old IS NULL OR (s < 0) <> (s_old < 0) OR abs(s - s_old) > 0.0125 OR (w >= 0.1) <> (w_old >= 0.1) OR abs(exp(-w / 2) - exp(-w_old / 2)) > 0.05)"]
_DAYS = "dy AS (SELECT (epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events)) // 86400000000 AS block, CAST(floor(value * 1000) AS BIGINT) AS work FROM events)"

ORACLES: dict[str, str] = {
    "key_roundtrip": q(_RET, body=f"SELECT frame, pt, {key()} AS k, {cell('x')} AS kx, {cell('y')} AS ky, {cell('z')} AS kz FROM r0"),
    "block_key": q(_RET, body=f"SELECT {pack(cell('x', 16.0), cell('y', 16.0), cell('z', 16.0))} AS block_key, count(*) AS n FROM r0 GROUP BY 1"),
    "mask_bits": q(_RET, body="SELECT block, bit_or(1::BIGINT << frame) AS mask, CAST(count(DISTINCT frame) AS INTEGER) AS n_frames FROM r0 GROUP BY block"),
    "rigid_transform": q(_RET, body=f"SELECT frame, pt, {', '.join(r6(c, f't{a}') for a, c in zip('xyz', _TP))}, round(x, 6) AS bx, round(y, 6) AS by, round(z, 6) AS bz FROM r0"),
    "quat_matrix": q(_TRAJ, body="SELECT event_id, round(cos(px), 6) AS m00, round(-sin(px), 6) AS m01, 0e0 AS m02, round(sin(px), 6) AS m10, round(cos(px), 6) AS m11, 0e0 AS m12, 0e0 AS m20, 0e0 AS m21, 1e0 AS m22 FROM tr"),
    "default_basis": q(_RET, _DIR, *_basis("dir"), body="SELECT frame, pt, round(ux, 6) AS ux, round(uy, 6) AS uy, round(uz, 6) AS uz, round(vx, 6) AS vx, round(vy, 6) AS vy, round(vz, 6) AS vz FROM u2"),
    "eig3": q(
        _RET, _MOM("mo", (16.0,), "frame,"),
        "cv AS (SELECT frame, k, mxx/n - sx*sx/(n*n) AS a, mxy/n - sx*sy/(n*n) AS b, mxz/n - sx*sz/(n*n) AS c, myy/n - sy*sy/(n*n) AS d, myz/n - sy*sz/(n*n) AS e, mzz/n - sz*sz/(n*n) AS f FROM mo WHERE n >= 3)",
        "c1 AS (SELECT *, (a + d + f) / 3 AS q FROM cv)", "c2 AS (SELECT *, sqrt(((a-q)*(a-q) + (d-q)*(d-q) + (f-q)*(f-q) + 2*(b*b + c*c + e*e)) / 6) AS p FROM c1)",
        "c3 AS (SELECT *, greatest(least(((a-q)*((d-q)*(f-q) - e*e) - b*(b*(f-q) - e*c) + c*(b*e - (d-q)*c)) / (2 * p*p*p), 1e0), -1e0) AS r FROM c2)",
        body="SELECT frame, k, round(q + 2*p*cos(acos(r)/3 + 2*pi()/3), 4) AS e0, round(3*q - (q + 2*p*cos(acos(r)/3)) - (q + 2*p*cos(acos(r)/3 + 2*pi()/3)), 4) AS e1, round(q + 2*p*cos(acos(r)/3), 4) AS e2 FROM c3",
    ),
    "angle_wrap": q(_TRAJ, body="SELECT event_id, round(atan2(sin(px), cos(px)), 6) AS a FROM tr"),
    "projection": q(_RET, body="SELECT frame, pt, round(400e0 * x / (z + 5e0) + 320e0, 6) AS u, round(400e0 * y / (z + 5e0) + 240e0, 6) AS v, round(z + 5e0, 6) AS depth FROM r0 WHERE z + 5e0 > 6e0"),
    "confidence_colour": q(_RET, body="SELECT frame, pt, CAST(round_even(255 * greatest(least(weight / 1.5e0, 1e0), 0e0), 0) AS BIGINT) AS r, CAST(round_even(255 * (1 - greatest(least(weight / 1.5e0, 1e0), 0e0)), 0) AS BIGINT) AS g FROM r0"),
    "range_filter": q(_RET, body="SELECT frame, count(*) AS n FROM r0 WHERE sqrt(x*x + y*y + z*z) BETWEEN 10 AND 45 GROUP BY frame"),
    "frame_select": q(_RET, body="SELECT frame, count(*) AS n FROM r0 WHERE frame < 40 AND frame % 10 <> 5 GROUP BY frame"),
    "even_subsample": q(_RET, "m AS (SELECT frame, count(*) AS n FROM r0 GROUP BY frame)", body="SELECT frame, pt FROM r0 JOIN m USING (frame) WHERE n <= 37 UNION SELECT frame, CASE WHEN i = 36 THEN n - 1 ELSE CAST(floor(i * (n - 1) / 36e0) AS BIGINT) END FROM m, (SELECT unnest(generate_series(0, 36)) AS i) WHERE n > 37"),
    "dedup_dual": "WITH e AS (SELECT event_id, epoch_us(ts) AS us, lag(epoch_us(ts)) OVER (PARTITION BY user_id, event_type ORDER BY epoch_us(ts), event_id) AS b FROM events) SELECT event_id FROM e WHERE b IS NULL OR us - b > 3600000000",
    "dedup_xyz": q(_RET, body="SELECT frame, min(pt) AS pt FROM r0 GROUP BY frame, floor(x / 2e0), floor(y / 2e0), floor(z / 2e0)"),
    "pose_asof": q(_TRAJ, _ASOF, body="SELECT user_id, query_id, t AS t_ns, round(CASE WHEN ex THEN px ELSE px + (px1 - px) * f END, 6) AS px, round(CASE WHEN ex THEN py ELSE py + (py1 - py) * f END, 6) AS py, round(CASE WHEN ex THEN pz ELSE pz + (pz1 - pz) * f END, 6) AS pz, 0e0 AS qx, 0e0 AS qy, round(z / sqrt(z*z + w*w), 6) AS qz, round(w / sqrt(z*z + w*w), 6) AS qw FROM h"),
    "pose_nearest": q(_TRAJ, _NEAR, body="SELECT * FROM pn"),
    "match_tolerance": q(_TRAJ, _NEAR, body="SELECT user_id, count(*) AS n, count(DISTINCT nearest_ns) AS n_distinct FROM pn WHERE distance_ns <= 43200000000000 GROUP BY user_id"),
    "deskew_bins": q(_RET, body="SELECT frame, off_ns // 2000000 AS bin, count(*) AS n, CAST(trunc(quantile_cont(off_ns::DOUBLE, 0.5)) AS BIGINT) AS median_ns FROM r0 GROUP BY 1, 2"),
    "travel_fit": q(
        _TRAJ, "t0 AS (SELECT user_id, event_id, t_ns, px AS v, (t_ns - min(t_ns) OVER (PARTITION BY user_id)) / 86400000000000e0 AS t FROM tr)",
        "t1 AS (SELECT event_id, count(*) OVER w AS n, sum(t) OVER w AS st, sum(v) OVER w AS sv, sum(t*t) OVER w AS stt, sum(t*v) OVER w AS stv FROM t0 WINDOW w AS (PARTITION BY user_id ORDER BY t_ns RANGE BETWEEN 86400000000000 PRECEDING AND CURRENT ROW))",
        body="SELECT event_id, n, round(CASE WHEN n > 1 AND n*stt - st*st > 1e-9 THEN (n*stv - st*sv) / (n*stt - st*st) END, 6) AS slope FROM t1",
    ),
    "splat": q(_RET, _SMP, _spl("sp", ""), body="SELECT k, round(value_sum, 6) AS value_sum, round(weight_sum, 6) AS weight_sum, round(weight_max, 6) AS weight_max FROM sp"),
    "block_weight_max": q(_RET, _SMP, _BLK, _BND, body="SELECT block, k, round(value_sum, 6) AS value_sum, round(weight_sum, 6) AS weight_sum FROM bnd"),
    "fused_nodes": q(*_FIELD, body="SELECT k, round(coalesce(value_sum / nullif(weight_sum, 0), 0), 6) AS value, round(weight_sum, 6) AS weight, hit_count AS hits FROM fus"),
    "merge_hits": q(*_FIELD, body="SELECT k, hit_count, mask FROM fus"),
    "current_value": q(*_FIELD, body="SELECT k, round(CASE WHEN k % 3 = 0 THEN s / 2 ELSE s END + 3e-8, 5) AS current FROM nod"),
    "field_normals": q(
        *_FIELD, f"nb AS (SELECT a.k, a.step, b.s AS v FROM (SELECT k, step, k + step AS o FROM nod, {_FACES}) a JOIN nod b ON b.k = a.o)",
        "sd AS (SELECT k, " + ", ".join(f"max(CASE WHEN step = {sg}{st} THEN v END) AS {a}{n}" for a, st in (("x", _X), ("y", _Y), ("z", 1)) for sg, n in (("", "p"), ("-", "m"))) + " FROM nb GROUP BY k)",
        "gr AS (SELECT k, " + ", ".join(f"coalesce(({a}p - {a}m) / 2, {a}p - s, s - {a}m, 0) AS g{a}" for a in "xyz") + " FROM nod JOIN sd USING (k))",
        body="SELECT k, " + ", ".join(f"round(CASE WHEN sqrt(gx*gx + gy*gy + gz*gz) > 1e-9 THEN g{a} / sqrt(gx*gx + gy*gy + gz*gz) END, 5) AS n{a}" for a in "xyz") + " FROM gr",
    ),
    "dilate_blocks": q(_RET, body=f"SELECT DISTINCT {key(8.0)} + step AS k FROM r0, {_AROUND}"),
    "semi_region": q(*_FIELD, body=f"SELECT {block_of('k', 8)} AS b, count(*) AS n FROM nod WHERE {block_of('k', 8)} IN (SELECT {key(8.0)} FROM r0 WHERE frame = 7) GROUP BY 1"),
    "target_mirror": q(*_FIELD, _VOT, body=f"SELECT k, round({_MIRROR} + 3e-8, 5) AS target, round({_H} + {_P}, 6) AS c FROM vot"),
    "target_truncation": q(*_FIELD, _VOT, body=f"SELECT k, round(CASE WHEN {_H} + {_P} > 0 THEN ({_H} * s0 + {_P} * 0.12e0) / ({_H} + {_P}) ELSE s0 END + 3e-8, 5) AS target, round({_H} + {_P}, 6) AS c FROM vot"),
    "target_constant": q(*_FIELD, _VOT, body=f"SELECT k, round(CASE WHEN {_H} + {_P} > 0 THEN ({_H} * s0 + {_P} * 0.5e0) / ({_H} + {_P}) ELSE s0 END + 3e-8, 5) AS target, round({_H} + {_P}, 6) AS c FROM vot"),
    "jacobi3": _jacobi(),
    "running_moments": q(_RET, _MOM("mo", _LEVELS, "frame,"), body="SELECT level, k, frame, CAST(sum(n) OVER w AS BIGINT) AS n, " + ", ".join(f"round(sum({c}) OVER w + 3e-9, 4) AS {c}" for c in ("sx", "sy", "sz", "mxx", "mxy", "mzz")) + " FROM mo WINDOW w AS (PARTITION BY level, k ORDER BY frame)"),
    "local_frame": q(
        _RET, _MOM("mo", _LEVELS, "frame,"), "rn AS (SELECT level, k, frame, CAST(sum(n) OVER (PARTITION BY level, k ORDER BY frame) AS BIGINT) AS n FROM mo)",
        "l AS (" + " UNION ALL ".join(f"SELECT frame, pt, {i} AS level, {key(s)} AS k FROM r0" for i, s in enumerate(_LEVELS)) + ")",
        "b AS (SELECT l.frame, l.pt, arg_min(rn.level, rn.level) AS level, arg_min(rn.n, rn.level) AS n FROM l LEFT JOIN rn ON l.level = rn.level AND l.k = rn.k AND l.frame = rn.frame AND rn.n >= 5 GROUP BY l.frame, l.pt)",
        body="SELECT frame, pt, level, n, round(coalesce(n / (n + 5e0), 0), 6) AS conf FROM b",
    ),
    "ray_samples": q(
        _RET, _RAY, "hs AS (SELECT *, CAST(greatest(2, ceil(trunc / 0.4e0)) AS INTEGER) AS half FROM ray WHERE range > trunc + 1e-6 AND conf > 0)",
        "st AS (SELECT *, unnest(generate_series(-half, half)) AS i FROM hs)", "vl AS (SELECT *, trunc * i / half AS off, greatest(least(-(trunc * i / half) * greatest(least(abs(dz), 1e0), 0.05e0) / trunc, 1e0), -1e0) AS value FROM st)",
        body="SELECT id, CAST(i AS INTEGER) AS i, round(x + dx*off, 6) AS x, round(y + dy*off, 6) AS y, round(z + dz*off, 6) AS z, round(value, 6) AS value, round((1 - 0.35e0*abs(value)) * conf * exp(-0.5e0 * power(off * greatest(least(abs(dz), 1e0), 0.05e0) / (trunc / 3), 2)), 6) AS weight FROM vl",
    ),
    "lateral_counts": q(_RET, body="SELECT frame, pt, CAST(n + (1 - n % 2) AS INTEGER) AS n FROM (SELECT frame, pt, CAST(least(ceil(3.141592653589793e0 * (weight * 0.5e0 + 0.1e0) * (z * 0.1e0 + 0.1e0) / 0.16e0), 25) AS BIGINT) AS n FROM r0)"),
    "knn": q(_CLOUD, "d AS (SELECT a.pid, b.pid AS oid, (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z) AS d2 FROM cl a, cl b)", "rk AS (SELECT *, CAST(row_number() OVER (PARTITION BY pid ORDER BY d2, oid) AS INTEGER) AS rank FROM d WHERE d2 <= 0.8e0 * 0.8e0)", body="SELECT pid, oid, rank, round(d2, 6) AS dist2 FROM rk WHERE rank <= 8"),
    "evidence_units": q(_RET, _SMP, _spl("sf", "block, frame,"), body="SELECT block, k, count(DISTINCT frame) AS n_frames, round(sum(weight_sum), 6) AS weight FROM sf GROUP BY block, k"),
    "cube_vertices": q(*_FIELD, *_cubes(), body="SELECT cube, observed, n, round(x, 4) AS x, round(y, 4) AS y, round(z, 4) AS z FROM ver"),
    "quads": q(
        *_FIELD, *_cubes(), "ed AS (" + " UNION ALL ".join(f"SELECT a.k, {i} AS axis, a.k AS c0, a.k - {s1} AS c1, a.k - {s1 + s2} AS c2, a.k - {s2} AS c3 FROM gat a JOIN gat b ON b.k = a.k + {st} WHERE (a.s < 0) <> (b.s < 0)" for i, (st, s1, s2) in enumerate(((_X, _Y, 1), (_Y, _X, 1), (1, _X, _Y)))) + ")",
        body="SELECT * FROM ed WHERE " + " AND ".join(f"c{i} IN (SELECT cube FROM ver)" for i in range(4)),
    ),
    "local_reindex": q(*_FIELD, body=f"SELECT {block_of('k', 8)} AS block, k AS vid, CAST(row_number() OVER (PARTITION BY {block_of('k', 8)} ORDER BY k) - 1 AS INTEGER) AS local_id FROM nod"),
    "assemble_offsets": q(*_FIELD, f"bs AS (SELECT {block_of('k', 8)} AS block, count(*) AS nv FROM nod GROUP BY 1)", body="SELECT block, nv, CAST(coalesce(sum(nv) OVER (ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM bs"),
    "tile_ids": q(*_FIELD, f"bs AS (SELECT {block_of('k', 8)} AS block, count(*) AS nv FROM nod GROUP BY 1)", body="SELECT block, CAST(floor((sum(nv) OVER (ORDER BY block) - 1) / 1000) AS BIGINT) AS tile FROM bs"),
    "dirty_nodes": q(*_FIELD, *_BEF, body="SELECT k FROM dirt"),
    "dirty_blocks": q(*_FIELD, *_BEF, f"cn AS (SELECT k - step AS k FROM dirt, (VALUES {', '.join(f'({_step(c)})' for c in _CORNERS)}) AS c(step))", body=f"SELECT DISTINCT {block_of('k', 8)} AS block FROM cn"),
    "delta_replay": "WITH l AS (SELECT event_id AS chunk, user_id AS block, event_type = 'error' AS removed, value AS payload, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events WHERE event_id <= 900) SELECT block, chunk, payload FROM l WHERE r = 1 AND NOT removed",
    "ground_bands": q(_RET, "g AS (SELECT floor(x / 10e0) AS cx, floor(y / 10e0) AS cy, quantile_cont(z, 0.02) AS ground FROM r0 GROUP BY 1, 2)", "h AS (SELECT value, z - ground AS height FROM r0 JOIN g ON floor(x / 10e0) = cx AND floor(y / 10e0) = cy)", body="SELECT CASE WHEN height < 2 THEN 'low' WHEN height < 5 THEN 'middle' ELSE 'high' END AS band, count(*) AS n, round(avg(value), 6) AS mean_value FROM h GROUP BY 1"),
    "ray_metrics": q(_RET, _HELD, body=f"SELECT {_METRICS} FROM df"),
    "ray_rollup": q(_RET, _HELD, body=f"SELECT frame, band, {_METRICS} FROM df GROUP BY GROUPING SETS ((frame), (band), ())"),
    "roi_metrics": q(_RET, "s AS (SELECT avg(x) AS sx, avg(y) AS sy FROM r0 GROUP BY frame HAVING frame % 20 = 0)", body="SELECT frame, count(*) AS n, round(avg(value), 6) AS mean_value FROM r0 WHERE frame % 10 = 5 AND EXISTS (SELECT 1 FROM s WHERE (x - sx)*(x - sx) + (y - sy)*(y - sy) <= 100) GROUP BY frame"),
    "zbuffer": q(_RET, "p AS (SELECT frame, pt, floor(x / 2e0) AS px, floor(y / 2e0) AS py, z FROM r0)", "l AS (SELECT frame, px, py, min(z) AS d FROM p GROUP BY ALL)", "n AS (SELECT frame, px + i AS px, py + j AS py, min(d) AS near FROM l, (SELECT unnest([-1, 0, 1]) AS i), (SELECT unnest([-1, 0, 1]) AS j) GROUP BY 1, 2, 3)", body="SELECT frame, pt FROM p JOIN n USING (frame, px, py) WHERE z <= near + 0.2e0"),
    "outlier_mean": q(_RET, "m AS (SELECT frame, quantile_cont(y, 0.5) AS m FROM r0 GROUP BY frame)", "o AS (SELECT frame, y, abs(y - m) AS off FROM r0 JOIN m USING (frame))", "d AS (SELECT frame, quantile_cont(off, 0.5) AS mad FROM o GROUP BY frame)", body="SELECT frame, count(*) AS n, round(avg(y), 6) AS mean FROM o JOIN d USING (frame) WHERE off <= 3e0 * mad GROUP BY frame"),
    "observed_mask": q(_RET, body=f"SELECT DISTINCT {pack(*[cell(c, 4.0) for c in _TP])} + step AS k FROM r0, {_AROUND}"),
    "counter_diff": q(_RET, body="SELECT block, count(*) AS n_a, nullif(count(*) FILTER (WHERE frame <> 7), 0) AS n_b FROM r0 GROUP BY block HAVING count(*) IS DISTINCT FROM nullif(count(*) FILTER (WHERE frame <> 7), 0)"),
    "smoothed": q(
        "o AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), value) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)",
        "l AS (SELECT user_id, i, n, value AS s FROM o WHERE i = 1 UNION ALL SELECT o.user_id, o.i, o.n, l.s + greatest(least(0.3e0 * (o.value - l.s), 20e0), -20e0) FROM l JOIN o ON o.user_id = l.user_id AND o.i = l.i + 1)",
        body="SELECT user_id, round(s, 6) AS last FROM l WHERE i = n",
    ).replace("WITH o", "WITH RECURSIVE o", 1),
    "frame_windows": q(_DAYS, "b AS (SELECT block, count(*) AS n FROM dy GROUP BY block)", body="SELECT block, n, CAST(sum(n) OVER (ORDER BY block) AS BIGINT) AS n_so_far FROM b"),
}
