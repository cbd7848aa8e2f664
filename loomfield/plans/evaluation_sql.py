"""DuckDB SQL for the registered queries of meshes, scores and pacing."""

from __future__ import annotations

from .mapping_sql import scan_rays
from .oracles import _AROUND, _BEF, _CLOUD, _CORNERS, _FIELD, _RET, _X, _Y, _cubes, _step, block_of, cell, pack, q, unpack

_EDGE = "ed AS (" + " UNION ALL ".join(f"SELECT a.k, {i} AS axis, a.k AS c0, a.k - {s1} AS c1, a.k - {s1 + s2} AS c2, a.k - {s2} AS c3 FROM gat a JOIN gat b ON b.k = a.k + {st} WHERE (a.s < 0) <> (b.s < 0)" for i, (st, s1, s2) in enumerate(((_X, _Y, 1), (_Y, _X, 1), (1, _X, _Y)))) + ")"
_PLACED = "vp AS MATERIALIZED (SELECT cube, " + ", ".join(f"{c} + {a} AS {a}" for a, c in zip("xyz", unpack("cube"))) + " FROM ver)"


def _dist(a: str, b: str) -> str:
    return "sqrt(" + " + ".join(f"({a}{c} - {b}{c}) * ({a}{c} - {b}{c})" for c in "xyz") + ")"


_CORNER_COLUMNS = ", ".join(f"{n}.{c} AS {n}{c}" for n in ("va", "vb", "vc") for c in "xyz")
_FACES = [
    *_cubes(), _PLACED, _EDGE,
    "hf AS (SELECT k, axis, 0 AS half, c0 AS a, c1 AS b, c2 AS c, c3 AS other FROM ed UNION ALL SELECT k, axis, 1, c0, c2, c3, c1 FROM ed)",
    f"tp AS (SELECT h.k, h.axis, h.half, h.a, h.b, h.c, {_CORNER_COLUMNS} FROM hf h JOIN vp va ON va.cube = a JOIN vp vb ON vb.cube = b JOIN vp vc ON vc.cube = c SEMI JOIN vp o ON o.cube = h.other)",
    f"tl AS (SELECT *, {_dist('va', 'vb')} AS e1, {_dist('vb', 'vc')} AS e2, {_dist('vc', 'va')} AS e3, " + ", ".join(f"{n}{c} - va{c} AS {m}{c}" for n, m in (("vb", "u"), ("vc", "v")) for c in "xyz") + " FROM tp)",
    "tn AS (SELECT *, uy*vz - uz*vy AS nx, uz*vx - ux*vz AS ny, ux*vy - uy*vx AS nz FROM tl)",
    "tri AS MATERIALIZED (SELECT *, sqrt(nx*nx + ny*ny + nz*nz) AS area2 FROM tn WHERE greatest(e1, e2, e3) <= 3 AND least(e1, e2, e3) > 1e-5 AND greatest(e1, e2, e3) <= 8 * least(e1, e2, e3) AND sqrt(nx*nx + ny*ny + nz*nz) > 1e-8)",
]
_MESH = [*_FIELD, *_FACES]
_DIRTY = [*_BEF, f"db AS (SELECT DISTINCT {block_of('(k - step)', 8)} AS block FROM dirt, (VALUES {', '.join(f'({_step(c)})' for c in _CORNERS)}) AS c(step))"]
_RAYS = f"cr AS MATERIALIZED (SELECT {pack(cell('x', 8.0), cell('y', 8.0), cell('z', 8.0))} AS id, round(avg(x), 4) AS ex, round(avg(y), 4) AS ey, round(avg(z), 4) AS ez FROM r0 WHERE frame % 10 = 5 GROUP BY 1)"


def _seg(p: str, a: str, b: str) -> str:
    """Squared distance of p from the segment a b."""
    u = {c: f"({b}{c} - {a}{c})" for c in "xyz"}
    w = {c: f"({p}{c} - {a}{c})" for c in "xyz"}
    t = f"greatest(least(coalesce(({' + '.join(f'{w[c]} * {u[c]}' for c in 'xyz')}) / nullif({' + '.join(f'{u[c]} * {u[c]}' for c in 'xyz')}, 0), 0), 1), 0)"
    return "(" + " + ".join(f"power({w[c]} - {t} * {u[c]}, 2)" for c in "xyz") + ")"


def _hash(seed: int, what: str, *cols: str) -> str:
    return f"(CAST('0x' || substr(md5('{seed}{what}:' || {' || chr(58) || '.join(cols)}), 1, 8) AS BIGINT) / 4294967296e0)"


def _near(name: str, every: int = 1) -> str:
    return f"""{name} AS MATERIALIZED (SELECT a.pid, a.x, a.y, a.pid % 2 AS odd, sqrt(min((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z))) AS d
 FROM cl a JOIN cl b ON a.pid % 2 <> b.pid % 2 WHERE (a.pid % 2 = 0 OR (b.pid // 2) % {every} = 0) AND (a.pid % 2 = 1 OR (a.pid // 2) % {every} = 0) GROUP BY a.pid, a.x, a.y)"""


def _stat(name: str, src: str) -> str:
    return f"{name} AS (SELECT CAST(floor(x / 2e0) AS BIGINT) AS cx, CAST(floor(y / 2e0) AS BIGINT) AS cy, count(*) AS n, sum(d) AS sum_d, count(*) FILTER (WHERE d <= 0.5) AS n_close FROM {src} WHERE odd = 1 GROUP BY 1, 2)"


def _draws(src: str, tag: str = "") -> list[str]:
    return [
        f"nm{tag} AS (SELECT cx, cy, row_number() OVER (ORDER BY cx, cy) - 1 AS i, count(*) OVER () AS blocks FROM {src})",
        f"pk{tag} AS (SELECT draw, CAST('0x' || substr(md5('11:' || draw || ':' || pick), 1, 12) AS BIGINT) % blocks AS i FROM (SELECT unnest(generate_series(0, 49)) AS draw), (SELECT i + 1 AS pick, blocks FROM nm{tag}))",
        f"dw{tag} AS MATERIALIZED (SELECT draw, cx, cy, count(*) AS m FROM pk{tag} JOIN nm{tag} USING (i) GROUP BY ALL)",
    ]


_BOOT = "SELECT draw, sum(m * sum_d) / sum(m * n) AS mean_d, sum(m * n_close) / sum(m * n) AS close FROM {draws} JOIN {stat} USING (cx, cy) GROUP BY draw"
_SPREAD = "SELECT '{m}' AS metric, round(avg({m}), 6) AS mean, round(quantile_cont({m}, 0.025), 6) AS low, round(quantile_cont({m}, 0.975), 6) AS high, round(stddev_samp({m}), 6) AS std, round(avg(({m} > 0)::INTEGER), 6) AS positive FROM bt"
_BOTH = " UNION ALL ".join(_SPREAD.format(m=m) for m in ("mean_d", "close"))
_ARRIVE = "ar AS (SELECT i, max(us) AS arrived, CAST(sum(work) AS BIGINT) * 20000 AS work FROM (SELECT (epoch_us(ts) - f) // 86400000000 AS i, epoch_us(ts) - f AS us, CAST(floor(value * 1000) AS BIGINT) AS work FROM events, (SELECT min(epoch_us(ts)) AS f FROM events)) GROUP BY i)"
_SERVED = [
    _ARRIVE, "dn AS (SELECT *, CAST(sum(work) OVER (ORDER BY i) AS BIGINT) AS done, row_number() OVER (ORDER BY i) AS place FROM ar)",
    "rd AS (SELECT *, max(arrived - done + work) OVER (ORDER BY i) + done AS ready FROM dn)", "sv AS (SELECT *, ready - work AS start FROM rd)",
    "bk AS (SELECT s.i, count(*) AS came FROM sv s JOIN ar a ON a.arrived <= s.start GROUP BY s.i)",
    "se AS (SELECT i, arrived, work, start, ready, start - arrived AS lag, came - place AS backlog FROM sv JOIN bk USING (i))",
]
_METRIC = "a AS (SELECT avg(d) AS accuracy, avg((d <= 0.5)::INTEGER) AS p, avg((d > 1)::INTEGER) AS o FROM dp WHERE odd = 1), b AS (SELECT avg(d) AS completeness, avg((d <= 0.5)::INTEGER) AS r FROM dp WHERE odd = 0)"

ORACLES: dict[str, str] = {
    "cube_chance": q(
        *_FIELD, *[c.replace("SELECT k, s FROM nod", "SELECT k, s, w FROM nod").replace("count(*) AS observed, ", "count(*) AS observed, avg(exp(-0.5e0 * power(s / 0.38e0, 2)) * (1 - exp(-w / 2))) AS chance, ").replace("HAVING count(*) >= 3", "HAVING count(*) >= 3 AND avg(exp(-0.5e0 * power(s / 0.38e0, 2)) * (1 - exp(-w / 2))) >= 0.1") for c in _cubes()],
        body="SELECT cube, n FROM ver",
    ),
    "triangles": q(*_MESH, body="SELECT k, CAST(axis AS INTEGER) AS axis, CAST(half AS INTEGER) AS half, a, b, c, round(area2, 4) AS area2 FROM tri"),
    "extract_region": q(*_MESH, *_DIRTY, body=f"SELECT {block_of('k', 8)} AS block, count(*) AS faces, round(sum(area2), 3) AS area2 FROM tri WHERE {block_of('k', 8)} IN (SELECT block FROM db) GROUP BY 1"),
    "halo_nodes": q(*_FIELD, f"hn AS (SELECT k, {block_of('k', 8)} % 3 = 0 AS own FROM nod)", body=f"SELECT DISTINCT k FROM (SELECT k FROM hn WHERE own UNION ALL SELECT b.k FROM (SELECT k + step AS k FROM hn, {_AROUND} WHERE own) a JOIN hn b USING (k))"),
    "mesh_difference": q(
        *_FIELD, *_cubes(), *_BEF, "va AS (SELECT cube, x, y, z FROM ver)",
        *[c.replace("gat AS (SELECT k, s FROM nod WHERE w >= 0.1)", "gat2 AS (SELECT k, s_old AS s FROM bef WHERE w_old >= 0.1)").replace("wid AS", "wid2 AS").replace("FROM gat,", "FROM gat2,").replace("cub AS", "cub2 AS").replace("FROM wid)", "FROM wid2)").replace("ver AS", "ver2 AS").replace("FROM cub ", "FROM cub2 ") for c in _cubes()],
        f"mo AS (SELECT o.cube AS co, n.cube AS cn, {_dist('o.', 'n.')} AS off FROM ver2 o FULL JOIN ver n ON o.cube = n.cube)",
        body="SELECT count(*) FILTER (WHERE cn IS NULL) AS only_a, count(*) FILTER (WHERE co IS NULL) AS only_b, count(*) FILTER (WHERE off > 1e-3) AS moved, round(max(off), 4) AS most FROM mo",
    ),
    "surface_samples": q(
        *_MESH, f"sh AS (SELECT *, CAST(floor(area2 / (SELECT sum(area2) FROM tri) * 2000 + {_hash(5, 'n', 'k', 'axis', 'half')}) AS INTEGER) AS own FROM tri)",
        "sj AS (SELECT *, unnest(generate_series(1, own)) AS j FROM sh WHERE own > 0)", f"sr AS (SELECT *, sqrt({_hash(5, 'r', 'k', 'axis', 'half', 'j')}) AS r, {_hash(5, 's', 'k', 'axis', 'half', 'j')} AS s FROM sj)",
        body="SELECT k, CAST(axis AS INTEGER) AS axis, CAST(half AS INTEGER) AS half, CAST(j AS INTEGER) AS j, " + ", ".join(f"round(va{c} * (1 - r) + vb{c} * r * (1 - s) + vc{c} * r * s, 4) AS {c}" for c in "xyz") + " FROM sr",
    ),
    "ray_hits": q(
        *_MESH, _RAYS, "rl AS (SELECT id, ex / l AS dx, ey / l AS dy, ez / l AS dz, l FROM (SELECT *, sqrt(ex*ex + ey*ey + ez*ez) AS l FROM cr))",
        # t from the plane, the place inside by the areas of the three parts
        "th AS (SELECT rl.*, tri.*, (vax*nx + vay*ny + vaz*nz) / nullif(dx*nx + dy*ny + dz*nz, 0) AS t FROM rl, tri WHERE abs(dx*nx + dy*ny + dz*nz) > 1e-12)",
        "ti AS (SELECT *, t*dx AS px, t*dy AS py, t*dz AS pz FROM th WHERE t > 0 AND t <= l + 3)",
        "tj AS (SELECT id, t, " + ", ".join(f"((({b}y - {a}y)*(pz - {a}z) - ({b}z - {a}z)*(py - {a}y))*nx + (({b}z - {a}z)*(px - {a}x) - ({b}x - {a}x)*(pz - {a}z))*ny + (({b}x - {a}x)*(py - {a}y) - ({b}y - {a}y)*(px - {a}x))*nz) AS s{i}" for i, (a, b) in enumerate((("va", "vb"), ("vb", "vc"), ("vc", "va")))) + " FROM ti)",
        body="SELECT id, round(min(t), 4) AS t FROM tj WHERE s0 >= 0 AND s1 >= 0 AND s2 >= 0 GROUP BY id",
    ),
    "surface_distance": q(
        *_MESH, _RAYS,
        f"dq AS (SELECT id AS pid, {_seg('e', 'va', 'vb')} AS d1, {_seg('e', 'vb', 'vc')} AS d2, {_seg('e', 'vc', 'va')} AS d3, nx*nx + ny*ny + nz*nz AS n2, (ex - vax)*nx + (ey - vay)*ny + (ez - vaz)*nz AS h, ((ey - vay)*vz - (ez - vaz)*vy)*nx + ((ez - vaz)*vx - (ex - vax)*vz)*ny + ((ex - vax)*vy - (ey - vay)*vx)*nz AS s, (uy*(ez - vaz) - uz*(ey - vay))*nx + (uz*(ex - vax) - ux*(ez - vaz))*ny + (ux*(ey - vay) - uy*(ex - vax))*nz AS t FROM cr, tri WHERE abs(ex - vax) < 8 AND abs(ey - vay) < 8 AND abs(ez - vaz) < 8)",
        "dm AS (SELECT pid, sqrt(min(CASE WHEN n2 > 0 AND s >= 0 AND t >= 0 AND s + t <= n2 THEN h * h / n2 ELSE least(d1, d2, d3) END)) AS d FROM dq GROUP BY pid)",
        body="SELECT pid, round(d, 4) AS d FROM dm WHERE d <= 4",
    ),
    "gt_metrics": q(_CLOUD, _near("dp"), _METRIC, body="SELECT round(accuracy, 6) AS accuracy, round(p, 6) AS precision, round(o, 6) AS outlier, round(completeness, 6) AS completeness, round(r, 6) AS recall, round((accuracy + completeness) / 2, 6) AS chamfer, round(CASE WHEN p + r > 0 THEN 2*p*r / (p + r) ELSE 0 END, 6) AS f_score FROM a, b"),
    "block_stats": q(_CLOUD, _near("dp"), _stat("st", "dp"), body="SELECT cx, cy, n, round(sum_d, 6) AS sum_d, n_close FROM st"),
    "bootstrap": q(_CLOUD, _near("dp"), _stat("st", "dp"), *_draws("st"), f"bt AS ({_BOOT.format(draws='dw', stat='st')})", body="SELECT draw, round(mean_d, 6) AS mean_d, round(close, 6) AS close FROM bt"),
    "bootstrap_interval": q(_CLOUD, _near("dp"), _stat("st", "dp"), *_draws("st"), f"bt AS ({_BOOT.format(draws='dw', stat='st')})", body=_BOTH),
    "paired_bootstrap": q(
        _CLOUD, _near("dp"), _near("dp2", 2), _stat("st", "dp"), _stat("su", "dp2"), "sb AS (SELECT cx, cy FROM st JOIN su USING (cx, cy))", *_draws("sb"),
        f"b1 AS ({_BOOT.format(draws='dw', stat='st')})", f"b2 AS ({_BOOT.format(draws='dw', stat='su')})", "bt AS (SELECT b1.mean_d - b2.mean_d AS mean_d, b1.close - b2.close AS close FROM b1 JOIN b2 USING (draw))", body=_BOTH,
    ),
    "paced_replay": q(*_SERVED, body="SELECT * FROM se"),
    "latency": q(
        *_SERVED, "lt AS (SELECT ready - arrived AS late, backlog, least((row_number() OVER (ORDER BY i) - 1) * 3 // count(*) OVER (), 2) AS third FROM se)",
        body="SELECT count(*) AS n, round(quantile_cont(late::DOUBLE, 0.5), 6) AS median, round(quantile_cont(late::DOUBLE, 0.95), 6) AS p95, max(late)::DOUBLE AS most, " + ", ".join(f"quantile_cont(late::DOUBLE, 0.5) FILTER (WHERE third = {i}) AS median_{i + 1}" for i in range(3)) + ", max(backlog) AS backlog FROM lt",
    ),
    "ray_reach": q(
        _RET, *scan_rays(), "el AS (SELECT *, sqrt(x*x + y*y + z*z) AS l FROM er)", "es2 AS (SELECT *, unnest(generate_series(0, CAST(floor((l + 3.5e0) / 8e0) AS BIGINT))) AS i FROM el)",
        f"eb AS (SELECT c, {pack(*[f'CAST(floor({a} / l * i * 8e0 / 8e0) AS BIGINT)' for a in 'xyz'])} AS b FROM es2 UNION SELECT c, {pack(cell('x', 8.0), cell('y', 8.0), cell('z', 8.0))} FROM el)", body=f"SELECT DISTINCT c, b + step AS block FROM eb, {_AROUND}",
    ),
    "frame_spec": q(_RET, body="SELECT CAST(frame AS BIGINT) AS frame, count(*) AS n FROM r0 WHERE (frame < 20 AND frame % 10 <> 5) OR frame = 25 OR (frame BETWEEN 30 AND 44 AND frame % 10 <> 5) GROUP BY frame"),
}
