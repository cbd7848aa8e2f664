"""DuckDB SQL for the registered queries of the mapping chain."""

from __future__ import annotations

from .oracles import _AROUND, _BLK, _BND, _FACES, _FIELD, _FUS, _H, _MIRROR, _MOM, _P, _RET, _SMP, _TRAJ, _X, _Y, _spl, block_of, key, pack, q, unpack

_SENSOR = (25.0, 25.0, 10.0)
_LEVELS, _LEAST, _PLANARITY, _K = (4.0, 8.0), 5, 0.2, 8
_FLAT = f"fl AS MATERIALIZED (SELECT frame, block, pt, x, y, z / 20 AS z, {', '.join(f'{c}e0 AS o{a}' for a, c in zip('xyz', _SENSOR))} FROM r0)"
_PAIRS = [(i, j) for i in "xyz" for j in "xyz"]


def _dot(a: str, b: str) -> str:
    return "(" + " + ".join(f"{a}{i} * {b}{i}" for i in "xyz") + ")"


def _entry(i: str, j: str) -> str:
    return "c" + "".join(sorted(i + j))


def _plane_ctes() -> list[str]:
    """Planes of the cells as they stand after each frame: l0..l2, axes n, u, v."""
    sums = ("sx", "sy", "sz", "mxx", "mxy", "mxz", "myy", "myz", "mzz")
    cov = ", ".join(f"m{i}{j} / n - s{i} * s{j} / (n * n) AS c{i}{j}" for i, j in ("xx", "xy", "xz", "yy", "yz", "zz"))
    out = [
        _MOM("mo", _LEVELS, "frame,").replace("FROM r0,", "FROM fl,"),
        f"rn AS (SELECT level, k, frame, CAST(sum(n) OVER w AS BIGINT) AS n, {', '.join(f'sum({s}) OVER w AS {s}' for s in sums)} FROM mo WINDOW w AS (PARTITION BY level, k ORDER BY frame))",
        f"cv AS (SELECT level, k, frame, n, {cov} FROM rn WHERE n >= {_LEAST})",
        "e0 AS (SELECT *, (cxx + cyy + czz) / 3 AS mean, ((cxx-cyy)*(cxx-cyy) + (cyy-czz)*(cyy-czz) + (czz-cxx)*(czz-cxx)) / 18 + (cxy*cxy + cxz*cxz + cyz*cyz) / 3 AS a FROM cv)",
        "e1 AS (SELECT *, ((cxx-mean)*(cyy-mean)*(czz-mean) + 2*cxy*cxz*cyz - (cxx-mean)*cyz*cyz - (cyy-mean)*cxz*cxz - (czz-mean)*cxy*cxy) / 2 AS b FROM e0)",
        "e2 AS (SELECT *, acos(greatest(least(coalesce(b / nullif(sqrt(a) * a, 0), 1e0), 1e0), -1e0)) / 3 AS w FROM e1)",
        "e3 AS (SELECT *, mean + 2*sqrt(a)*cos(w + 2*pi()/3) AS l0, mean + 2*sqrt(a)*cos(w - 2*pi()/3) AS l1, mean + 2*sqrt(a)*cos(w) AS l2 FROM e2)",
        f"g0 AS (SELECT level, k, frame, n, cxx, cxy, cxz, cyy, cyz, czz, l0, l1, l2 FROM e3 WHERE l2 > 1e-9 AND sqrt(greatest(l0, 0e0) / greatest(l2, 1e-12)) <= {_PLANARITY})",
    ]
    src = "g0"
    for name, (a, b) in {"n": ("l1", "l2"), "u": ("l0", "l1")}.items():
        less = lambda i, j, r: f"({_entry(i, j)} - {r})" if i == j else _entry(i, j)
        prod = ", ".join(f"{' + '.join(f'{less(i, k, a)} * {less(k, j, b)}' for k in 'xyz')} AS p{i}{j}" for i, j in _PAIRS)
        column = lambda j: f"CASE WHEN abs(pxx) >= abs(pyy) AND abs(pxx) >= abs(pzz) THEN px{j} WHEN abs(pyy) >= abs(pzz) THEN py{j} ELSE pz{j} END"
        made = ", ".join(f"p{i}{j}" for i, j in _PAIRS)
        out += [
            f"{name}p AS (SELECT *, {prod} FROM {src})",
            f"{name}w AS (SELECT * EXCLUDE ({made}), {', '.join(f'{column(j)} AS w{j}' for j in 'xyz')} FROM {name}p)",
            f"{name}a AS (SELECT * EXCLUDE (wx, wy, wz), {', '.join(f'w{j} / sqrt({_dot("w", "w")}) AS {name}{j}' for j in 'xyz')} FROM {name}w)",
        ]
        src = f"{name}a"
    out.append(
        "pl AS (SELECT level, k, frame, nx, ny, nz, ux, uy, uz, ny*uz - nz*uy AS vx, nz*ux - nx*uz AS vy, nx*uy - ny*ux AS vz, "
        f"greatest(sqrt(l2), 0.25e0) AS su, greatest(sqrt(greatest(l1, 0e0)), 0.25e0) AS sv, greatest(sqrt(greatest(l0, 0e0)), 0.02e0) AS tau, n / (n + {_LEAST}e0) AS conf FROM {src})"
    )
    return out


def _frame_ctes() -> list[str]:
    names = [f"{a}{c}" for a in "nuv" for c in "xyz"] + ["su", "sv", "tau", "conf"]
    asks = " UNION ALL ".join(f"SELECT frame, pt, {i} AS level, {key(s)} AS k FROM fl" for i, s in enumerate(_LEVELS))
    ray = [f"({a} - o{a})" for a in "xyz"]
    length = f"sqrt({' + '.join(f'{r} * {r}' for r in ray)})"
    default = {f"n{a}": f"-d{a}" for a in "xyz"} | {f"u{a}": f"eu{a}" for a in "xyz"} | {f"v{a}": f"ev{a}" for a in "xyz"} | {"su": "1e0", "sv": "1e0", "tau": "0.5e0", "conf": "1e0"}
    turned = {f"n{a}": f"CASE WHEN f.nx * -dx + f.ny * -dy + f.nz * -dz < 0 THEN -f.n{a} ELSE f.n{a} END" for a in "xyz"}
    return [
        *_plane_ctes(),
        f"ask AS ({asks})",
        f"fnd AS (SELECT ask.frame, ask.pt, arg_min({{{', '.join(f'{chr(39)}{n}{chr(39)}: {n}' for n in names)}}}, level) AS f FROM ask JOIN pl USING (level, k, frame) GROUP BY 1, 2)",
        f"dr AS (SELECT fl.*, f, {', '.join(f'{r} / {length} AS d{a}' for a, r in zip('xyz', ray))} FROM fl LEFT JOIN fnd USING (frame, pt))",
        "dc AS (SELECT *, CASE WHEN abs(dz) > 0.9 THEN 0e0 ELSE dy END AS ax, CASE WHEN abs(dz) > 0.9 THEN dz ELSE -dx END AS ay, CASE WHEN abs(dz) > 0.9 THEN -dy ELSE 0e0 END AS az FROM dr)",
        f"de AS (SELECT *, {', '.join(f'a{a} / sqrt({_dot("a", "a")}) AS eu{a}' for a in 'xyz')} FROM dc)",
        "df AS (SELECT *, dy * euz - dz * euy AS evx, dz * eux - dx * euz AS evy, dx * euy - dy * eux AS evz FROM de)",
        f"fr AS MATERIALIZED (SELECT frame, block, pt, x, y, z, ox, oy, oz, f IS NOT NULL AS matched, {', '.join(f'coalesce({turned.get(n, f"f.{n}")}, {default[n]}) AS {n}' for n in names)} FROM df)",
    ]


_KNN = f"""kn AS (SELECT frame, pt, t.other AS other, t.d2 AS d2, CAST(row_number() OVER (PARTITION BY frame, pt ORDER BY t.d2, t.other) AS INTEGER) AS rank FROM (
 SELECT a.frame, a.pt, unnest(min({{'d2': (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z), 'other': b.pt}}, {_K})) AS t FROM fl a JOIN fl b USING (frame) GROUP BY a.frame, a.pt))"""
_LIMITS = [
    "qr AS (SELECT frame, pt, x AS qx, y AS qy, z AS qz, ox, oy, oz, ux, uy, uz, vx, vy, vz, tau, uy*vz - uz*vy AS mx, uz*vx - ux*vz AS my, ux*vy - uy*vx AS mz FROM fr WHERE matched)",
    f"pr AS (SELECT q.*, CASE WHEN other = q.pt THEN 0 ELSE rank END AS rank, c.x AS cx, c.y AS cy, c.z AS cz, c.matched AS known, c.nx AS cnx, c.ny AS cny, c.nz AS cnz FROM kn JOIN qr q USING (frame, pt) JOIN fr c ON c.frame = kn.frame AND c.pt = kn.other)",
    "ps AS (SELECT *, cx - qx AS dx, cy - qy AS dy, cz - qz AS dz, cx - ox AS rx, cy - oy AS ry, cz - oz AS rz, sqrt(mx*mx + my*my + mz*mz) AS ml FROM pr)",
    f"pt1 AS (SELECT *, {_dot('d', 'u')} AS a, {_dot('d', 'v')} AS b, abs({_dot('d', 'm')} / ml) AS h, sqrt({_dot('r', 'r')}) AS reach FROM ps)",
    f"pt2 AS (SELECT *, sqrt(a*a + b*b) AS flat, {_dot('r', 'm')} / ml / reach AS facing, NOT known OR abs({_dot('cn', 'm')} / ml) >= cos(radians(55)) AS alike, ((qx-ox)*mx + (qy-oy)*my + (qz-oz)*mz) / ml AS plane FROM pt1)",
    "pt3 AS (SELECT frame, pt, rank, a, b, h, flat, reach, rank = 0 OR (alike AND h <= 2.5e0 * tau) AS on_, CASE WHEN abs(facing) > 1e-3 THEN plane / facing END AS expected FROM pt2)",
    "sp1 AS (SELECT frame, pt, list_sort(list(flat) FILTER (WHERE on_ AND flat > 1e-12))[1:3] AS close FROM pt3 GROUP BY 1, 2)",
    "sp2 AS (SELECT frame, pt, coalesce(close[(len(close) - 1) // 2 + 1], 0e0) AS spacing FROM sp1)",
    "pv AS (SELECT p.*, spacing, CASE WHEN greatest(flat, spacing) > 1e-12 THEN h / greatest(flat, spacing) ELSE 0 END AS ns, CASE WHEN greatest(flat, spacing) > 1e-12 THEN abs(reach - expected) / greatest(flat, spacing) ELSE 0 END AS ds FROM pt3 p JOIN sp2 USING (frame, pt))",
    "pg AS (SELECT frame, pt, spacing, list([{'a': a, 'b': b}] ORDER BY rank) AS ps FROM pv WHERE rank = 0 OR (on_ AND ns <= 0.35e0 AND (expected IS NULL OR (expected > 0 AND ds <= 0.35e0))) GROUP BY 1, 2, 3)",
    "pj AS (SELECT frame, pt, spacing, list_reduce(ps, lambda done, p: CASE WHEN len(list_filter(done, lambda o: sqrt((o.a - p[1].a)*(o.a - p[1].a) + (o.b - p[1].b)*(o.b - p[1].b)) <= 2.5e0 * spacing)) > 0 THEN list_concat(done, p) ELSE done END) AS js FROM pg)",
    "pm AS (SELECT frame, pt, spacing * 0.5e0 AS margin, list_max([x.a for x in js]) AS a1, -list_min([x.a for x in js]) AS a0, list_max([x.b for x in js]) AS b1, -list_min([x.b for x in js]) AS b0 FROM pj)",
    "lm AS MATERIALIZED (SELECT fr.*, coalesce(least(greatest(a1, 0) + margin, greatest(a0, 0) + margin), 1e0) AS lu, coalesce(least(greatest(b1, 0) + margin, greatest(b0, 0) + margin), 1e0) AS lv FROM fr LEFT JOIN pm USING (frame, pt))",
]


def _sample_ctes(src: str, limited: bool, where: str = "TRUE") -> list[str]:
    ha, hb = ("least(2.5e0 * su, lu)", "least(2.5e0 * sv, lv)") if limited else ("2.5e0 * su", "2.5e0 * sv")
    wanted = "greatest(2 * ha, 2 * hb, pi() * ha * hb)" if limited else "pi() * ha * hb"
    turn = "CASE WHEN j = 0 THEN up WHEN j = 1 THEN pi() / 2 - up ELSE 2.399963229728653e0 * j END" if limited else "2.399963229728653e0 * j"
    radius = "CASE WHEN j < 2 THEN 1e0 ELSE sqrt((j + 1e0) / greatest(pairs, 1)) END" if limited else "sqrt((j + 1e0) / greatest(pairs, 1))"
    return [
        f"a1 AS (SELECT *, CASE WHEN matched THEN 3 * tau ELSE 1.5e0 END AS trunc, sqrt((x-ox)*(x-ox) + (y-oy)*(y-oy) + (z-oz)*(z-oz)) AS range, uy*vz - uz*vy AS mx, uz*vx - ux*vz AS my, ux*vy - uy*vx AS mz FROM {src} WHERE {where})",
        f"a2 AS (SELECT *, (x-ox) / range AS dx, (y-oy) / range AS dy, (z-oz) / range AS dz, {ha} AS ha, {hb} AS hb, CAST(greatest(2, ceil(trunc)) AS INTEGER) AS half FROM a1 WHERE range > trunc + 1e-6 AND conf > 0)",
        f"a3 AS (SELECT *, greatest(least(abs({_dot('d', 'm')} / sqrt({_dot('m', 'm')})), 1e0), 0.05e0) AS cosine, CAST(greatest(ceil(least({wanted}, 25e0)), 1) AS INTEGER) AS n0, CASE WHEN hb > ha THEN pi() / 2 ELSE 0e0 END AS up FROM a2)",
        "a4 AS (SELECT *, (least(n0 + (1 - n0 % 2), 25) - 1) // 2 AS pairs, unnest(generate_series(-half, half)) AS i FROM a3)",
        "a5 AS (SELECT *, trunc * i / half AS off FROM a4)",
        "a6 AS (SELECT *, greatest(least(-off * cosine / trunc, 1e0), -1e0) AS value, unnest(generate_series(-1, CASE WHEN abs(i) <= 1 AND pairs > 0 THEN pairs - 1 ELSE -1 END)) AS j FROM a5)",
        f"a7 AS (SELECT *, (1 - 0.35e0 * abs(value)) * conf * exp(-0.5e0 * (off * cosine / tau) * (off * cosine / tau)) AS w0, CASE WHEN j < 0 THEN 0e0 ELSE ha * {radius} * cos({turn}) END AS pu, CASE WHEN j < 0 THEN 0e0 ELSE hb * {radius} * sin({turn}) END AS pv FROM a6)",
        "a8 AS (SELECT *, unnest(CASE WHEN j < 0 THEN [1] ELSE [1, -1] END) AS side FROM a7)",
        f"sm AS (SELECT frame, block, pt, i, j, side, value, {', '.join(f'{a} + d{a} * off + side * (pu * u{a} + pv * v{a}) AS {a}' for a in 'xyz')}, w0 * exp(-0.5e0 * ((pu / su) * (pu / su) + (pv / sv) * (pv / sv))) AS weight FROM a8)",
    ]


_FRAMES = [_RET, _FLAT, *_frame_ctes()]
_LIMITED = [*_FRAMES, _KNN, *_LIMITS]
_PN = "pn AS MATERIALIZED (SELECT c, k, round(coalesce(sum(value_sum) / nullif(sum(weight_sum), 0), 0), 6) AS s, round(sum(weight_sum), 6) AS w, count(*) AS h, max(block) = c AS touched FROM bnd JOIN (SELECT unnest(generate_series(0, 5)) AS c) ON block <= c GROUP BY c, k)"
_PREFIX = [_RET, _SMP, _BLK, _BND, _PN]
_SIDES = ", ".join(f"max(CASE WHEN step = {sg}{st} THEN v END) AS {a}{n}" for a, st in (("x", _X), ("y", _Y), ("z", 1)) for sg, n in (("", "p"), ("-", "m")))


def vote_ctes(nodes: str, rays: str, by: str) -> list[str]:
    """Scans (by, k, scan) that are free for a node; ``nodes`` with gradients gx, gy, gz, ``rays`` with x, y, z from the origin."""
    on = f"{by}, k" if by else "k"
    get = f"{by}, " if by else ""
    n2 = "(gx*gx + gy*gy + gz*gz)"
    p = [unpack("k")[i] for i in range(3)]
    return [
        f"vr AS (SELECT {get}scan, x / l AS ux, y / l AS uy, z / l AS uz, l FROM (SELECT *, sqrt(x*x + y*y + z*z) AS l FROM {rays}) WHERE l > 2.5)",
        "vs AS (SELECT *, unnest(generate_series(0, CAST(floor(l + 3.5e0) AS BIGINT))) AS i FROM vr)",
        f"va AS (SELECT {get}scan, ux, uy, uz, l, {pack(*[f'CAST(round_even(u{a} * i, 0) AS BIGINT)' for a in 'xyz'])} + step AS k FROM vs, {_AROUND})",
        f"vm AS (SELECT {get}k, scan, l, ux, uy, uz, {p[0]} AS px, {p[1]} AS py, {p[2]} AS pz, CASE WHEN sqrt({n2}) > 1e-9 THEN gx / sqrt({n2}) END AS nx, CASE WHEN sqrt({n2}) > 1e-9 THEN gy / sqrt({n2}) END AS ny, CASE WHEN sqrt({n2}) > 1e-9 THEN gz / sqrt({n2}) END AS nz FROM va JOIN {nodes} USING ({on}))",
        f"vn AS (SELECT *, {_dot('p', 'u')} AS al, {_dot('p', 'p')} AS p2, {_dot('n', 'u')} AS fc, {_dot('n', 'p')} AS pl FROM vm)",
        "vo AS (SELECT *, CASE WHEN abs(fc) > 1e-6 THEN pl / fc END AS t FROM vn WHERE p2 > 6.25)",
        f"vt AS (SELECT {get}k, scan, max(al > 0 AND p2 - al*al <= 2.25 AND abs(l - al) < 2.5) AS hit, max(CASE WHEN nx IS NOT NULL THEN coalesce(t > 0 AND (ux*t-px)*(ux*t-px) + (uy*t-py)*(uy*t-py) + (uz*t-pz)*(uz*t-pz) <= 2.25 AND l >= t + 2.5, FALSE) ELSE al > 0 AND p2 - al*al <= 2.25 AND l >= al + 2.5 END) AS pass FROM vo GROUP BY {get}k, scan)",
        f"vf AS MATERIALIZED (SELECT {get}k, scan FROM vt WHERE pass AND NOT hit)",
    ]


def gradient_ctes(nodes: str, by: str) -> list[str]:
    on, get = (f"a.{by} = b.{by} AND ", f"{by}, ") if by else ("", "")
    return [
        f"gn AS (SELECT {'a.' + by + ', ' if by else ''}a.k, a.step, b.s AS v FROM (SELECT {get}k, step, k + step AS o FROM {nodes}, {_FACES}) a JOIN {nodes} b ON {on}b.k = a.o)",
        f"gs AS (SELECT {get}k, {_SIDES} FROM gn GROUP BY {get}k)",
        f"gr AS (SELECT n.*, {', '.join(f'coalesce(({a}p - {a}m) / 2, {a}p - s, s - {a}m, 0) AS g{a}' for a in 'xyz')} FROM {nodes} n LEFT JOIN gs USING ({get}k))",
    ]


def scan_rays() -> list[str]:
    """All rays of the scans that are not held out."""
    return ["er AS (SELECT block AS c, frame AS scan, pt AS ray, x, y, z FROM r0 WHERE frame % 10 <> 5)"]


_VOTES = [*_PREFIX, *gradient_ctes("pn", "c"), "cd AS (SELECT * FROM gr WHERE w > 0 AND s <= 0)", *scan_rays(), *vote_ctes("cd", "er", "c"), "bv AS MATERIALIZED (SELECT c, k, count(*) AS n_scans FROM vf GROUP BY c, k)"]
_REGION = [
    *_VOTES,
    "pk AS (SELECT k, count(*) AS p, max(c = 5) AS newly FROM bv GROUP BY k)",
    f"rg AS (SELECT k, s AS s0, w, h, coalesce(p, 0) AS p, touched OR coalesce(newly, FALSE) AS moved, {block_of('k', 8)} AS home FROM pn LEFT JOIN pk USING (k) WHERE c = 5)",
    "hb AS (SELECT DISTINCT home FROM rg WHERE moved)",
    f"hd AS (SELECT DISTINCT home + step AS home FROM hb, {_AROUND})",
    f"sr AS MATERIALIZED (SELECT k, s0 AS s, {_MIRROR} AS target, {_H} + {_P} AS c, home IN (SELECT home FROM hb) AS inside, home FROM rg WHERE home IN (SELECT home FROM hd))",
]


def _solved() -> str:
    ctes = [*_REGION, "j0 AS (SELECT k, s, target, c, inside FROM sr)"]
    for i in range(3):
        ctes.append(f"m{i} AS (SELECT a.k, sum(b.s) AS nv, count(*) AS deg FROM (SELECT k, k + step AS o FROM j{i}, {_FACES}) a JOIN j{i} b ON b.k = a.o GROUP BY a.k)")
        ctes.append(
            f"j{i + 1} AS MATERIALIZED (SELECT k, CASE WHEN inside AND c + la > 0 THEN s + 0.8e0 * ((c * target + la * coalesce(nv / deg, 0)) / (c + la) - s) ELSE s END AS s, target, c, inside "
            f"FROM (SELECT j{i}.*, nv, deg, CASE WHEN coalesce(deg, 0) > 0 THEN 1e0 ELSE 0e0 END AS la FROM j{i} LEFT JOIN m{i} USING (k)))"
        )
    return q(*ctes, body="SELECT k, round(j3.s + 3e-8, 4) AS s FROM j3 JOIN sr USING (k) WHERE j3.inside AND abs(j3.s - sr.s) > 1e-4")


_DRIVE = "dv AS (SELECT i * 30000000::BIGINT AS t_ns, i * 0.5e0 AS px, (i % 7) * 0.1e0 AS py, 1.5e0 AS pz, i * 0.1e0 AS yaw FROM (SELECT unnest(generate_series(0, 197)) AS i))"


def _pose_at(asked: str, name: str) -> list[str]:
    """``asked`` (t) with px, py, pz, yaw: a turn about z at an even rate, so yaw interpolates as it is; clamped at both ends."""
    near = "d.t_ns + 30000000 <= 5910000000"
    f = f"CASE WHEN a.t < 0 OR a.t >= 5910000000 THEN 0e0 ELSE (a.t - d.t_ns) / 30000000e0 END"
    return [
        f"{name}_b AS (SELECT a.*, greatest(least(CAST(floor(a.t / 30000000e0) AS BIGINT), 197), 0) * 30000000::BIGINT AS base FROM {asked} a)",
        f"{name} AS (SELECT a.*, " + ", ".join(f"d.{c} + coalesce(e.{c} - d.{c}, 0) * ({f}) AS {c}" for c in ("px", "py", "pz", "yaw")) + f" FROM {name}_b a JOIN dv d ON d.t_ns = base LEFT JOIN dv e ON e.t_ns = base + 30000000)",
    ]


def _deskewed() -> str:
    # sensor -> body: turn 0.1, shift (0.2, 0, -0.1); body -> world: turn yaw, shift p
    def to_world(x: str, y: str, z: str, m: str) -> list[str]:
        bx, by, bz = f"(cos(0.1e0) * {x} - sin(0.1e0) * {y} + 0.2e0)", f"(sin(0.1e0) * {x} + cos(0.1e0) * {y})", f"({z} - 0.1e0)"
        return [f"(cos({m}.yaw) * {bx} - sin({m}.yaw) * {by} + {m}.px)", f"(sin({m}.yaw) * {bx} + cos({m}.yaw) * {by} + {m}.py)", f"({bz} + {m}.pz)"]

    def back(x: str, y: str, z: str) -> list[str]:
        bx, by, bz = f"(cos(yaw0) * ({x} - px0) + sin(yaw0) * ({y} - py0))", f"(-sin(yaw0) * ({x} - px0) + cos(yaw0) * ({y} - py0))", f"({z} - pz0)"
        return [f"(cos(0.1e0) * ({bx} - 0.2e0) + sin(0.1e0) * {by})", f"(-sin(0.1e0) * ({bx} - 0.2e0) + cos(0.1e0) * {by})", f"({bz} + 0.1e0)"]

    world = ", ".join(f"{c} AS w{a}" for a, c in zip("xyz", to_world("x", "y", "z", "b"))) + ", " + ", ".join(f"{c} AS o{a}" for a, c in zip("xyz", to_world("0e0", "0e0", "0e0", "b")))
    out = ", ".join(f"round({c}, 5) AS {a}" for a, c in zip("xyz", back("wx", "wy", "wz"))) + ", " + ", ".join(f"round({c}, 5) AS s{a}" for a, c in zip("xyz", back("ox", "oy", "oz")))
    return q(
        _RET, _DRIVE, "bn AS (SELECT frame, off_ns // 2000000 AS bin, CAST(trunc(quantile_cont(off_ns::DOUBLE, 0.5)) AS BIGINT) AS m FROM r0 GROUP BY 1, 2)",
        "st AS (SELECT CAST(unnest(generate_series(0, 59)) AS INTEGER) AS frame)", "s0 AS (SELECT frame, frame::BIGINT * 100000000 AS t FROM st)", *_pose_at("s0", "ps"),
        "b0 AS (SELECT frame, bin, frame::BIGINT * 100000000 + m AS t FROM bn)", *_pose_at("b0", "pb"),
        f"wd AS (SELECT r.frame, r.pt, a.px AS px0, a.py AS py0, a.pz AS pz0, a.yaw AS yaw0, {world} FROM r0 r JOIN pb b ON b.frame = r.frame AND b.bin = r.off_ns // 2000000 JOIN ps a ON a.frame = r.frame)",
        body=f"SELECT frame, pt, {out} FROM wd",
    )


_DISC = ", ".join(f"round(sum(weight * {a}) / sum(weight), 4) AS {a}" for a in "xyz")
_AXES = ", ".join(f"round({a}{c}, 3) AS {a}{c}" for a in "nu" for c in "xyz")

ORACLES: dict[str, str] = {
    "scan_renumber": q(
        _RET, "m AS (SELECT frame, count(*) AS n FROM r0 GROUP BY frame)",
        "p AS (SELECT frame, pt FROM r0 JOIN m USING (frame) WHERE n <= 37 UNION SELECT frame, CASE WHEN i = 36 THEN n - 1 ELSE CAST(floor(i * (n - 1) / 36e0) AS BIGINT) END FROM m, (SELECT unnest(generate_series(0, 36)) AS i) WHERE n > 37)",
        body="SELECT frame, CAST(row_number() OVER (PARTITION BY frame ORDER BY pt) - 1 AS INTEGER) AS pt, round(x, 6) AS x FROM r0 SEMI JOIN p USING (frame, pt)",
    ),
    "keep_mask": q(_RET, body="SELECT frame, count(*) AS n, CAST(max(pt) AS INTEGER) AS last FROM r0 WHERE pt % 3 <> 0 GROUP BY frame"),
    "clamped_pose": q(_RET, _DRIVE, "a0 AS (SELECT DISTINCT frame, (frame - 5)::BIGINT * 111000000 AS t FROM r0)", *_pose_at("a0", "pa"), body="SELECT 0 AS track, CAST(frame AS BIGINT) AS query_id, t AS t_ns, round(px, 6) AS px, round(py, 6) AS py, round(pz, 6) AS pz, 0e0 AS qx, 0e0 AS qy, round(sin(yaw / 2), 6) AS qz, round(cos(yaw / 2), 6) AS qw FROM pa"),
    "deskewed": _deskewed(),
    "pose_quaternion": q(_TRAJ, body="SELECT event_id, 0e0 AS qx, 0e0 AS qy, round(CASE WHEN qw < 0 THEN -qz ELSE qz END, 6) AS qz, round(abs(qw), 6) AS qw FROM tr"),
    "local_frames": q(*_FRAMES, body=f"SELECT frame, pt, matched, {_AXES}, round(su, 4) AS su, round(sv, 4) AS sv, round(tau, 4) AS tau, round(conf, 4) AS conf FROM fr"),
    "knn_scan": q(_RET, _FLAT, _KNN, body="SELECT frame, pt, other, rank, round(d2, 6) AS dist2 FROM kn"),
    "support_limits": q(*_LIMITED, body="SELECT frame, pt, round(lu, 4) AS lu, round(lv, 4) AS lv FROM lm"),
    "lateral_disc": q(*_FRAMES, *_sample_ctes("fr", False), body=f"SELECT frame, pt, count(*) AS n, round(sum(weight), 4) AS weight, {_DISC} FROM sm WHERE j >= 0 AND side = 1 GROUP BY frame, pt"),
    "scan_samples": q(*_LIMITED, *_sample_ctes("lm", True), body="SELECT frame, count(*) AS n, round(sum(weight), 3) AS weight, round(sum(weight * value), 3) AS value FROM sm GROUP BY frame"),
    "sampled_nodes": q(*_LIMITED, *_sample_ctes("lm", True, "frame % 10 <> 5"), _spl("sb", "block,", "(SELECT block, x, y, z, value, weight FROM sm)"), _BND, _FUS, body="SELECT k, round(coalesce(value_sum / nullif(weight_sum, 0), 0), 4) AS value, round(weight_sum, 4) AS weight, hit_count AS hits FROM fus"),
    "unit_evidence": q(
        *_VOTES, _spl("sf", "block, frame,"), "uh AS (SELECT block, k, count(*) AS hits FROM sf GROUP BY block, k)",
        "un AS (SELECT coalesce(uh.k, bv.k) AS k, hits, n_scans FROM uh FULL JOIN bv ON uh.block = bv.c AND uh.k = bv.k)",
        "tt AS (SELECT coalesce(count(hits) / nullif(CAST(sum(hits) AS DOUBLE), 0), 1) AS sh, coalesce(count(n_scans) / nullif(CAST(sum(n_scans) AS DOUBLE), 0), 1) AS sp FROM un)",
        body="SELECT k, round(coalesce(sum(hits), 0) * any_value(sh), 4) AS h, round(coalesce(sum(n_scans), 0) * any_value(sp), 4) AS p FROM un, tt GROUP BY k",
    ),
    "pass_votes": q(*_FIELD, *gradient_ctes("nod", ""), *scan_rays(), *vote_ctes("gr", "er", ""), body="SELECT k, count(*) AS n_free FROM vf GROUP BY k"),
    "block_prefix": q(*_PREFIX, body="SELECT CAST(c AS INTEGER) AS c, count(*) AS nodes, count(*) FILTER (WHERE touched) AS touched, count(*) FILTER (WHERE w > 0 AND s <= 0) AS candidates, CAST(sum(h) AS BIGINT) AS hits FROM pn GROUP BY c"),
    "block_votes": q(*_VOTES, body="SELECT k, count(*) AS p, CAST(sum(n_scans) AS BIGINT) AS n_scans FROM bv GROUP BY k"),
    "solve_region": q(*_REGION, body="SELECT home AS block, count(*) AS n, CAST(max(inside) AS INTEGER) AS inside, round(sum(c), 4) AS c FROM sr GROUP BY home"),
    "solved_region": _solved(),
    "evicted_blocks": q(*_FIELD, f"bk AS (SELECT DISTINCT {block_of('k', 8)} AS block FROM nod)", body="SELECT block FROM bk WHERE " + " + ".join(f"(({c} + 0.5e0) * 8) * (({c} + 0.5e0) * 8)" for c in unpack("block")) + " > 1600"),
}
