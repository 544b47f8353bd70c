"""SQL texts that give the registered queries' rows independently (brute-force joins in place of indexes)."""

from __future__ import annotations

import numpy as np

from ..functions import stats
from ..functions.geometry import ICRS_TO_GALACTIC
from ..operators.projection import simpson_weights

N = 16
TWO_PI = 6.283185307179586


def num(x: float) -> str:
    """A double literal (plain decimals would be fixed-point)."""
    text = repr(float(x))
    return text if "e" in text else text + "e0"


def frac(x: str) -> str:
    return f"({x} - floor({x}))"


def sky(key: str) -> str:
    lon, z = frac(f"{key} * {num(137.50776405 / 360)}"), frac(f"{key} * 0.6180339887498949e0")
    return f"360 * {lon} AS lon, degrees(asin(2 * {z} - 1)) AS lat"


MAP = f"m AS (SELECT l_orderkey % {12 * N * N} AS pix, avg(sqrt(l_extendedprice)) AS value FROM lineitem GROUP BY 1)"


def rings(n: int) -> str:
    return f"""r AS (SELECT k, CASE WHEN k < {n} THEN 4 * k WHEN k <= {3 * n} THEN {4 * n} ELSE 4 * ({4 * n} - k) END AS nr,
  CASE WHEN k < {n} THEN 2 * k * (k - 1) WHEN k <= {3 * n} THEN {2 * n * (n - 1)} + (k - {n}) * {4 * n} ELSE {12 * n * n} - 2 * ({4 * n} - k) * ({4 * n} - k + 1) END AS st,
  CASE WHEN k < {n} THEN 1 - k * k / {3.0 * n * n} WHEN k <= {3 * n} THEN 2 * ({2.0 * n} - k) / {3.0 * n} ELSE ({4 * n} - k) * ({4 * n} - k) / {3.0 * n * n} - 1 END AS z,
  CASE WHEN k >= {n} AND k <= {3 * n} AND (k - {n}) % 2 = 1 THEN 0.0 ELSE 0.5 END AS sh FROM range(1, {4 * n}) t(k)),
c AS (SELECT st + i AS pix, z, (i + sh) * {TWO_PI} / nr AS phi FROM (SELECT *, unnest(range(0, nr)) AS i FROM r))"""


def pixel(n: int, z: str, phi: str) -> str:
    """Pixel of a direction, from columns z and phi."""
    tt = f"(({phi} - {TWO_PI} * floor({phi} / {TWO_PI})) / 1.5707963267948966)"
    jp, jm = f"floor({n} * (0.5 + {tt}) - 0.75 * {n} * {z})", f"floor({n} * (0.5 + {tt}) + 0.75 * {n} * {z})"
    ir = f"({n} + 1 + {jp} - {jm})"
    q = f"floor(({jp} + {jm} - {n} + (1 - ({ir} % 2 + 2) % 2) + 1) / 2)"
    ip = f"(({q} % {4 * n} + {4 * n}) % {4 * n})"
    t = f"({n} * sqrt(3 * (1 - abs({z}))))"
    part = f"({tt} - floor({tt}))"
    cr = f"(floor({part} * {t}) + floor((1 - {part}) * {t}) + 1)"
    ci = f"(floor({tt} * {cr}) % (4 * {cr}))"
    return f"CAST(CASE WHEN abs({z}) <= {2.0 / 3!r} THEN {2 * n * (n - 1)} + ({ir} - 1) * {4 * n} + {ip} WHEN {z} > 0 THEN 2 * {cr} * ({cr} - 1) + {ci} ELSE {12 * n * n} - 2 * {cr} * ({cr} + 1) + {ci} END AS BIGINT)"


DISTANCE = "(c.z * s.z0 + sqrt(greatest((1 - c.z * c.z) * (1 - s.z0 * s.z0), 0)) * cos(c.phi - s.phi0))"
SOURCES = f"s AS (SELECT *, sin(radians(lat)) AS z0, radians(lon) AS phi0 FROM (SELECT o_orderkey AS source_id, {sky('o_orderkey')} FROM orders))"


def cosr(arcmin: float) -> str:
    return f"cos({arcmin!r} * {np.pi / 10800!r})"


aperture_mean = f"""WITH {MAP}, {rings(N)}, {SOURCES},
j AS (SELECT s.source_id, m.value FROM s JOIN c ON {DISTANCE} >= {cosr(300.0)} JOIN m USING (pix))
SELECT s.source_id, count(j.value) AS n_pix, round(avg(j.value), 6) AS signal FROM s LEFT JOIN j USING (source_id) GROUP BY s.source_id"""
annulus_mean = f"""WITH {MAP}, {rings(N)}, {SOURCES},
j AS (SELECT s.source_id, m.value FROM s JOIN c ON {DISTANCE} >= {cosr(600.0)} AND {DISTANCE} < {cosr(300.0)} JOIN m USING (pix))
SELECT s.source_id, count(j.value) AS n_pix, round(avg(j.value), 6) AS background FROM s LEFT JOIN j USING (source_id) GROUP BY s.source_id"""
RADII = (120.0, 240.0, 360.0, 480.0, 600.0)
_r = ", ".join(f"({i}, {r!r}, {cosr(r)})" for i, r in enumerate(RADII))
enclosed_profile = f"""WITH {MAP}, {rings(N)}, {SOURCES}, radii AS (SELECT * FROM (VALUES {_r}) t(r_idx, radius, cr)),
j AS (SELECT s.source_id, {DISTANCE} AS d, m.value FROM s JOIN c ON {DISTANCE} >= {cosr(600.0)} JOIN m USING (pix)),
g AS (SELECT source_id, r_idx, radius, cr FROM s CROSS JOIN radii)
SELECT g.source_id, g.r_idx, g.radius, count(j.value) AS n_pix, round(avg(j.value), 6) AS signal
FROM g LEFT JOIN j ON g.source_id = j.source_id AND j.d >= g.cr GROUP BY ALL"""

_plastic = frac("o_orderkey * 0.7548776662466927e0")
_size = frac("o_orderkey * 0.5698402909980532e0")
HALOS = f"""h0 AS (SELECT o_orderkey AS halo_idx, o_totalprice * 1e10 AS mass, {sky('o_orderkey')}, 300 * cbrt({_plastic}) AS rr, 0.5 + 1.5 * {_size} AS r500 FROM orders),
h AS (SELECT halo_idx, mass, r500, 340.5 + rr * (cos(radians(lat)) * cos(radians(lon))) AS x, 340.5 + rr * (cos(radians(lat)) * sin(radians(lon))) AS y, 340.5 + rr * sin(radians(lat)) AS z FROM h0)"""


def rotation(x: str, y: str, z: str, inverse: bool = False) -> list[str]:
    m = tuple(zip(*ICRS_TO_GALACTIC, strict=True)) if inverse else ICRS_TO_GALACTIC
    return [f"({x} * {a!r} + {y} * {b!r} + {z} * {c!r})" for a, b, c in m]


def lon_of(x: str, y: str) -> str:
    return f"((degrees(atan2({y}, {x})) % 360 + 360) % 360)"


_v = rotation("(x - 340.5)", "(y - 340.5)", "(z - 340.5)")
SKY_HALOS = f"""{HALOS}, t AS (SELECT *, {_v[0]} AS gx, {_v[1]} AS gy, {_v[2]} AS gz, sqrt((x - 340.5) * (x - 340.5) + (y - 340.5) * (y - 340.5) + (z - 340.5) * (z - 340.5)) AS r FROM h),
u AS (SELECT *, {lon_of('gx', 'gy')} AS ell, degrees(asin(greatest(least(gz / sqrt(gx * gx + gy * gy + gz * gz), 1), -1))) AS b, degrees(atan(r500 / nullif(r, 0))) * 60 AS theta FROM t)"""
halo_cuts = f"""WITH {SKY_HALOS} SELECT halo_idx, round(r, 6) AS r, round(ell, 6) AS ell, round(b, 6) AS b, round(theta, 6) AS theta, round(log10(mass), 6) AS log_mass
FROM u WHERE r <= 250 AND abs(b) >= 10 AND theta >= 5 AND theta <= 6000 AND mass >= 1e14 AND mass <= 4e15"""
halo_sorted = "SELECT o_orderkey AS halo_idx, o_totalprice * 1e10 AS mass, row_number() OVER (ORDER BY o_totalprice * 1e10 DESC, o_orderkey) AS mass_rank FROM orders"
extent_centre_cut = """WITH p AS (SELECT vec_id AS id, label AS sim, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z, 1e13 * (1 + vec_id % 17) AS mass FROM embeddings),
e AS (SELECT sim, (max(x) + min(x)) / 2 AS cx, (max(y) + min(y)) / 2 AS cy, (max(z) + min(z)) / 2 AS cz FROM p GROUP BY sim)
SELECT id, sim, round(sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy) + (z - cz) * (z - cz)), 9) AS r FROM p JOIN e USING (sim)
WHERE sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy) + (z - cz) * (z - cz)) <= 0.3 AND mass >= 5e13"""


FINE, WIDE_RADII = 64, (300.0, 600.0, 900.0, 1200.0, 1500.0)
_wide = ", ".join(f"({i}, {r!r}, {cosr(r)})" for i, r in enumerate(WIDE_RADII))
wide_profile = f"""WITH m AS (SELECT l_orderkey % {12 * FINE * FINE} AS pix, avg(sqrt(l_extendedprice)) AS value FROM lineitem GROUP BY 1), {rings(FINE)},
s AS (SELECT *, sin(radians(lat)) AS z0, radians(lon) AS phi0 FROM (SELECT s_suppkey AS source_id, {sky('s_suppkey')} FROM supplier)), radii AS (SELECT * FROM (VALUES {_wide}) t(r_idx, radius, cr)),
j AS (SELECT s.source_id, {DISTANCE} AS d, m.value FROM s JOIN c ON {DISTANCE} >= {cosr(WIDE_RADII[-1])} JOIN m USING (pix))
SELECT g.source_id, g.r_idx, g.radius, count(j.value) AS n_pix, round(avg(j.value), 6) AS signal FROM (SELECT source_id, r_idx, radius, cr FROM s CROSS JOIN radii) g
LEFT JOIN j ON g.source_id = j.source_id AND j.d >= g.cr GROUP BY ALL"""


def bin_tables(rows: str) -> str:
    """Tables n, k, top, steps and b (bins) over ``l(lm, k)``; to stand after WITH RECURSIVE."""
    return f"""l AS ({rows}), k AS (SELECT lm, row_number() OVER (ORDER BY lm DESC, k) AS rank FROM l), n AS (SELECT count(*) AS n, min(lm) AS low FROM l),
ends AS (SELECT * FROM (VALUES (0, 0, 10), (1, 10, 60), (2, 60, 160)) t(i, s, e)),
top AS (SELECT i, s, e, lm AS lo, lag(lm) OVER (ORDER BY i) AS hi FROM ends JOIN k ON rank = e),
steps AS (SELECT 3 AS i, greatest((SELECT min(lo) FROM top) - 0.2, low) AS lo, (SELECT min(lo) FROM top) AS hi FROM n
  UNION ALL SELECT i + 1, greatest(lo - 0.2, low), lo FROM steps, n WHERE lo > low),
b AS (SELECT i, lo, hi FROM top UNION ALL SELECT i, lo, hi FROM steps)"""


mass_bins = f"""WITH RECURSIVE {bin_tables('SELECT log10(o_totalprice * 1e10) AS lm, o_orderkey AS k FROM orders')},
c AS (SELECT i, count(l.lm) AS n FROM b LEFT JOIN l ON lm >= lo AND (hi IS NULL OR lm < hi) GROUP BY i),
d AS (SELECT i, lm FROM top JOIN k ON rank > s AND rank <= e UNION ALL SELECT i, lm FROM steps JOIN l ON lm >= lo AND (lm < hi OR (lm = hi AND i = (SELECT max(i) FROM steps)))),
e AS (SELECT i, median(lm) AS m FROM d GROUP BY i)
SELECT CAST(b.i AS INTEGER) AS bin_idx, round(lo, 6) AS lo, round(hi, 6) AS hi, c.n AS count, round(m, 6) AS median_log_mass FROM b JOIN c USING (i) LEFT JOIN e USING (i)"""
POOL = """ends0 AS (SELECT user_id, min(event_id) AS lo, max(event_id) AS hi FROM events GROUP BY user_id),
e AS (SELECT user_id, CAST(floor((event_id - lo) * 40 / (hi - lo + 1)) AS INTEGER) + 1 AS r_idx, sum(sqrt(value)) AS s, count(value) AS n FROM events JOIN ends0 USING (user_id) GROUP BY ALL),
us AS (SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS row FROM ends0),
q AS (SELECT row, us.user_id, CAST(kk AS INTEGER) AS r_idx, sum(s) OVER w / sum(n) OVER w AS signal FROM us CROSS JOIN range(1, 41) g(kk) LEFT JOIN e ON e.user_id = us.user_id AND e.r_idx = kk WINDOW w AS (PARTITION BY us.user_id ORDER BY kk ROWS UNBOUNDED PRECEDING)),
sg AS (SELECT row, r_idx AS x0, signal AS y0, lead(r_idx) OVER w AS x1, lead(signal) OVER w AS y1 FROM q WINDOW w AS (PARTITION BY row ORDER BY r_idx))"""
pool_pvalue = f"""WITH {POOL}, n AS (SELECT r_idx, count(*) AS n FROM q GROUP BY r_idx)
SELECT a.r_idx, a.user_id, round(CAST(count(b.signal) AS DOUBLE) / any_value(n), 9) AS p FROM q a JOIN n ON a.r_idx = n.r_idx LEFT JOIN q b ON a.r_idx = b.r_idx AND b.signal >= a.signal * 1.02 GROUP BY a.r_idx, a.user_id"""
N_BOOT, N_STACK, N_SRC = 10_000, 1_000, 100
bootstrap_stack = f"""WITH {POOL}, nr AS (SELECT count(DISTINCT row) AS n FROM q),
d AS (SELECT rep, (draw * 7919 + rep * 104729 + draw * rep + 17) % n AS row FROM nr, range(0, {N_BOOT}) a(rep), (SELECT unnest(range(0, (SELECT n FROM nr))) AS draw) b),
s AS (SELECT r_idx, rep, avg(signal) AS m FROM d JOIN q USING (row) GROUP BY ALL),
x AS (SELECT r_idx, stddev_pop(m) AS error FROM s GROUP BY r_idx)
SELECT CAST(q.r_idx AS INTEGER) AS r_idx, round(avg(signal), 6) AS mean, round(any_value(error), 6) AS error FROM q JOIN x ON q.r_idx = x.r_idx GROUP BY q.r_idx"""
STACKS = f"""nr AS (SELECT count(DISTINCT row) AS n FROM q),
d AS (SELECT rep, (draw * 7919 + rep * 104729 + draw * rep + 17) % n AS row FROM nr, range(0, {N_STACK}) a(rep), range(0, {N_SRC}) b(draw)),
s AS (SELECT r_idx, rep, avg(signal) AS m FROM d JOIN q USING (row) GROUP BY ALL)"""
random_stack = f"WITH {POOL}, {STACKS} SELECT CAST(r_idx AS INTEGER) AS r_idx, rep, round(m, 6) AS mean FROM s"


def isf(p: str) -> str:
    """Rational approximation of the normal quantile, with the published numbers."""

    def poly(c: tuple, x: str) -> str:
        out = repr(c[0])
        for k in c[1:]:
            out = f"({out} * {x} + {k!r})"
        return out

    q, r = f"(0.5 - {p})", f"((0.5 - {p}) * (0.5 - {p}))"
    lo, hi = f"sqrt(-2 * ln(1 - {p}))", f"sqrt(-2 * ln({p}))"
    tail = lambda t: f"({poly(stats._C, t)} / ({poly(stats._D, t)} * {t} + 1))"
    return f"CASE WHEN {p} <= 0 OR {p} >= 1 THEN NULL WHEN 1 - {p} < 0.02425 THEN {tail(lo)} WHEN {p} < 0.02425 THEN -{tail(hi)} ELSE {q} * {poly(stats._A, r)} / ({poly(stats._B, r)} * {r} + 1) END"


empirical_sigma_profile = f"""WITH {POOL}, {STACKS}, dm AS (SELECT r_idx, avg(signal) AS dmean FROM q GROUP BY r_idx),
p AS (SELECT CAST(s.r_idx AS INTEGER) AS r_idx, avg(CASE WHEN m >= dmean THEN 1.0 ELSE 0.0 END) AS p FROM s JOIN dm USING (r_idx) GROUP BY ALL)
SELECT r_idx, round(p, 9) AS p, round({isf('p')}, 6) AS sigma FROM p"""


def separation(a: str, b: str) -> str:
    h = f"pow(sin((radians({a}.lat) - radians({b}.lat)) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({a}.lon - {b}.lon) / 2), 2)"
    return f"(degrees(2 * asin(least(sqrt({h}), 1.0))) * 60)"


crossmatch_best = f"""WITH o AS (SELECT c_custkey AS obs_id, {sky('(c_custkey + 0.31)')}, c_acctbal / 1e6 AS z FROM customer), t AS (SELECT s_suppkey AS cat_id, {sky('s_suppkey')}, s_acctbal / 1e6 AS z FROM supplier),
j AS (SELECT obs_id, cat_id, {separation('o', 't')} AS sep, abs(o.z - t.z) AS dz FROM o JOIN t ON {separation('o', 't')} <= 240 AND abs(o.z - t.z) <= 0.005),
k AS (SELECT *, row_number() OVER (PARTITION BY obs_id ORDER BY sep, cat_id) AS rn FROM j)
SELECT o.obs_id, k.cat_id, round(sep, 6) AS separation_arcmin, round(dz, 9) AS delta_z FROM o LEFT JOIN k ON o.obs_id = k.obs_id AND rn = 1"""
MASS_FUNCTION = tuple((12 + k / 4, 10 ** (-2 - 0.8 * k / 4 - 0.06 * (k / 4) ** 2)) for k in range(33))


def _piece(i: int) -> str:
    near = MASS_FUNCTION[max(0, min(i - 1, len(MASS_FUNCTION) - 4)) :][:4]
    return "(" + ", ".join(num(x) for x in (MASS_FUNCTION[i][0], MASS_FUNCTION[i + 1][0], *[p for p, _ in near], *[d for _, d in near])) + ")"


_seg = ", ".join(_piece(i) for i in range(len(MASS_FUNCTION) - 1))
_cubic = " + ".join(f"y{j} * " + " * ".join(f"(log_mass - p{k}) / (p{j} - p{k})" for k in range(4) if k != j) for j in range(4))
POINTS = f"""p0 AS (SELECT vec_id AS id, label AS sim, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z, 13 + 4 * abs(CAST(embedding[4] AS DOUBLE)) AS log_mass FROM embeddings),
p AS (SELECT p0.*, 1000 * ({_cubic}) AS n FROM p0 JOIN (VALUES {_seg}) t(m0, m1, p0, p1, p2, p3, y0, y1, y2, y3) ON log_mass >= m0 AND log_mass < m1),
f AS (SELECT s_suppkey AS ref_id, 0.4 * ({frac('s_suppkey * 0.6180339887498949e0')} - 0.5) AS x, 0.4 * ({frac('s_suppkey * 0.7548776662466927e0')} - 0.5) AS y, 0.4 * ({frac('s_suppkey * 0.5698402909980532e0')} - 0.5) AS z, 13.5 AS log_mass FROM supplier)"""
_d = "sqrt((p.x - f.x) * (p.x - f.x) + (p.y - f.y) * (p.y - f.y) + (p.z - f.z) * (p.z - f.z))"
_cdf = f"(1 - exp(-4.0 / 3 * {np.pi!r} * pow(dist, 3) * n))"
NEAR = f"{POINTS}, w AS (SELECT f.ref_id, p.id, p.n, {_d} AS dist, abs(p.log_mass - f.log_mass) AS dlogm FROM f JOIN p ON {_d} <= 0.1)"
radius_cdf = f"WITH {NEAR} SELECT ref_id, id, round(dist, 9) AS dist, round({_cdf}, 9) AS cdf, round(dlogm, 9) AS dlogm FROM w"
match_halo = f"""WITH {NEAR}, k AS (SELECT *, {_cdf} AS cdf, row_number() OVER (PARTITION BY ref_id ORDER BY {_cdf}, id) AS rn FROM w WHERE {_cdf} < 0.5 AND dlogm < 0.5)
SELECT f.ref_id, k.id, round(cdf, 9) AS cdf, round(dist, 9) AS dist FROM f LEFT JOIN k ON f.ref_id = k.ref_id AND rn = 1"""
pval_matrix = f"""WITH {POINTS}, w AS (SELECT f.ref_id AS obs_id, p.sim AS label, p.x AS px, p.y AS py, p.z AS pz, f.x AS fx, f.y AS fy, f.z AS fz, n, {_d} AS dist FROM f CROSS JOIN p)
SELECT obs_id, label, round(avg(CASE WHEN dist <= 0.1 THEN {_cdf} ELSE 1 END), 9) AS pval, round(sqrt(pow(any_value(fx) - avg(px), 2) + pow(any_value(fy) - avg(py), 2) + pow(any_value(fz) - avg(pz), 2)), 9) AS dist FROM w GROUP BY obs_id, label"""
greedy_pairs = f"""WITH RECURSIVE mx AS ({pval_matrix}), ok AS (SELECT * FROM mx WHERE pval <= 0.9999),
g AS (SELECT 0 AS n, [-1]::BIGINT[] AS rows, [-1]::BIGINT[] AS cols
  UNION ALL SELECT n + 1, list_append(rows, b.obs_id), list_append(cols, b.label) FROM g, LATERAL (SELECT obs_id, label FROM ok WHERE NOT list_contains(rows, obs_id) AND NOT list_contains(cols, label) ORDER BY pval, obs_id, label LIMIT 1) b),
f AS (SELECT rows, cols FROM g ORDER BY n DESC LIMIT 1), p AS (SELECT unnest(rows) AS obs_id, unnest(cols) AS label FROM f)
SELECT ok.obs_id, ok.label, ok.pval, ok.dist FROM p JOIN ok USING (obs_id, label)"""
halo_neighbours = f"WITH {POINTS} SELECT f.id, count(*) AS n_near, round(sum({_d}), 6) AS total_dist FROM p0 f JOIN p0 p ON {_d} <= 0.1 GROUP BY f.id"
_pz = "(z / sqrt(x * x + y * y + z * z))"
particle_projection = f"""WITH {POINTS}, v AS (SELECT {_pz} AS zz, atan2(y, x) AS phi FROM p0 WHERE sqrt(x * x + y * y + z * z) <= 0.4), g AS (SELECT {pixel(4, 'zz', 'phi')} AS pix, count(*) AS n FROM v GROUP BY 1)
SELECT a.pix, coalesce(g.n, 0) AS n FROM range(0, 192) a(pix) LEFT JOIN g USING (pix)"""
_g = {c: f"((3.0 + r * d{c}) * 6 / 6.0 - 0.5)" for c in "xyz"}
_w = ", ".join(f"({k}, {w!r})" for k, w in enumerate(simpson_weights(6)))
grid_projection = f"""WITH {rings(2)}, grid AS (SELECT CAST(o_orderkey % 6 AS INTEGER) AS ix, CAST((o_orderkey // 6) % 6 AS INTEGER) AS iy, CAST((o_orderkey // 36) % 6 AS INTEGER) AS iz, avg(sqrt(o_totalprice)) AS rho FROM orders GROUP BY ALL),
st AS (SELECT pix, k * 0.4 AS r, pow(k * 0.4, 2) * sw AS w, sqrt(1 - z * z) * cos(phi) AS dx, sqrt(1 - z * z) * sin(phi) AS dy, z AS dz FROM c, (VALUES {_w}) t(k, sw)),
b AS (SELECT pix, w, {_g['x']} AS gx, {_g['y']} AS gy, {_g['z']} AS gz FROM st),
k AS (SELECT pix, w, CAST(least(floor(gx), 4) + i AS INTEGER) AS ix, CAST(least(floor(gy), 4) + j AS INTEGER) AS iy, CAST(least(floor(gz), 4) + l AS INTEGER) AS iz,
  CASE WHEN i = 1 THEN gx - least(floor(gx), 4) ELSE 1 - gx + least(floor(gx), 4) END * CASE WHEN j = 1 THEN gy - least(floor(gy), 4) ELSE 1 - gy + least(floor(gy), 4) END * CASE WHEN l = 1 THEN gz - least(floor(gz), 4) ELSE 1 - gz + least(floor(gz), 4) END AS t
  FROM b, range(0, 2) a1(i), range(0, 2) a2(j), range(0, 2) a3(l))
SELECT pix, round(sum(w * t * rho) / sum(w * t), 6) AS value FROM k JOIN grid USING (ix, iy, iz) GROUP BY pix"""
_rho, _ang = "sqrt(xr * xr + yr * yr)", "atan2(xr, yr)"
cutout_stack = f"""WITH {MAP}, s AS (SELECT s_suppkey AS source_id, {sky('s_suppkey')}, 300 + (s_suppkey % 5) * 60 AS theta FROM supplier),
g AS (SELECT source_id, lon, lat, theta, (ix - 5) * 1200.0 / 11 AS x, (iy - 5) * 1200.0 / 11 AS y FROM s, range(0, 11) a(ix), range(0, 11) b(iy)),
a AS (SELECT *, x * {np.pi / 10800!r} AS xr, y * {np.pi / 10800!r} AS yr FROM g),
t AS (SELECT *, sin(radians(lat)) * cos({_rho}) + cos(radians(lat)) * sin({_rho}) * cos({_ang}) AS zz,
  radians(lon) + atan2(sin({_rho}) * sin({_ang}), cos(radians(lat)) * cos({_rho}) - sin(radians(lat)) * sin({_rho}) * cos({_ang})) AS ph FROM a),
v AS (SELECT t.*, {pixel(N, 'zz', 'ph')} AS pix FROM t),
n AS (SELECT source_id, CAST(floor((x / theta + 2) / (4.0 / 6)) AS INTEGER) AS iu, CAST(floor((y / theta + 2) / (4.0 / 6)) AS INTEGER) AS iv, value FROM v JOIN m USING (pix)),
o AS (SELECT source_id, iu, iv, avg(value) AS value FROM n WHERE iu BETWEEN 0 AND 5 AND iv BETWEEN 0 AND 5 GROUP BY ALL)
SELECT iu, iv, round(avg(value), 6) AS value, count(*) AS n_sources FROM o GROUP BY iu, iv"""
_X, _W = np.polynomial.legendre.leggauss(16)


def distance(z: str, om: float = 0.3111) -> str:
    total = " + ".join(f"{float(w)!r} / sqrt({om} * pow(1 + {z} * {float((x + 1) / 2)!r}, 3) + {1 - om!r})" for x, w in zip(_X, _W, strict=True))
    return f"(2997.92458 * {z} / 2 * ({total}))"


_E = "pow(sqrt(0.3111 * pow(1 + z, 3) + 0.6889), -2.0 / 3)"
mass_matched_y = f"""WITH {POOL}, t AS (SELECT user_id AS key, 1 + (user_id % 39) + 0.37 AS theta, 0.01 + 0.0001 * (user_id % 1000) AS z FROM (SELECT DISTINCT user_id FROM events)),
g AS (SELECT user_id AS key, r_idx AS r0, signal AS s0, lead(r_idx) OVER w AS r1, lead(signal) OVER w AS s1 FROM q WINDOW w AS (PARTITION BY user_id ORDER BY r_idx)),
i AS (SELECT t.*, s0 + (theta - r0) * (s1 - s0) / (r1 - r0) AS signal FROM t JOIN g ON t.key = g.key AND theta >= r0 AND theta < r1),
y AS (SELECT *, {np.pi!r} * pow(theta * {np.pi / 10800!r}, 2) * (signal - signal / 2) AS ys, {distance('z')} / (1 + z) AS d FROM i)
SELECT key, round(signal, 6) AS signal, round(d, 6) AS d_a, round(ys * d * d * {_E}, 6) AS y_scaled FROM y"""
catalogue_scaling = f"""WITH a AS (SELECT c_custkey AS key, c_acctbal / 1e3 AS y5r500, 0.1 + (c_custkey % 7) / 10.0 AS y5r500_err, 1 + (c_custkey % 11) / 2.0 AS msz, 0.3 AS msz_err_up, 0.25 AS msz_err_low, 0.01 + (c_custkey % 13) / 200.0 AS z FROM customer),
y AS (SELECT *, {distance('z')} / (1 + z) * {100.0 / 70.0!r} AS d FROM a WHERE y5r500 > 0)
SELECT key, round(1e6 * (y5r500 / 1.81 * 1e-3 * {(np.pi / 10800) ** 2!r} * d * d * {_E}), 6) AS y500, round(log10(msz * 1e14 * 0.7), 6) AS log_mass, round(y5r500_err / (y5r500 * {float(np.log(10))!r}), 6) AS log_y_err,
  round(log10(msz + msz_err_up) - log10(msz), 6) AS log_m_up, round(log10(msz) - log10(msz - msz_err_low), 6) AS log_m_low FROM y"""
sim_summary = """WITH a AS (SELECT label AS bin_idx, CAST(embedding[1] AS DOUBLE) AS signal, abs(CAST(embedding[2] AS DOUBLE)) AS error, CAST(embedding[3] AS DOUBLE) AS re, CAST(embedding[4] AS DOUBLE) AS p FROM embeddings)
SELECT bin_idx, round(avg(signal), 9) AS signal, round(avg(error), 9) AS error, round(sqrt(avg(re * re)), 9) AS random_error, round(median(CASE WHEN p > 0 THEN p END), 9) AS p_median,
  round(quantile_cont(CASE WHEN p > 0 THEN p END, 0.16), 9) AS p_16, round(quantile_cont(CASE WHEN p > 0 THEN p END, 0.84), 9) AS p_84 FROM a GROUP BY bin_idx"""
_sp = frac("(l_orderkey * 7 + l_linenumber) * 0.6180339887498949e0")
stouffer = f"""WITH a AS (SELECT l_suppkey AS supp, {_sp} AS p FROM lineitem), b AS (SELECT supp, greatest(least(p, {1 - 1e-15!r}), 1e-15) AS p FROM a)
SELECT supp, count(*) AS n, round(sum({isf('p')}) / sqrt(count(*)), 6) AS z FROM b GROUP BY supp"""
_c = rotation("(cos(radians(lat)) * cos(radians(lon)))", "(cos(radians(lat)) * sin(radians(lon)))", "sin(radians(lat))")
galactic_frame = f"""WITH a AS (SELECT c_custkey AS key, {sky('c_custkey')} FROM customer), b AS (SELECT key, {_c[0]} AS x, {_c[1]} AS y, {_c[2]} AS z FROM a)
SELECT key, round({lon_of('x', 'y')}, 6) AS ell, round(degrees(asin(greatest(least(z / sqrt(x * x + y * y + z * z), 1), -1))), 6) AS b FROM b"""
distances = f"""WITH a AS (SELECT s_suppkey AS key, (s_acctbal + 1000) / 1e5 AS z FROM supplier)
SELECT key, round({distance('z')}, 6) AS d_c, round({distance('z')} / (1 + z), 6) AS d_a, round(z, 9) AS z_back FROM a"""
map_statistics = f"WITH {MAP} SELECT count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM m"
degraded_map = f"WITH {MAP}, {rings(N)} SELECT {pixel(4, 'z', 'phi')} AS pix, round(avg(value), 6) AS value FROM m JOIN c USING (pix) GROUP BY 1"


def _part(a: float, b: float) -> str:
    p = frac(f"(sample * {num(a)} + key * {num(b)} + {num(0.5 * a)})")
    return f"greatest(least({p}, {num(1 - 1e-9)}), 1e-9)"


mass_ratio = f"""WITH a AS (SELECT s_suppkey AS key, 14 + {frac('s_suppkey * 0.6180339887498949e0')} AS la, 14 + {frac('s_suppkey * 0.7548776662466927e0')} AS lb FROM supplier),
s AS (SELECT *, unnest(range(0, 200)) AS sample FROM a), u AS (SELECT sample, la, lb, {_part(0.6180339887498949, 0.7548776662466927)} AS p1, {_part(0.5698402909980532, 0.3247179572447460)} AS p2 FROM s),
m AS (SELECT sample, avg(la + 0.1e0 * ({isf('p1')}) - lb - 0.05e0 * ({isf('p2')})) AS m FROM u GROUP BY sample)
SELECT round(avg(m), 6) AS mean, round(stddev_samp(m), 6) AS error FROM m"""

_line = lambda t: f"(y0 + ({t} - x0) * (y1 - y0) / (x1 - x0))"
_in = lambda t: f"x1 IS NOT NULL AND ({t} >= x0 OR x0 = 1) AND ({t} < x1 OR x1 = 40)"
signal_pvalue = f"""WITH {POOL}, t AS (SELECT c_custkey AS key, 44 * {frac('c_custkey * 0.6180339887498949e0')} - 1 AS theta, 14 + c_acctbal / 5000 AS signal FROM customer)
SELECT key, round(avg(CASE WHEN {_line('theta')} >= t.signal THEN 1.0 ELSE 0.0 END), 9) AS p FROM t JOIN sg ON {_in('theta')} GROUP BY key"""


def stack_tables(sources: str, norms: tuple[float, ...], n_boot: int, n_stack: int) -> str:
    """Tables data, rs (random stacks) and rt over ``sources(bin_idx, key, lon, lat, theta)``; needs the map, rings and pool."""
    far = max(norms)
    values = ", ".join(f"({i}, {num(x)})" for i, x in enumerate(norms))
    return f"""src AS (SELECT *, sin(radians(lat)) AS z0, radians(lon) AS phi0, row_number() OVER (PARTITION BY bin_idx ORDER BY key) - 1 AS number, count(*) OVER (PARTITION BY bin_idx) AS size FROM ({sources})),
nm AS (SELECT * FROM (VALUES {values}) t(r_idx, norm)),
px AS (SELECT s.bin_idx, s.number, s.theta, {DISTANCE} AS d, m.value FROM src s JOIN c ON {DISTANCE} >= cos(s.theta * {num(far * np.pi / 10800)}) JOIN m USING (pix)),
own AS (SELECT bin_idx, number, r_idx, avg(value) AS signal FROM px JOIN nm ON d >= cos(norm * theta * {num(np.pi / 10800)}) GROUP BY ALL),
bt AS (SELECT bin_idx, rep, (number * 7919 + rep * 104729 + number * rep + 17) % size AS number FROM src, range(0, {n_boot}) a(rep)),
bm AS (SELECT bin_idx, rep, r_idx, avg(signal) AS m FROM bt JOIN own USING (bin_idx, number) GROUP BY ALL),
be AS (SELECT bin_idx, r_idx, stddev_pop(m) AS error FROM bm GROUP BY ALL),
data AS (SELECT bin_idx, r_idx, avg(signal) AS stack FROM own GROUP BY ALL),
np AS (SELECT count(*) AS n FROM us),
rd AS (SELECT bin_idx, rep, (number * 7919 + rep * 104729 + number * rep + 17) % n AS row, (number * 6271 + rep * 92821 + number * rep + 29) % size AS number FROM src, np, range(0, {n_stack}) a(rep)),
rx AS (SELECT rd.bin_idx, rep, row, r_idx, least(greatest(theta * norm / 20, 1), 40) AS t FROM rd JOIN src USING (bin_idx, number), nm),
rs AS (SELECT bin_idx, rep, r_idx, avg({_line('t')}) AS m FROM rx JOIN sg ON sg.row = rx.row AND {_in('t')} GROUP BY ALL),
rt AS (SELECT bin_idx, r_idx, avg(m) AS random_mean, stddev_pop(m) AS random_error FROM rs GROUP BY ALL)"""


STACK_NORMS, STACK_BOOT, STACK_REPS = (0.5, 1.0, 2.0), 10_000, 1_000
_stack = "SELECT s_suppkey % 4 AS bin_idx, s_suppkey AS key, {}, 200 + 40 * (s_suppkey % 7) AS theta FROM supplier".format(sky("s_suppkey"))
stacked_profile = f"""WITH {MAP}, {rings(N)}, {POOL}, {stack_tables(_stack, STACK_NORMS, STACK_BOOT, STACK_REPS)}
SELECT CAST(data.bin_idx AS BIGINT) AS bin_idx, CAST(r_idx AS INTEGER) AS r_idx, round(stack, 6) AS stack, round(error, 6) AS error, round(random_mean, 6) AS random_mean, round(random_error, 6) AS random_error
FROM data JOIN be USING (bin_idx, r_idx) JOIN rt USING (bin_idx, r_idx)"""
SUITE_BOOT, SUITE_REPS = 1_000, 100
_suite_rows = "SELECT i AS bin_idx, halo_idx AS key, ell AS lon, b AS lat, theta FROM cut JOIN b ON lm >= lo AND (hi IS NULL OR lm < hi)"
mass_bin_suite = f"""WITH RECURSIVE {SKY_HALOS}, cut AS (SELECT halo_idx, ell, b, theta, log10(mass) AS lm FROM u WHERE r <= 250 AND abs(b) >= 10 AND theta >= 5 AND theta <= 6000 AND mass >= 1e14 AND mass <= 4e15),
{bin_tables('SELECT lm, halo_idx AS k FROM cut')}, {MAP}, {rings(N)}, {POOL}, {stack_tables(_suite_rows.replace('b AS lat', 'cut.b AS lat'), STACK_NORMS, SUITE_BOOT, SUITE_REPS)},
pv AS (SELECT rs.bin_idx, rs.r_idx, avg(CASE WHEN m >= stack THEN 1.0 ELSE 0.0 END) AS p FROM rs JOIN data ON rs.bin_idx = data.bin_idx AND rs.r_idx = data.r_idx GROUP BY ALL)
SELECT CAST(data.bin_idx AS INTEGER) AS bin_idx, CAST(r_idx AS INTEGER) AS r_idx, round(stack, 6) AS stack, round(error, 6) AS error, round(random_mean, 6) AS random_mean, round(random_error, 6) AS random_error, round(p, 9) AS p, round({isf('p')}, 6) AS sigma
FROM data JOIN be USING (bin_idx, r_idx) JOIN rt USING (bin_idx, r_idx) JOIN pv USING (bin_idx, r_idx)"""
_mv = rotation("x", "y", "z")
_near = lambda t: f"(SELECT avg(value) FROM c JOIN m USING (pix) WHERE {DISTANCE} >= cos(s.{t} * {num(np.pi / 10800)}))"
_tail = lambda t, v: f"(SELECT avg(CASE WHEN s.{v} IS NULL THEN NULL WHEN y0 + (s.{t} / 20 - x0) * (y1 - y0) / (x1 - x0) >= s.{v} THEN 1.0 ELSE 0.0 END) FROM sg WHERE {_in(f's.{t} / 20')})"
association_signals = f"""WITH {MAP}, {rings(N)}, {POOL},
p AS (SELECT vec_id AS id, label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z, 0.03 + 0.001 * (vec_id % 10) AS r500 FROM embeddings),
g AS (SELECT id, label, sqrt(x * x + y * y + z * z) AS r, r500, {_mv[0]} AS gx, {_mv[1]} AS gy, {_mv[2]} AS gz FROM p),
w AS (SELECT id, label, r, {lon_of('gx', 'gy')} AS ell, degrees(asin(greatest(least(gz / sqrt(gx * gx + gy * gy + gz * gz), 1), -1))) AS b, degrees(atan(r500 / r)) * 60 AS theta FROM g),
o AS (SELECT id, label, theta, sin(radians(b)) AS z0, radians(ell) AS phi0 FROM w), o1 AS (SELECT *, {_near('theta')} AS signal FROM o s), o2 AS (SELECT *, {_tail('theta', 'signal')} AS pval FROM o1 s),
h AS (SELECT label, count(*) AS n_members, avg(signal) AS mean_signal, avg(pval) AS mean_pval FROM o2 GROUP BY label),
d AS (SELECT label, median(r) AS median_r, median(ell) AS median_ell, median(b) AS median_b, median(theta) AS median_theta500 FROM w GROUP BY label),
d0 AS (SELECT *, sin(radians(median_b)) AS z0, radians(median_ell) AS phi0 FROM d), d1 AS (SELECT *, {_near('median_theta500')} AS median_signal FROM d0 s), d2 AS (SELECT *, {_tail('median_theta500', 'median_signal')} AS median_pval FROM d1 s)
SELECT label, n_members, round(mean_signal, 6) AS mean_signal, round(mean_pval, 9) AS mean_pval, round(median_r, 6) AS median_r, round(median_ell, 6) AS median_ell, round(median_b, 6) AS median_b,
  round(median_theta500, 6) AS median_theta500, round(median_signal, 6) AS median_signal, round(median_pval, 9) AS median_pval FROM d2 JOIN h USING (label)"""
masked_aperture = f"""WITH {MAP}, {rings(N)}, {SOURCES}, k AS (SELECT l_orderkey % {12 * N * N} AS pix, avg(l_discount) - 0.03 AS weight FROM lineitem GROUP BY 1),
j AS (SELECT s.source_id, m.value FROM s JOIN c ON {DISTANCE} >= {cosr(300.0)} JOIN m USING (pix) JOIN k USING (pix) WHERE weight > 0)
SELECT s.source_id, count(j.value) AS n_pix, round(avg(j.value), 6) AS signal FROM s LEFT JOIN j USING (source_id) GROUP BY s.source_id"""
RANDOM_CUTOUTS = 300
_low = num(np.sin(np.deg2rad(10.0)))
random_cutout_stack = cutout_stack.replace(
    f"s AS (SELECT s_suppkey AS source_id, {sky('s_suppkey')}, 300 + (s_suppkey % 5) * 60 AS theta FROM supplier)",
    f"""z AS (SELECT 300 + (s_suppkey % 5) * 60 AS theta, row_number() OVER (ORDER BY s_suppkey % 5) - 1 AS place, count(*) OVER () AS n FROM supplier),
s AS (SELECT id AS source_id, 360 * {frac('id * 0.3819660112501051e0')} AS lon, degrees(asin(least({_low} + (1 - {_low}) * {frac('id * 0.6180339887498949e0')}, 1.0))) * CASE WHEN {frac('id * 0.7548776662466927e0')} < 0.5 THEN -1 ELSE 1 END AS lat, theta
  FROM range(0, {RANDOM_CUTOUTS}) a(id) JOIN z ON (id * 7919 + 17) % n = place)""",
).replace("* 1200.0 / 11", "* 4 * theta / 11")
matched_in_both = f"""WITH o AS (SELECT c_custkey AS obs_id, {sky('(c_custkey + 0.31)')} FROM customer), t AS (SELECT s_suppkey AS cat_id, {sky('s_suppkey')} FROM supplier), v AS (SELECT s_suppkey AS cat_id, {sky('(s_suppkey + 0.5)')} FROM supplier),
a AS (SELECT obs_id, cat_id, {separation('o', 't')} AS sep FROM o JOIN t ON {separation('o', 't')} <= 1200 QUALIFY row_number() OVER (PARTITION BY obs_id ORDER BY {separation('o', 't')}, cat_id) = 1),
b AS (SELECT obs_id, cat_id, {separation('o', 'v')} AS sep FROM o JOIN v ON {separation('o', 'v')} <= 1200 QUALIFY row_number() OVER (PARTITION BY obs_id ORDER BY {separation('o', 'v')}, cat_id) = 1)
SELECT obs_id, a.cat_id AS cat_id_a, round(a.sep, 6) AS sep_a, b.cat_id AS cat_id_b, round(b.sep, 6) AS sep_b FROM a JOIN b USING (obs_id)"""

# ---------------------------------------------------------------- several realisations
SIMS, SIM_HEADS, SIM_BOOT, SIM_REPS, SIM_REPS_HIGH = 3, (10, 30, 60), 500, 50, 200
_CUT = f"""{SKY_HALOS}, cut AS (SELECT CAST(halo_idx % {SIMS} AS VARCHAR) AS sim, halo_idx, ell, u.b AS lat, theta, log10(mass) AS lm FROM u
  WHERE r <= 250 AND abs(b) >= 10 AND theta >= 5 AND theta <= 6000 AND mass >= 1e14 AND mass <= 4e15)"""
_heads = ", ".join(f"({i}, {sum(SIM_HEADS[:i])}, {sum(SIM_HEADS[: i + 1])})" for i in range(len(SIM_HEADS)))
SIM_BINS = f"""k AS (SELECT sim, lm, row_number() OVER (PARTITION BY sim ORDER BY lm DESC, halo_idx) AS rank FROM cut), n AS (SELECT sim, min(lm) AS low FROM cut GROUP BY sim),
top AS (SELECT sim, i, s, e, lm AS lo, lag(lm) OVER (PARTITION BY sim ORDER BY i) AS hi FROM (VALUES {_heads}) t(i, s, e) JOIN k ON rank = e),
steps AS (SELECT sim, {len(SIM_HEADS)} AS i, greatest(min(lo) - 0.2, any_value(low)) AS lo, min(lo) AS hi FROM top JOIN n USING (sim) GROUP BY sim
  UNION ALL SELECT sim, i + 1, greatest(lo - 0.2, low), lo FROM steps JOIN n USING (sim) WHERE lo > low),
bins AS (SELECT sim, i, lo, hi FROM top UNION ALL SELECT sim, i, lo, hi FROM steps),
inbin AS (SELECT cut.*, i FROM cut JOIN bins ON cut.sim = bins.sim AND lm >= lo AND (hi IS NULL OR lm < hi))"""
sim_suite_bins = f"""WITH RECURSIVE {_CUT}, {SIM_BINS}, c AS (SELECT sim, i, count(*) AS n FROM inbin GROUP BY ALL),
d AS (SELECT top.sim, i, k.lm FROM top JOIN k ON k.sim = top.sim AND rank > s AND rank <= e
  UNION ALL SELECT steps.sim, i, lm FROM steps JOIN cut ON cut.sim = steps.sim AND lm >= lo AND (lm < hi OR (lm = hi AND i = (SELECT max(i) FROM steps q WHERE q.sim = steps.sim)))),
e AS (SELECT sim, i, median(lm) AS m FROM d GROUP BY ALL)
SELECT sim, CAST(i AS INTEGER) AS bin_idx, round(lo, 6) AS lo, round(hi, 6) AS hi, coalesce(c.n, 0) AS count, round(m, 6) AS median_log_mass FROM bins LEFT JOIN c USING (sim, i) LEFT JOIN e USING (sim, i)"""
sim_suite_halos = f"""WITH RECURSIVE {_CUT}, {SIM_BINS}, {MAP}, {rings(N)}, {POOL},
o AS (SELECT sim, halo_idx, i, theta, sin(radians(lat)) AS z0, radians(ell) AS phi0 FROM inbin),
a AS (SELECT s.halo_idx, avg(m.value) AS signal FROM o s JOIN c ON {DISTANCE} >= cos(s.theta * {num(np.pi / 10800)}) JOIN m USING (pix) GROUP BY s.halo_idx),
w AS (SELECT halo_idx, theta / 20 AS theta, signal FROM o JOIN a USING (halo_idx)),
v AS (SELECT halo_idx, avg(CASE WHEN {_line('theta')} >= w.signal THEN 1.0 ELSE 0.0 END) AS p FROM w JOIN sg ON {_in('theta')} GROUP BY halo_idx)
SELECT sim, halo_idx, CAST(i AS INTEGER) AS bin_idx, round(signal, 6) AS signal, round(p, 9) AS p FROM o LEFT JOIN a USING (halo_idx) LEFT JOIN v USING (halo_idx)"""
_sim_rows = "SELECT sim || '/' || CAST(i AS VARCHAR) AS bin_idx, halo_idx AS key, ell AS lon, lat, theta FROM inbin"
sim_suite_profiles = f"""WITH RECURSIVE {_CUT}, {SIM_BINS}, {MAP}, {rings(N)}, {POOL}, {stack_tables(_sim_rows, STACK_NORMS, SIM_BOOT, SIM_REPS_HIGH).replace(f"np, range(0, {SIM_REPS_HIGH}) a(rep))", f"np, range(0, {SIM_REPS_HIGH}) a(rep) WHERE rep < {SIM_REPS} OR split_part(bin_idx, '/', 2) IN ('0', '1'))")},
pv AS (SELECT rs.bin_idx, rs.r_idx, avg(CASE WHEN m >= stack THEN 1.0 ELSE 0.0 END) AS p FROM rs JOIN data ON rs.bin_idx = data.bin_idx AND rs.r_idx = data.r_idx GROUP BY ALL),
od AS (SELECT sim, i, row_number() OVER (PARTITION BY sim ORDER BY i) - 1 AS ord FROM (SELECT DISTINCT sim, i FROM inbin))
SELECT sim, CAST(i AS INTEGER) AS bin_idx, CAST(ord AS INTEGER) AS result_ord, CAST(r_idx AS INTEGER) AS r_idx, round(stack, 6) AS stack, round(error, 6) AS error, round(random_mean, 6) AS random_mean, round(random_error, 6) AS random_error, round(p, 9) AS p
FROM data JOIN be USING (bin_idx, r_idx) JOIN rt USING (bin_idx, r_idx) JOIN pv USING (bin_idx, r_idx) JOIN od ON data.bin_idx = sim || '/' || CAST(i AS VARCHAR)"""


def _images(name: str, rows: str) -> str:
    """Mean cutouts ``name(grp, iu, iv, value, n)`` of ``rows(grp, source_id, lon, lat, theta)``."""
    body = cutout_stack[cutout_stack.index("g AS (") : cutout_stack.index("\nSELECT iu, iv")]
    body = body.replace("FROM s,", f"FROM {name}_s,").replace("1200.0 / 11", "4 * theta / 11")
    for x in "gatvno":
        body = body.replace(f"\n{x} AS (", f"\n{name}_{x} AS (").replace(f"FROM {x})", f"FROM {name}_{x})").replace(f"FROM {x} ", f"FROM {name}_{x} ")
    body = body.replace("g AS (", f"{name}_g AS (", 1) if body.startswith("g AS (") else body
    return f"{name}_s AS ({rows}),\n{body.replace('v AS (SELECT t.*', 'v AS (SELECT *')},\n{name} AS (SELECT grp, iu, iv, avg(value) AS value, count(*) AS n FROM {name}_o JOIN (SELECT grp, source_id FROM {name}_s) USING (source_id) GROUP BY ALL)"


_halo_rows = "SELECT sim || '/' || CAST(i AS VARCHAR) AS grp, halo_idx AS source_id, ell AS lon, lat, theta FROM inbin WHERE i < 2"
_random_rows = f"""SELECT grp, grp || '/' || CAST(id AS VARCHAR) AS source_id, 360 * {frac('id * 0.3819660112501051e0')} AS lon,
  degrees(asin(least({_low} + (1 - {_low}) * {frac('id * 0.6180339887498949e0')}, 1.0))) * CASE WHEN {frac('id * 0.7548776662466927e0')} < 0.5 THEN -1 ELSE 1 END AS lat, theta
  FROM range(0, {RANDOM_CUTOUTS}) a(id) JOIN (SELECT grp, theta, row_number() OVER (PARTITION BY grp ORDER BY theta) - 1 AS place, count(*) OVER (PARTITION BY grp) AS n FROM near_s) z ON (id * 7919 + 17) % n = place"""
sim_suite_cutouts = f"""WITH RECURSIVE {_CUT}, {SIM_BINS}, {MAP}, {_images('near', _halo_rows)}, {_images('far', _random_rows)}
SELECT split_part(grp, '/', 1) AS sim, CAST(split_part(grp, '/', 2) AS INTEGER) AS bin_idx, iu, iv, round(near.value, 6) AS value, near.n AS n_sources, round(far.value, 6) AS random_value, far.n AS n_random FROM near FULL JOIN far USING (grp, iu, iv)"""


def upper_normal(z: str) -> str:
    """Upper tail of the normal law by the midpoint rule, for arguments of moderate size."""
    return f"(SELECT 0.5e0 - sum(exp(-0.5 * pow({z} * (k + 0.5e0) / 4000, 2))) * {z} / 4000 * {num(1 / np.sqrt(TWO_PI))} FROM range(0, 4000) q(k))"


_cp = frac("id * 0.6180339887498949e0")
overall_significance = f"""WITH a AS (SELECT label, greatest(least({_cp.replace('id', 'vec_id')}, {1 - 1e-15!r}), 1e-15) AS p FROM embeddings),
b AS (SELECT label, sum({isf('p')}) / sqrt(count(*)) AS z FROM a GROUP BY label), c AS (SELECT label, {upper_normal('z')} AS p FROM b),
d AS (SELECT s_suppkey, c.label, coalesce(p, 0.5) AS p FROM supplier LEFT JOIN c ON c.label = s_suppkey AND s_suppkey < 7), e AS (SELECT label, greatest(least(p, {1 - 1e-15!r}), 1e-15) AS p FROM d),
f AS (SELECT count(*) AS n, count(label) AS n_matched, sum({isf('p')}) / sqrt(count(*)) AS z FROM e)
SELECT n, n_matched, round(z, 6) AS z, round({upper_normal('z')}, 6) AS p_combined FROM f"""

# ---------------------------------------------------------------- frames, observed profiles, images
PIVOT, TOWARDS = (0.02, -0.01, 0.03), (200.0, 35.0)
_P0 = POINTS[: POINTS.index("p AS (SELECT p0.*")].rstrip().rstrip(",")
_x, _y, _z = (f"({c} - {num(v)})" for c, v in zip("xyz", PIVOT, strict=True))
_r = f"sqrt({_x} * {_x} + {_y} * {_y} + {_z} * {_z})"
spherical_frame = f"WITH {_P0} SELECT id, round({_r}, 9) AS r, round(acos(greatest(least({_z} / {_r}, 1), -1)), 9) AS theta, round(atan2({_y}, {_x}) - {TWO_PI} * floor(atan2({_y}, {_x}) / {TWO_PI}), 9) AS phi FROM p0"
turned_positions = f"WITH {_P0} SELECT id, " + ", ".join(f"round({v} + {num(c)}, 9) AS g{n}" for v, c, n in zip(rotation(_x, _y, _z), PIVOT, "xyz", strict=True)) + " FROM p0"
cluster_positions = f"""WITH a AS (SELECT s_suppkey AS source_id, {sky('s_suppkey')}, (s_acctbal + 1000) / 1e5 AS z FROM supplier), b AS (SELECT source_id, lon, lat, {distance('z')} AS d FROM a)
SELECT source_id, round(d * cos(radians(lat)) * cos(radians(lon)), 6) AS x, round(d * cos(radians(lat)) * sin(radians(lon)), 6) AS y, round(d * sin(radians(lat)), 6) AS z FROM b"""
_lt, _bt = num(TOWARDS[0]), num(np.deg2rad(TOWARDS[1]))
sky_offsets = f"""WITH a AS (SELECT c_custkey AS key, {sky('c_custkey')} FROM customer), b AS (SELECT key, cos(radians(lat)) * cos(radians(lon - {_lt})) AS x, cos(radians(lat)) * sin(radians(lon - {_lt})) AS y, sin(radians(lat)) AS z FROM a)
SELECT key, round(60 * degrees(atan2(y, x * cos({_bt}) + z * sin({_bt}))), 6) AS dx, round(60 * degrees(asin(greatest(least(z * cos({_bt}) - x * sin({_bt}), 1), -1))), 6) AS dy FROM b"""
_q = rotation("qx", "qy", "qz")
centroid_frame = f"""WITH {_P0}, s AS (SELECT sim AS label, count(*) AS n_members, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM p0 GROUP BY sim),
w AS (SELECT *, cx - {num(PIVOT[0])} AS qx, cy - {num(PIVOT[1])} AS qy, cz - {num(PIVOT[2])} AS qz FROM s), g AS (SELECT *, {_q[0]} AS gx, {_q[1]} AS gy, {_q[2]} AS gz FROM w)
SELECT label, n_members, round(cx, 6) AS cx, round(cy, 6) AS cy, round(cz, 6) AS cz, round(n_members / 20.0, 6) AS fraction_present, round(sqrt(qx * qx + qy * qy + qz * qz), 6) AS centroid_r, round({lon_of('gx', 'gy')}, 6) AS centroid_ell,
  round(degrees(asin(greatest(least(gz / sqrt(gx * gx + gy * gy + gz * gz), 1), -1))), 6) AS centroid_b FROM g"""
_obs = f"s AS (SELECT *, sin(radians(lat)) AS z0, radians(lon) AS phi0 FROM (SELECT s_suppkey AS source_id, {sky('s_suppkey')} FROM supplier))"
_radii = ", ".join(f"({i}, {cosr(r)})" for i, r in enumerate(RADII))
observed_profiles = f"""WITH {MAP}, {rings(N)}, {_obs}, j AS (SELECT s.source_id, {DISTANCE} AS d, m.value FROM s JOIN c ON {DISTANCE} >= {cosr(720.0)} JOIN m USING (pix)),
b AS (SELECT source_id, avg(value) AS background FROM j WHERE d < {cosr(480.0)} GROUP BY source_id), g AS (SELECT source_id, r_idx, cr FROM s, (VALUES {_radii}) t(r_idx, cr)),
e AS (SELECT g.source_id, r_idx, avg(value) AS signal FROM g LEFT JOIN j ON g.source_id = j.source_id AND d >= cr GROUP BY ALL)
SELECT source_id, r_idx, round(signal, 6) AS signal, round(background, 6) AS background FROM e LEFT JOIN b USING (source_id)"""
poorly_matched = f"WITH mx AS ({pval_matrix}) SELECT obs_id, round(min(pval), 9) AS p_best FROM mx GROUP BY obs_id HAVING min(pval) > 0.9"
mean_images = """WITH c AS (SELECT label AS sim, CAST(vec_id % 6 AS INTEGER) AS iu, CAST(vec_id % 5 AS INTEGER) AS iv, CASE WHEN CAST(embedding[1] AS DOUBLE) > 0.2 THEN NULL ELSE CAST(embedding[2] AS DOUBLE) END AS value FROM embeddings),
i AS (SELECT iu, iv, avg(value) AS value, count(DISTINCT sim) AS n_sims FROM c GROUP BY iu, iv)
SELECT iu, iv, round(value, 9) AS value, n_sims, round((SELECT quantile_cont(abs(value), 0.99) FROM i), 9) AS scale FROM i"""
association_maps = """SELECT vec_id AS id, 'label' AS name, '{"value":' || label || '}' AS value FROM embeddings
UNION ALL SELECT vec_id, 'log_mass', '{"value":' || (vec_id % 7) || '.0}' FROM embeddings WHERE vec_id % 2 = 0
UNION ALL SELECT vec_id, 'tag', CASE WHEN vec_id % 2 = 0 THEN '{"value":"x"}' ELSE '{}' END FROM embeddings"""
