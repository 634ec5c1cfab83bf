"""DuckDB SQL for the pedigree queries, written from the definitions and sharing nothing with the Spark plans."""

from __future__ import annotations

from ..functions.registry import REGISTRY

BASE = """
n0 AS (SELECT count(*) // 6 AS w0 FROM customer), w1 AS (SELECT w0 - (w0 % 2) AS w FROM n0),
b1 AS (SELECT CAST(c_custkey AS BIGINT) AS k, w, least(c_custkey // w, 5) AS g FROM customer, w1 WHERE c_custkey < 6 * w),
b2 AS (SELECT *, CASE WHEN k % 98 = 2 AND (k - 2) // w = g THEN k - 2 ELSE k END AS b FROM b1),
raw AS (SELECT k AS id, CAST(g AS INTEGER) AS generation, CAST(b % 2 AS INTEGER) AS sex,
  CASE WHEN g = 0 OR b % 23 = 1 THEN NULL ELSE (g - 1) * w + 2 * ((b * b * 31 + b * 7919) % (w // 2)) END AS m,
  CASE WHEN g = 0 OR b % 29 = 1 THEN NULL ELSE (g - 1) * w + 1 + 2 * ((CASE WHEN b % 5 = 0 THEN b * 104729 + b * b * 17 ELSE ((b * b * 31 + b * 7919) % (w // 2)) * 37 + g * 11 END) % (w // 2)) END AS f,
  CASE WHEN k % 98 = 0 AND (k + 2) // w = g THEN k + 2 WHEN k % 98 = 2 AND (k - 2) // w = g THEN k - 2 ELSE NULL END AS tw,
  CAST(1900 + 25 * g + (k % 7) AS INTEGER) AS birth_year FROM b2),
p AS MATERIALIZED (SELECT CAST(id AS BIGINT) AS id, generation, sex, CAST(m AS BIGINT) AS m, CAST(f AS BIGINT) AS f, CASE WHEN tw IN (SELECT id FROM raw) THEN CAST(tw AS BIGINT) END AS tw, birth_year FROM raw),
e AS MATERIALIZED (SELECT id AS child, m AS parent, 'm' AS side FROM p WHERE m IS NOT NULL UNION ALL SELECT id, f, 'f' FROM p WHERE f IS NOT NULL)"""
REACH = """,
r1 AS MATERIALIZED (SELECT child AS d, parent AS a, CAST(count(*) AS BIGINT) AS n FROM e GROUP BY ALL),
""" + ",\n".join(f"r{k} AS MATERIALIZED (SELECT r.d, e.parent AS a, CAST(sum(r.n) AS BIGINT) AS n FROM r{k - 1} r JOIN e ON r.a = e.child GROUP BY ALL)" for k in range(2, 6))
SHARES = """,
t AS MATERIALIZED (SELECT d, a, sum(x) AS t FROM (SELECT id AS d, id AS a, 1.0 AS x FROM p """ + " ".join(f"UNION ALL SELECT d, a, n * pow(0.5, {k}) FROM r{k}" for k in range(1, 6)) + ") GROUP BY ALL)"
SIBS = """,
s AS (SELECT * FROM p WHERE tw IS NULL),
fs AS MATERIALIZED (SELECT x.id AS lo, y.id AS hi FROM s x JOIN s y ON x.m = y.m AND x.f = y.f AND x.id < y.id),
mhs AS MATERIALIZED (SELECT x.id AS lo, y.id AS hi FROM s x JOIN s y ON x.m = y.m AND x.id < y.id EXCEPT SELECT * FROM fs),
phs AS MATERIALIZED (SELECT x.id AS lo, y.id AS hi FROM s x JOIN s y ON x.f = y.f AND x.id < y.id EXCEPT SELECT * FROM fs),
fsb AS (SELECT lo AS i, hi AS j FROM fs UNION ALL SELECT hi, lo FROM fs),
hs AS (SELECT * FROM mhs UNION SELECT * FROM phs),
hsb AS (SELECT lo AS i, hi AS j FROM hs UNION ALL SELECT hi, lo FROM hs),
po AS MATERIALIZED (SELECT DISTINCT least(child, parent) AS lo, greatest(child, parent) AS hi FROM e),
""" + ",\n".join(f"{c} AS MATERIALIZED (SELECT least(d, a) AS lo, greatest(d, a) AS hi FROM r{k})" for c, k in (("gp", 2), ("ggp", 3), ("gggp", 4), ("g3gp", 5)))


def _col(name: str, k: int, kind: str, less: list[str]) -> str:
    minus = "".join(f" EXCEPT SELECT lo, hi FROM {x}" for x in less)
    return f"{name} AS MATERIALIZED (SELECT DISTINCT least(r.d, b.j) AS lo, greatest(r.d, b.j) AS hi FROM r{k} r JOIN {kind} b ON r.a = b.i WHERE r.d <> b.j{minus})"


def _shared(name: str, a: int, b: int, distinct: bool) -> str:
    if not distinct:
        inner = f"SELECT x.d AS i, y.d AS j, CAST(sum(x.n * y.n) AS BIGINT) AS n FROM r{a} x JOIN r{b} y ON x.a = y.a AND x.d <> y.d GROUP BY ALL"
        return f"{name} AS MATERIALIZED (SELECT DISTINCT least(i, j) AS lo, greatest(i, j) AS hi, n FROM ({inner}))"
    inner = f"SELECT least(x.d, y.d) AS lo, greatest(x.d, y.d) AS hi FROM r{a} x JOIN r{b} y ON x.a = y.a AND x.d {'<' if a == b else '<>'} y.d"
    return f"{name} AS MATERIALIZED (SELECT lo, hi, CAST(count(*) AS BIGINT) AS n FROM ({inner}) GROUP BY ALL)"


def _codes(distinct: bool) -> str:
    u = ["fs", "mhs", "phs"]
    c2 = ["po", "gp", "ggp", "av", "gav", *u, "c1"]
    less = lambda names: "".join(f" EXCEPT SELECT lo, hi FROM {x}" for x in names)
    pick = lambda name, src, cond, names: f"{name} AS MATERIALIZED (SELECT DISTINCT lo, hi FROM {src} WHERE {cond}{less(names)})"
    parts = [
        _col("av", 1, "fsb", ["po"]), _col("hav", 1, "hsb", ["po", "gp"]), _col("gav", 2, "fsb", ["po", "gp", "av"]),
        "sg AS MATERIALIZED (SELECT x.d AS lo, y.d AS hi, count(*) AS n FROM r2 x JOIN r2 y ON x.a = y.a AND x.d < y.d GROUP BY ALL)",
        "cz AS MATERIALIZED (SELECT sg.* FROM sg JOIN p x ON x.id = lo JOIN p y ON y.id = hi WHERE NOT coalesce(x.m = y.m, false) AND NOT coalesce(x.f = y.f, false))",
        "c1 AS (SELECT lo, hi FROM cz WHERE n >= 2)", "h1c AS (SELECT lo, hi FROM cz WHERE n = 1)",
        _col("hgav", 2, "hsb", ["po", "gp", "ggp", "hav"]), _col("ggav", 3, "fsb", ["po", "gp", "ggp", "av", "gav"]),
        _col("hggav", 3, "hsb", ["po", "gp", "ggp", "gggp", "hav", "hgav"]), _col("g3av", 4, "fsb", ["po", "gp", "ggp", "gggp", "av", "gav", "ggav"]),
        _shared("s23", 2, 3, distinct), _shared("s24", 2, 4, distinct), _shared("s33", 3, 3, distinct),
        pick("c1c1r", "s23", "n >= 2", c2), pick("h1c1r", "s23", "n = 1", ["po", "gp", "ggp", "gggp", "hav", "hgav", *u, "c1", "h1c", "c1c1r"]),
        pick("c1c2r", "s24", "n >= 2", ["po", "gp", "ggp", "gggp", "av", "gav", "ggav", *u, "c1", "h1c", "c1c1r"]), pick("c2c", "s33", "n >= 2", ["sg"]),
    ]
    return ",\n" + ",\n".join(parts)


# Each category's table in the SQL above, in registry order; MZ, MO, FO and the lineal ones are read from their own sources.
TABLE = {"FS": "fs", "MHS": "mhs", "PHS": "phs", "Av": "av", "GAv": "gav", "HAv": "hav", "1C": "c1", "H1C": "h1c", "HGAv": "hgav", "GGAv": "ggav", "HGGAv": "hggav", "G3Av": "g3av", "1C1R": "c1c1r", "H1C1R": "h1c1r", "1C2R": "c1c2r", "2C": "c2c"}
SOURCE = {c: f"SELECT lo AS idx1, hi AS idx2 FROM {t}" for c, t in TABLE.items()} | {
    "MZ": "SELECT id AS idx1, tw AS idx2 FROM p WHERE tw > id", "MO": "SELECT id AS idx1, m AS idx2 FROM p WHERE m IS NOT NULL", "FO": "SELECT id AS idx1, f AS idx2 FROM p WHERE f IS NOT NULL",
    "GP": "SELECT d AS idx1, a AS idx2 FROM r2", "GGP": "SELECT d AS idx1, a AS idx2 FROM r3", "GGGP": "SELECT d AS idx1, a AS idx2 FROM r4", "G3GP": "SELECT d AS idx1, a AS idx2 FROM r5",
}
ALL = [r.code for r in REGISTRY]
DEGREE2 = ["MZ", "MO", "FO", "FS", "MHS", "PHS", "GP", "Av", "1C"]
PAIRS = f"WITH {BASE}{REACH}{SIBS}{_codes(False)}\n"
PAIRS_DISTINCT = f"WITH {BASE}{REACH}{SIBS}{_codes(True)}\n"


def union(codes: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS code, idx1, idx2 FROM ({SOURCE[c]})" for c in codes)


def counted(codes: list[str], pairs: str | None = None) -> str:
    return f", pp AS ({pairs or union(codes)}), cc AS (SELECT code, count(*) AS n FROM pp GROUP BY code) SELECT c.code, CAST(coalesce(n, 0) AS BIGINT) AS n FROM (SELECT unnest({ALL!r}) AS code) c LEFT JOIN cc USING (code)"


SAMPLE = "SELECT id, row_number() OVER (ORDER BY id DESC) - 1 AS c FROM p WHERE id % 3 <> 1"


def sampled(codes: list[str]) -> str:
    return f"SELECT u.code, least(x.c, y.c) AS idx1, greatest(x.c, y.c) AS idx2 FROM ({union(codes)}) u JOIN ({SAMPLE}) x ON u.idx1 = x.id JOIN ({SAMPLE}) y ON u.idx2 = y.id"


def kin(bound: float = 0.0, twins: bool = True) -> str:
    """Kinship by generation, unrolled; table k5."""
    out = ["k0 AS MATERIALIZED (SELECT id AS i, id AS j, CAST(0.5 AS DOUBLE) AS phi FROM p WHERE m IS NULL AND f IS NULL)"]
    for g in range(1, 6):
        k = f"k{g - 1}"
        out += [
            f"a{g} AS MATERIALIZED (SELECT e.child AS i, k.j, sum(k.phi) / 2 AS phi FROM e JOIN p ON p.id = e.child AND p.generation = {g} JOIN {k} k ON k.i = e.parent GROUP BY ALL HAVING sum(k.phi) / 2 > {bound})",
            f"o{g} AS MATERIALIZED (SELECT p.id AS i, p.tw, (1 + coalesce(k.phi, 0)) / 2 AS phi FROM p LEFT JOIN {k} k ON k.i = p.m AND k.j = p.f WHERE generation = {g} AND (p.m IS NOT NULL OR p.f IS NOT NULL))",
            f"z{g} AS (SELECT least(i, tw) AS j, greatest(i, tw) AS i, max_by(phi, o{g}.i) AS phi FROM o{g} WHERE tw IS NOT NULL AND {'true' if twins else 'false'} GROUP BY ALL)",
            f"q{g} AS MATERIALIZED (SELECT e.child AS i, a.i AS j, sum(a.phi) / 2 AS phi FROM a{g} a JOIN e ON e.parent = a.j JOIN p ON p.id = e.child AND p.generation = {g} WHERE a.i < e.child GROUP BY ALL HAVING sum(a.phi) / 2 > {bound})",
            f"n{g} AS MATERIALIZED (SELECT * FROM q{g} WHERE NOT EXISTS (SELECT 1 FROM z{g} z WHERE z.i = q{g}.i AND z.j = q{g}.j) UNION ALL SELECT i, j, phi FROM z{g})",
            f"k{g} AS MATERIALIZED (SELECT * FROM {k} UNION ALL SELECT * FROM a{g} UNION ALL SELECT j, i, phi FROM a{g} UNION ALL SELECT * FROM n{g} UNION ALL SELECT j, i, phi FROM n{g} UNION ALL SELECT i, i, phi FROM o{g})",
        ]
    # Names n0, b1 and so on of the base are not reused: levels begin at a1, o1, z1, q1, n1, k0.
    return ",\n" + ",\n".join(out)



F_CTE = kin(0.0, False) + ",\nfi AS MATERIALIZED (SELECT p.id, p.generation, coalesce(k.phi, 0.0) AS f FROM p LEFT JOIN k5 k ON k.i = p.m AND k.j = p.f)"
MEMBERS = "g AS (SELECT generation, count(*) AS n, count(*) FILTER (WHERE tw > id) AS tp FROM p GROUP BY 1)"
THETA = f"{MEMBERS}, th AS (SELECT x.generation, sum(k.phi) AS s FROM k5 k JOIN p x ON x.id = k.i JOIN p y ON y.id = k.j WHERE k.i < k.j AND x.generation = y.generation AND NOT coalesce(x.tw = y.id, false) GROUP BY 1), tg AS (SELECT g.generation, CASE WHEN n >= 2 AND n * (n - 1) / 2 - tp > 0 THEN coalesce(s, 0) / (n * (n - 1) / 2 - tp) END AS x FROM g LEFT JOIN th USING (generation))"
EQG = "eq AS MATERIALIZED (SELECT p.id, coalesce(x.v, 0) AS v FROM p LEFT JOIN (SELECT d, sum(t) - 1 AS v FROM t GROUP BY d) x ON x.d = p.id)"
RATE = "SELECT generation, round(CASE WHEN generation >= 1 AND before < 1 AND (x - before) / (1 - before) > 0 THEN 1 / (2 * (x - before) / (1 - before)) END, 6) AS ne, round(x, 9) AS {name} FROM (SELECT generation, x, {before} AS before FROM {src})"
SLOPE = "SELECT round(CASE WHEN sl < 0 THEN -1 / (2 * sl) END, 6) AS ne, round(sl, 9) AS slope, n_generations_used FROM (SELECT regr_slope(CASE WHEN x < 1 THEN ln(1 - x) END, CASE WHEN x < 1 THEN generation END) AS sl, CAST(count(CASE WHEN x < 1 THEN 1 END) AS INTEGER) AS n_generations_used FROM {src} WHERE generation >= 1)"
LAG = "lag(x) OVER (ORDER BY generation)"
HARMONIC = "count(*) FILTER (WHERE {x} > 0) / sum(1 / {x}) FILTER (WHERE {x} > 0)"
MEANF = "mf AS (SELECT generation, avg(f) AS x FROM fi GROUP BY 1)"
FAMILY = """ft AS MATERIALIZED (SELECT p.id, p.sex, p.generation, p.birth_year, coalesce(k_m, 0) AS k_m, coalesce(k_f, 0) AS k_f FROM p LEFT JOIN
  (SELECT parent, side, count(*) FILTER (WHERE c.sex = 1) AS k_m, count(*) FILTER (WHERE c.sex <> 1) AS k_f FROM e JOIN p c ON c.id = e.child GROUP BY 1, 2) k ON k.parent = p.id AND k.side = CASE WHEN p.sex = 1 THEN 'f' ELSE 'm' END WHERE p.sex IN (0, 1))"""


def terms(cohort: str) -> str:
    cols = ", ".join(f"var_samp(k_m) FILTER (WHERE sex = {s}) AS v_{n}m, var_samp(k_f) FILTER (WHERE sex = {s}) AS v_{n}f, covar_samp(k_m, k_f) FILTER (WHERE sex = {s}) AS cov_{n}, avg(k_m + k_f) FILTER (WHERE sex = {s}) AS kbar_{n}, count(*) FILTER (WHERE sex = {s}) AS n_{n}" for n, s in (("m", 1), ("f", 0)))
    return f"vt AS (SELECT {cohort}, {cols} FROM ft GROUP BY 1 HAVING count(*) FILTER (WHERE sex = 1) >= 2 AND count(*) FILTER (WHERE sex = 0) >= 2)"


VARIANCE = f"{FAMILY}, {terms('generation')}, vs AS (SELECT generation, CASE WHEN df > 0 THEN 1 / (2 * df) END AS ne, v_mm, v_mf, v_fm, v_ff, cov_m, cov_f FROM (SELECT *, ((v_mm + v_mf + 2 * cov_m) / kbar_m) / (4 * n_m * kbar_m) + ((v_fm + v_ff + 2 * cov_f) / kbar_f) / (4 * n_f * kbar_f) AS df FROM vt WHERE kbar_m > 0 AND kbar_f > 0))"
SEXES = "sr AS (SELECT generation, count(*) FILTER (WHERE sex = 1) AS m, count(*) FILTER (WHERE sex = 0) AS f FROM p GROUP BY 1)"
SEX_NE = "CASE WHEN m > 0 AND f > 0 THEN 4.0 * m * f / (m + f) END"
DELTA = f"{EQG}, di AS (SELECT fi.generation, eq.v, 1 - pow(1 - f, 1 / (eq.v - 1)) AS df FROM fi JOIN eq USING (id) WHERE eq.v > 1 AND f < 1), dg AS (SELECT generation, avg(df) AS df, avg(v) AS mean_eqg, count(*) AS n FROM di GROUP BY 1), ds AS (SELECT g.generation, CASE WHEN df > 0 THEN 1 / (2 * df) END AS ne, mean_eqg, coalesce(n, 0) AS n FROM (SELECT DISTINCT generation FROM p) g LEFT JOIN dg USING (generation))"
FOUNDERS = "fm AS MATERIALIZED (SELECT g.generation, x.id AS founder, coalesce(w, 0) / g.n AS mean FROM (SELECT generation, count(*) AS n FROM p GROUP BY 1) g CROSS JOIN (SELECT id FROM p WHERE generation = 0) x LEFT JOIN (SELECT p.generation, t.a, sum(t) AS w FROM t JOIN p ON p.id = t.d GROUP BY 1, 2) c ON c.generation = g.generation AND c.a = x.id)"
LONG = f"{FOUNDERS}, st AS (SELECT b.generation, max(abs(b.mean - a.mean)) AS delta FROM fm a JOIN fm b ON b.generation = a.generation + 1 AND a.founder = b.founder GROUP BY 1), sp AS (SELECT min(generation) FILTER (WHERE delta < 1e-6) AS stop, max(generation) AS last FROM st), lt AS (SELECT coalesce(stop, last) AS g, stop IS NOT NULL AS reached, (SELECT sum(mean * mean) FROM fm WHERE generation = coalesce(stop, last)) AS c2, (SELECT delta FROM st WHERE generation = coalesce(stop, last)) AS delta FROM sp)"
ACC = "ac AS MATERIALIZED (SELECT p.generation, x.a AS founder, sum((1 + fi.f) / 2) AS sums, count(*) AS n FROM (SELECT DISTINCT d, a FROM t) x JOIN p ON p.id = x.d JOIN p o ON o.id = x.a AND o.generation = 0 JOIN fi ON fi.id = x.d GROUP BY 1, 2)"
CT = f"{ACC}, cs AS (SELECT generation, avg(sums / n) AS x, count(*) AS nf FROM ac WHERE generation > 0 GROUP BY 1 UNION ALL SELECT 0, NULL, 0)"
AGES = "ag AS MATERIALIZED (SELECT e.side, c.birth_year - q.birth_year AS diff FROM e JOIN p c ON c.id = e.child JOIN p q ON q.id = e.parent)"
INTERVAL = f"{AGES}, gi AS (SELECT (tm + tf) / 2 AS t, tm, tf, n FROM (SELECT avg(diff) FILTER (WHERE side = 'f') AS tm, avg(diff) FILTER (WHERE side = 'm') AS tf, count(*) AS n FROM ag))"
WINDOW = "wn AS (SELECT min(birth_year) AS c_min, CAST(floor(max(birth_year) - (SELECT quantile_cont(diff, 0.95) FROM ag)) AS INTEGER) AS c_max, (SELECT quantile_cont(diff, 0.95) FROM ag) AS p95 FROM p)"


def hill(scale: bool) -> str:
    def vk(s: str) -> str:
        raw = f"(v_{s}m + v_{s}f + 2 * cov_{s})"
        return f"CASE WHEN kbar_{s} > 0 THEN 2 * (1 + (2 / kbar_{s}) * ({raw} / kbar_{s} - 1)) ELSE {raw} END" if scale else raw

    return f"{INTERVAL}, {WINDOW}, {FAMILY}, {terms('birth_year')}, h1 AS (SELECT vt.*, {vk('m')} AS vk_m, {vk('f')} AS vk_f, gi.t FROM vt, gi, wn WHERE birth_year BETWEEN c_min AND c_max), h2 AS (SELECT *, 4.0 * n_m * t / (vk_m + 2) AS ne_m, 4.0 * n_f * t / (vk_f + 2) AS ne_f FROM h1 WHERE vk_m + 2 > 0 AND vk_f + 2 > 0), hc AS (SELECT birth_year AS cohort, 4 * ne_m * ne_f / (ne_m + ne_f) AS ne, ne_m, ne_f, vk_m, vk_f, kbar_m, kbar_f, n_m, n_f FROM h2 WHERE ne_m + ne_f > 0)"


def _hill_cohorts(scale: bool) -> str:
    return f"WITH {BASE}, {hill(scale)} SELECT cohort, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("ne", "ne_m", "ne_f", "vk_m", "vk_f", "kbar_m", "kbar_f")) + ", CAST(n_m AS BIGINT) AS n1_m, CAST(n_f AS BIGINT) AS n1_f FROM hc"


def _sides() -> str:
    single = "(SELECT p.*, coalesce(d1.n, 0) AS d1, coalesce(d2.n, 0) AS d2, coalesce(d3.n, 0) AS d3, coalesce(d4.n, 0) AS d4 FROM p " + " ".join(f"LEFT JOIN (SELECT a, count(*) AS n FROM r{k} GROUP BY a) d{k} ON d{k}.a = p.id" for k in range(1, 5)) + ")"
    return f"""dd AS MATERIALIZED {single},
fam AS (SELECT count(*) AS k, sum(d1) AS s1, sum(d2) AS s2, sum(d3) AS s3, sum(d4) AS s4, sum(d1 * d1) AS q1 FROM dd WHERE tw IS NULL AND m IS NOT NULL AND f IS NOT NULL GROUP BY m, f),
sd AS (SELECT 'm' AS side, count(*) AS k, sum(d1) AS w1, sum(d2) AS w2, sum(d3) AS w3 FROM dd WHERE tw IS NULL AND m IS NOT NULL GROUP BY m UNION ALL SELECT 'f', count(*), sum(d1), sum(d2), sum(d3) FROM dd WHERE tw IS NULL AND f IS NOT NULL GROUP BY f),
x AS (SELECT (SELECT count(*) FROM p WHERE tw > id) AS mz, (SELECT count(m) FROM p) AS mo, (SELECT count(f) FROM p) AS fo, (SELECT sum(k * (k - 1) // 2) FROM fam) AS fs,
  (SELECT sum(k * (k - 1) // 2) FROM sd WHERE side = 'm') AS ms, (SELECT sum(k * (k - 1) // 2) FROM sd WHERE side = 'f') AS ps, (SELECT count(*) FROM r2) AS gp, (SELECT count(*) FROM r3) AS ggp, (SELECT count(*) FROM r4) AS gggp, (SELECT count(*) FROM r5) AS g3gp,
  (SELECT sum((k - 1) * s1) FROM fam) AS av, (SELECT sum((k - 1) * s2) FROM fam) AS gav, (SELECT sum((k - 1) * s3) FROM fam) AS ggav, (SELECT sum((k - 1) * s4) FROM fam) AS g3av, (SELECT sum((s1 * s1 - q1) // 2) FROM fam) AS c1,
  (SELECT sum(s1 * s2) FROM fam) AS s12, (SELECT sum(s1 * s3) FROM fam) AS s13, (SELECT sum(s2 * (s2 - 1) // 2) FROM fam) AS c2, (SELECT sum((k - 1) * w1) FROM sd) AS w1, (SELECT sum((k - 1) * w2) FROM sd) AS w2, (SELECT sum((k - 1) * w3) FROM sd) AS w3,
  (SELECT sum(d2 * (d2 - 1) // 2) FROM dd) AS e2, (SELECT sum(d2 * d3) FROM dd) AS e23),
y AS (SELECT *, w1 - 2 * av AS hav, w2 - 2 * gav AS hgav, w3 - 2 * ggav AS hggav, greatest(0, s12 - av - gav) AS c11, greatest(0, e2 - 4 * fs - 2 * (ms - fs) - 2 * (ps - fs) - 2 * c1) AS h1c FROM x),
v AS (SELECT [mz, mo, fo, fs, ms - fs, ps - fs, gp, av, ggp, hav, gav, c1, gggp, hgav, ggav, h1c, c11, g3gp, hggav, g3av, greatest(0, e23 - 2 * c11 - hav - hgav), greatest(0, s13 - gav - ggav), c2] AS l FROM y)"""


def _registry_sql() -> str:
    rows = ", ".join(f"('{r.code}', '{r.label}', {r.up}, {r.down}, {r.n_anc}, {'true' if r.scalar_exact else 'false'}, {'true' if r.distinct_diverges else 'false'})" for r in REGISTRY)
    return f"SELECT code, label, CAST(u AS INTEGER) AS up_meioses, CAST(d AS INTEGER) AS down_meioses, CAST(n AS INTEGER) AS n_anc, k AS kinship, CAST(round(-1 - log2(k)) AS INTEGER) AS degree, streaming_exact, bfs_diverges FROM (SELECT *, CASE WHEN n = 0 THEN 0.5 ELSE n * pow(0.5, u + d + 1) END AS k FROM (VALUES {rows}) t(code, label, u, d, n, streaming_exact, bfs_diverges))"


W = f"WITH {BASE}"
_HN, _VN, _SN = HARMONIC.format(x="ne"), HARMONIC.format(x="ne"), HARMONIC.format(x=SEX_NE)
ORACLES: dict[str, str] = {
    "registry": _registry_sql(),
    "ped_resolved": f"{W} SELECT id AS row, id, CAST(coalesce(m, -1) AS BIGINT) AS m, CAST(coalesce(f, -1) AS BIGINT) AS f, CAST(coalesce(tw, -1) AS BIGINT) AS tw, sex, generation, birth_year FROM p",
    "edges": f"{W} SELECT * FROM e",
    "depth": f"{W}{REACH} SELECT p.id, CAST(coalesce(d, 0) AS INTEGER) AS depth FROM p LEFT JOIN (SELECT d AS id, max(k) AS d FROM (" + " UNION ALL ".join(f"SELECT d, {k} AS k FROM r{k}" for k in range(1, 6)) + ") GROUP BY 1) x ON x.id = p.id",
    "n_ancestors": f"{W}{REACH}{SHARES} SELECT p.id, CAST(count(t.a) AS BIGINT) AS n_ancestors FROM p LEFT JOIN t ON t.d = p.id AND t.a <> p.id GROUP BY 1",
    "n_descendants": f"{W}{REACH} SELECT p.id, CAST(coalesce(n, 0) AS BIGINT) AS n_descendants FROM p LEFT JOIN (SELECT a, sum(n) AS n FROM (" + " UNION ALL ".join(f"SELECT a, n FROM r{k}" for k in range(1, 6)) + ") GROUP BY 1) x ON x.a = p.id",
    "eqg": f"{W}{REACH}{SHARES}, {EQG} SELECT id, round(v, 9) AS eqg FROM eq",
    **{f"pairs_{c.lower()}": f"{PAIRS}{SOURCE[c]}" for c in ALL},
    "sibling_pairs": f"{PAIRS}{union(['FS', 'MHS', 'PHS'])}",
    "extract_pairs": f"{PAIRS}{union(ALL)}",
    "count_pairs": PAIRS + counted(ALL),
    "count_pairs_deg2": PAIRS + counted(DEGREE2),
    "count_pairs_min_kinship": PAIRS + counted([c for c in ALL if c in ("MZ", "MO", "FO", "FS") or next(r.kinship for r in REGISTRY if r.code == c) >= 0.06]),
    "pairs_subsample": f"{PAIRS}{sampled(DEGREE2)}",
    "count_pairs_subsample": PAIRS + counted(DEGREE2, sampled(DEGREE2)),
    "count_pairs_full_scope": PAIRS + counted(DEGREE2),
    "count_pairs_scalar": f"{W}{REACH}, {_sides()} SELECT unnest({ALL!r}) AS code, CAST(unnest(l) AS BIGINT) AS n FROM v",
    "count_pairs_distinct": PAIRS_DISTINCT + counted(ALL),
    "inbreeding": f"{W}{F_CTE} SELECT id, round(f, 9) AS f FROM fi",
    "kinship_coo": f"{W}{kin()} SELECT i, j, round(phi, 9) AS phi FROM k5",
    "kinship_max_degree": f"{W}{kin(0.5**3 - 1e-9)} SELECT i, j, round(phi, 9) AS phi FROM k5",
    "theta_per_gen": f"{W}{kin()}, {THETA} SELECT generation, round(x, 9) AS theta FROM tg",
    "pair_kinship": f"{PAIRS[:-1]}{kin()} SELECT u.code, u.idx1, u.idx2, round(coalesce(phi, 0), 9) AS phi FROM ({union(DEGREE2)}) u LEFT JOIN k5 ON k5.i = u.idx1 AND k5.j = u.idx2",
    "pair_kinship_subsample": f"{PAIRS[:-1]}{kin()} SELECT u.code, least(x.c, y.c) AS idx1, greatest(x.c, y.c) AS idx2, round(coalesce(phi, 0), 9) AS phi FROM ({union(DEGREE2)}) u JOIN ({SAMPLE}) x ON u.idx1 = x.id JOIN ({SAMPLE}) y ON u.idx2 = y.id LEFT JOIN k5 ON k5.i = u.idx1 AND k5.j = u.idx2",
    "generation_interval": f"{W}, {INTERVAL} SELECT round(t, 9) AS t, round(tm, 9) AS t_m, round(tf, 9) AS t_f, CAST(n AS BIGINT) AS n_edges FROM gi",
    "cohort_window": f"{W}, {AGES}, {WINDOW} SELECT c_min, c_max, round(p95, 9) AS reproductive_age_p95 FROM wn",
    "age_table": f"{W}, {AGES} SELECT side, CAST(diff AS INTEGER) AS age, CAST(count(*) AS BIGINT) AS n FROM ag GROUP BY 1, 2",
    "family_table": f"{W}, {FAMILY} SELECT id AS row, sex, generation, birth_year, CAST(k_m AS BIGINT) AS k_m, CAST(k_f AS BIGINT) AS k_f FROM ft",
    "sigma2_terms": f"{W}, {FAMILY}, {terms('generation')} SELECT generation, " + ", ".join(f"round({c}, 9) AS {c}" for c in ("v_mm", "v_mf", "v_fm", "v_ff", "cov_m", "cov_f", "kbar_m", "kbar_f")) + ", CAST(n_m AS BIGINT) AS n_m, CAST(n_f AS BIGINT) AS n_f FROM vt",
    "ne_inbreeding": f"{W}{F_CTE}, {MEANF} " + RATE.format(name="mean_f", before=LAG, src="mf"),
    "ne_inbreeding_scalar": f"{W}{F_CTE}, {MEANF} " + SLOPE.format(src="mf"),
    "ne_coancestry": f"{W}{kin()}, {THETA} " + RATE.format(name="theta", before=LAG, src="tg"),
    "ne_coancestry_scalar": f"{W}{kin()}, {THETA} " + SLOPE.format(src="tg"),
    "ne_delta_f": f"{W}{REACH}{SHARES}{F_CTE}, {DELTA} SELECT generation, round(ne, 6) AS ne, round(mean_eqg, 9) AS mean_eqg, CAST(n AS BIGINT) AS n_used FROM ds",
    "ne_variance": f"{W}, {VARIANCE} SELECT g.generation, round(ne, 6) AS ne, " + ", ".join(f"round({c}, 9) AS {c}" for c in ("v_mm", "v_mf", "v_fm", "v_ff", "cov_m", "cov_f")) + " FROM (SELECT DISTINCT generation FROM p WHERE generation < 5) g LEFT JOIN vs USING (generation)",
    "ne_sex_ratio": f"{W}, {SEXES} SELECT generation, round({SEX_NE}, 6) AS ne, CAST(m AS BIGINT) AS n_male, CAST(f AS BIGINT) AS n_female FROM sr",
    "founder_means": f"{W}{REACH}{SHARES}, {FOUNDERS} SELECT generation, founder, round(mean, 9) AS mean FROM fm",
    "ne_ltc": f"{W}{REACH}{SHARES}, {LONG} SELECT round(CASE WHEN reached AND c2 > 0 THEN 1 / (2 * c2) END, 6) AS ne, reached AS asymptote_reached, CAST(g AS INTEGER) AS n_iterations, round(delta, 9) AS max_delta_final, round(c2, 9) AS sum_c_squared FROM lt",
    "ne_hill": _hill_cohorts(False),
    "ne_hill_scaled": _hill_cohorts(True),
    "ct_accumulators": f"{W}{REACH}{SHARES}{F_CTE}, {ACC} SELECT generation, founder, round(sums, 6) AS sums, CAST(n AS BIGINT) AS n FROM ac",
    "ne_caballero_toro": f"{W}{REACH}{SHARES}{F_CTE}, {CT} SELECT r.*, CAST(nf AS BIGINT) AS n_founders FROM (" + RATE.format(name="mean_self_coancestry", before=f"CASE WHEN generation = 1 THEN 0.5 ELSE {LAG} END", src="cs") + ") r JOIN cs USING (generation)",
    "ne_caballero_toro_scalar": f"{W}{REACH}{SHARES}{F_CTE}, {CT} " + SLOPE.format(src="cs"),
}
_scalars = {
    "ne_inbreeding": ORACLES["ne_inbreeding_scalar"], "ne_coancestry": ORACLES["ne_coancestry_scalar"],
    "ne_variance_family_size": f"{W}, {VARIANCE} SELECT round({_VN}, 6) AS ne FROM vs WHERE generation < 5", "ne_sex_ratio": f"{W}, {SEXES} SELECT round({_SN}, 6) AS ne FROM sr",
    "ne_individual_delta_f": f"{W}{REACH}{SHARES}{F_CTE}, {DELTA} SELECT round({_HN}, 6) AS ne FROM ds", "ne_long_term_contributions": ORACLES["ne_ltc"],
    "ne_hill_overlapping": f"{W}, {hill(False)} SELECT round({_HN}, 6) AS ne FROM hc", "ne_caballero_toro": ORACLES["ne_caballero_toro_scalar"],
}
ORACLES["ne_all"] = " UNION ALL ".join(f"SELECT '{k}' AS estimator, CAST(ne AS DOUBLE) AS ne FROM ({s})" for k, s in _scalars.items())
