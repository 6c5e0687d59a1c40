"""SQL that repeats whole fits over the encoded orders, draw by draw, from the keys of mixlake.functions.draws."""

from __future__ import annotations

from mixlake.functions import draws
from mixlake.functions.draws import gamma_sql, key_sql, unit_sql
from mixlake.plans.registry import CLUSTERS, model_sql, u_sql

#: All orders.
N = "(SELECT count(*) FROM enc)"
_DM = "dm AS (SELECT 0 AS f, k FROM ls UNION ALL SELECT 1, k FROM lp UNION ALL SELECT 2, range FROM range(5))"
_NAMES = "CASE f WHEN 0 THEN 'o_orderstatus' WHEN 1 THEN 'o_orderpriority' ELSE 'o_totalprice' END"


def block(t: int, size: str, last: bool) -> str:
    """The condition of the t-th of consecutive batches, the last one without an end."""
    return f"o_orderkey >= {t} * {size}" + ("" if last else f" AND o_orderkey < {t + 1} * {size}")


def chosen(seed: int, step: int, size: str) -> str:
    """The condition of a random batch."""
    return f"{u_sql(str(seed), repr('batch'), str(step), 'o_orderkey')} < CAST({size} AS DOUBLE) / {N}"


def third(parts: int) -> str:
    """The size of so many batches, rounded up."""
    return f"(({N} + {parts - 1}) // {parts})"


def _dirichlet(source: str) -> str:
    return f"SELECT p, f, c, k, ln(CASE WHEN f < 0 THEN q ELSE greatest(q, 1e-10) END) AS lp FROM (SELECT p, f, c, k, greatest(g, 1e-300) / sum(greatest(g, 1e-300)) OVER (PARTITION BY p, f, c) AS q FROM ({gamma_sql(source, 'p, f, c, k')}))"


def _shapes(seed: int, step: int, pi: str, theta: str, joins: tuple[str, str] = ("", "")) -> str:
    """Cells (p, f, c, k) with their counts, shapes and keys: f is -1 for the weights of clusters, which are its k."""
    return f"""SELECT p, -1 AS f, 0 AS c, cluster AS k, {pi}, {key_sql([seed, step, draws.WEIGHT], 'p', 'cluster')} AS h FROM par CROSS JOIN cl {joins[0]}
  UNION ALL SELECT p, f, cluster, k, {theta}, {key_sql([seed, step, draws.THETA], 'p', 'f', 'cluster', 'k')} FROM par CROSS JOIN cl CROSS JOIN dm {joins[1]}"""


def _grid_draw(s: int, seed: int, which: int, groups: str, grid: list[float], column: str) -> str:
    score = f"SELECT p, a, sum((a - 1) * s - k * lgamma(a) + lgamma(k * a)) AS v FROM (SELECT p, f, c, sum(lp) AS s, count(*) AS k FROM tr{s} WHERE {groups} GROUP BY p, f, c), (SELECT unnest({grid}) AS a) GROUP BY p, a"
    cum = f"SELECT p, a, sum(e) OVER (PARTITION BY p ORDER BY a) / sum(e) OVER (PARTITION BY p) AS cum FROM (SELECT p, a, exp(v - max(v) OVER (PARTITION BY p)) AS e FROM ({score}))"
    return f"(SELECT p, [{', '.join(f'CAST({a} AS DOUBLE)' for a in grid)}][1 + least(count(*) FILTER (cum <= {unit_sql(key_sql([seed, s, draws.HYPER, which], 'p'))}), {len(grid) - 1})] AS {column} FROM ({cum}) GROUP BY p)"


def _move(s: int, seed: int, particles: int, where: str, weigh: bool, grid: list[float] | None, blind: bool = False) -> str:
    """Named subqueries of move s: from ag, t, al, lw of number s to those of s + 1. blind: clusters are drawn by their weights alone."""
    joint = "w.lp" if blind else "w.lp + x.lp + y.lp + z.lp"
    resampled = f"CASE WHEN (SELECT 1 / sum(w * w) FROM wn{s}) < {particles} / 2.0 THEN least((SELECT count(*) FROM cw{s} WHERE cum <= u), {particles - 1}) ELSE p END" if weigh and particles > 1 else "p"
    log_w = "log_w + target - gamma - q" if weigh else "log_w"
    after = f"CASE WHEN (SELECT 1 / sum(w * w) FROM wn{s}) < {particles} / 2.0 THEN -ln({particles}) ELSE wt{s}.log_w END" if weigh and particles > 1 else f"wt{s}.log_w"
    alphas = f"SELECT p, alpha_pi, alpha_theta FROM {_grid_draw(s, seed, 0, 'f < 0', grid, 'alpha_pi')} JOIN {_grid_draw(s, seed, 1, 'f >= 0', grid, 'alpha_theta')} USING (p)" if grid else f"SELECT * FROM al{s}"
    return f""",
bt{s} AS MATERIALIZED (SELECT * FROM enc WHERE {where}),
jt{s} AS MATERIALIZED (SELECT o_orderkey, w.p, w.k AS c, {joint} AS v FROM bt{s}, t{s} w, t{s} x, t{s} y, t{s} z WHERE w.f = -1 AND x.p = w.p AND y.p = w.p AND z.p = w.p AND x.c = w.k AND y.c = w.k AND z.c = w.k AND x.f = 0 AND x.k = f0 AND y.f = 1 AND y.k = f1 AND z.f = 2 AND z.k = f2),
js{s} AS MATERIALIZED (SELECT *, top + ln(sum(exp(v - top)) OVER (PARTITION BY o_orderkey, p)) AS lse FROM (SELECT *, max(v) OVER (PARTITION BY o_orderkey, p) AS top FROM jt{s})),
jc{s} AS (SELECT *, sum(exp(v - lse)) OVER (PARTITION BY o_orderkey, p ORDER BY c) AS cum FROM js{s}),
ur{s} AS MATERIALIZED (SELECT o_orderkey, p, {unit_sql(key_sql([seed, s, draws.ROW], 'o_orderkey', 'p'))} AS u FROM bt{s}, par),
nw{s} AS MATERIALIZED (SELECT o_orderkey, p, least(count(*) FILTER (cum <= u), {CLUSTERS - 1}) AS cluster FROM jc{s} JOIN ur{s} USING (o_orderkey, p) GROUP BY ALL),
ar{s} AS MATERIALIZED (SELECT * FROM ag{s} WHERE o_orderkey NOT IN (SELECT o_orderkey FROM bt{s}) UNION ALL SELECT * FROM nw{s}),
np{s} AS (SELECT p, cluster, count(*) AS n FROM ar{s} GROUP BY ALL),
nt{s} AS (SELECT p, f, cluster, k, count(*) AS m FROM (SELECT p, ar{s}.cluster, unnest([0, 1, 2]) AS f, unnest([f0, f1, f2]) AS k FROM ar{s} JOIN enc USING (o_orderkey)) GROUP BY ALL),
g{s} AS MATERIALIZED ({_shapes(seed, s, 'coalesce(n, 0) AS n, alpha_pi + coalesce(n, 0) AS a', 'coalesce(m, 0), alpha_theta + coalesce(m, 0)', (f'JOIN al{s} USING (p) LEFT JOIN np{s} USING (p, cluster)', f'JOIN al{s} USING (p) LEFT JOIN nt{s} USING (p, f, cluster, k)'))}),
tr{s} AS MATERIALIZED ({_dirichlet(f'g{s}')}),
ah{s} AS MATERIALIZED ({alphas}),
sc{s} AS (SELECT p, f, c, sum((a - 1) * lp) - sum(lgamma(a)) + lgamma(sum(a)) AS q, sum((CASE WHEN f < 0 THEN alpha_pi ELSE alpha_theta END - 1 + n) * lp) - sum(lgamma(CASE WHEN f < 0 THEN alpha_pi ELSE alpha_theta END)) + lgamma(sum(CASE WHEN f < 0 THEN alpha_pi ELSE alpha_theta END)) AS target FROM g{s} JOIN tr{s} USING (p, f, c, k) JOIN ah{s} USING (p) GROUP BY p, f, c),
qr{s} AS (SELECT p, sum(v - lse) AS q FROM js{s} JOIN nw{s} USING (o_orderkey, p) WHERE c = cluster GROUP BY p),
wq{s} AS (SELECT sc{s}.p, any_value(qr{s}.q) + sum(sc{s}.q) AS q, sum(target) AS target FROM sc{s} JOIN qr{s} USING (p) GROUP BY sc{s}.p),
wt{s} AS MATERIALIZED (SELECT p, {log_w} AS log_w, target AS gamma FROM wq{s} JOIN lw{s} USING (p)),
wn{s} AS MATERIALIZED (SELECT p, exp(log_w - max(log_w) OVER ()) / sum(exp(log_w - top)) OVER () AS w FROM (SELECT *, max(log_w) OVER () AS top FROM wt{s})),
cw{s} AS (SELECT p, sum(w) OVER (ORDER BY p) AS cum FROM wn{s}),
up{s} AS MATERIALIZED (SELECT p, {resampled} AS ancestor FROM (SELECT p, {unit_sql(key_sql([seed, s + 1, draws.ANCESTOR], 'p'))} AS u FROM par)),
ag{s + 1} AS MATERIALIZED (SELECT o_orderkey, up{s}.p, cluster FROM up{s} JOIN ar{s} ON ar{s}.p = ancestor),
t{s + 1} AS MATERIALIZED (SELECT up{s}.p, f, c, k, lp FROM up{s} JOIN tr{s} ON tr{s}.p = ancestor),
al{s + 1} AS MATERIALIZED (SELECT up{s}.p, alpha_pi, alpha_theta FROM up{s} JOIN ah{s} ON ah{s}.p = ancestor),
lw{s + 1} AS MATERIALIZED (SELECT up{s}.p, {after} AS log_w, gamma FROM up{s} JOIN wt{s} ON wt{s}.p = ancestor)"""


def fit_sql(seed: int, particles: int, moves: list[tuple[str, bool]], grid: list[float] | None = None, blind_start: bool = False) -> str:
    """Named subqueries of a fit's moves, (condition of the batch, whether it is weighted), the first one blind if so told: after them fit_ag (o_orderkey, p, cluster), fit_t (p, f, c, k, lp) and fit_w (p, w)."""
    out = model_sql() + f""", par AS (SELECT range AS p FROM range({particles})), {_DM},
g AS MATERIALIZED ({_shapes(seed, -1, '0 AS n, 1.0::DOUBLE AS a', '0, 1.0::DOUBLE')}),
t0 AS MATERIALIZED ({_dirichlet('g')}),
al0 AS (SELECT p, 1.0::DOUBLE AS alpha_pi, 1.0::DOUBLE AS alpha_theta FROM par), lw0 AS (SELECT p, 0.0::DOUBLE AS log_w, 0.0::DOUBLE AS gamma FROM par),
ag0 AS (SELECT o_orderkey, 0::BIGINT AS p, 0::BIGINT AS cluster FROM enc WHERE false)"""
    for s, (where, weigh) in enumerate(moves):
        out += _move(s, seed, particles, where, weigh, grid, blind_start and s == 0)
    end = len(moves)
    return out + f""",
fit_ag AS (SELECT * FROM ag{end}), fit_t AS (SELECT * FROM t{end}),
fit_w AS (SELECT p, exp(log_w - max(log_w) OVER ()) / sum(exp(log_w - top)) OVER () AS w FROM (SELECT *, max(log_w) OVER () AS top FROM lw{end}))
"""


#: Weights, log pi and rows of each particle's clusters.
SUMMARY = "SELECT CAST(t.p AS INTEGER) AS particle, CAST(t.k AS INTEGER) AS cluster, round(w.w, 6) AS weight, round(t.lp, 6) AS log_pi, (SELECT count(*) FROM fit_ag a WHERE a.p = t.p AND a.cluster = t.k) AS n FROM fit_t t JOIN fit_w w ON w.p = t.p WHERE f < 0"
#: Cells by cluster, and again from the clusters that were written.
CELLS = f"SELECT CAST(p AS INTEGER) AS particle, {_NAMES} AS feature, CAST(cluster AS INTEGER) AS cluster, CAST(k AS INTEGER) AS category, count(*) AS n, count(*) AS n_assigned FROM (SELECT p, a.cluster, unnest([0, 1, 2]) AS f, unnest([f0, f1, f2]) AS k FROM fit_ag a JOIN enc USING (o_orderkey)) GROUP BY ALL"


def smc_moves(seed: int, parts: int, rejuvenation: int) -> list[tuple[str, bool]]:
    """The moves of smc() over so many batches."""
    out: list[tuple[str, bool]] = []
    for t in range(parts):
        out.append((block(t, third(parts), t == parts - 1), True))
        out += [(chosen(seed, len(out) + i, third(parts)), False) for i in range(rejuvenation)]
    return out


def mcmc_moves(seed: int, parts: int, steps: int) -> list[tuple[str, bool]]:
    """The moves of mcmc(): all orders, then random batches of one of so many parts, rounded down."""
    return [("true", False)] + [(chosen(seed, s + 1, f"({N} // {parts})"), False) for s in range(steps)]


def descent_sql(name: str, seed: int, conditions: list[str], rate: float, sign: bool = False) -> str:
    """Named subqueries of descent: l{name}{t} (loss) of the orders of each condition, before each step."""
    out = f"""keys{name} AS MATERIALIZED (SELECT -1 AS f, cluster AS c, 0 AS k, {key_sql([seed, 0, draws.LOGIT, 0], 'cluster', 0)} AS h FROM cl
  UNION ALL SELECT f, cluster, k, {key_sql([seed, 0, draws.LOGIT], 'f + 1', 'cluster', 'k')} FROM cl, dm),
x0{name} AS MATERIALIZED (SELECT f, c, k, 0.1 * sqrt(-2 * ln(u)) * cos(2 * pi() * w) AS x, 0.0::DOUBLE AS m, 0.0::DOUBLE AS v FROM (SELECT f, c, k, {unit_sql(draws.fold_sql('h', 0))} AS u, {unit_sql(draws.fold_sql('h', 1))} AS w FROM keys{name}))"""
    for t, where in enumerate(conditions):
        s = f"{t}{name}"
        out += f""",
lp{s} AS MATERIALIZED (SELECT f, c, k, x, m, v, x - top - ln(sum(exp(x - top)) OVER (PARTITION BY f, g)) AS lp FROM (SELECT *, CASE WHEN f < 0 THEN 0 ELSE c END AS g, max(x) OVER (PARTITION BY f, CASE WHEN f < 0 THEN 0 ELSE c END) AS top FROM x{s})),
db{s} AS MATERIALIZED (SELECT * FROM enc WHERE {where}),
dj{s} AS MATERIALIZED (SELECT o_orderkey, f0, f1, f2, c, val - top - ln(sum(exp(val - top)) OVER (PARTITION BY o_orderkey)) AS lr, top + ln(sum(exp(val - top)) OVER (PARTITION BY o_orderkey)) AS lse FROM (SELECT *, max(val) OVER (PARTITION BY o_orderkey) AS top FROM (SELECT o_orderkey, f0, f1, f2, w.c, w.lp + x.lp + y.lp + z.lp AS val FROM db{s}, lp{s} w, lp{s} x, lp{s} y, lp{s} z WHERE w.f = -1 AND x.c = w.c AND y.c = w.c AND z.c = w.c AND x.f = 0 AND x.k = f0 AND y.f = 1 AND y.k = f1 AND z.f = 2 AND z.k = f2))),
rs{s} AS (SELECT -1 AS f, c, 0 AS k, sum(exp(lr)) AS r FROM dj{s} GROUP BY c UNION ALL SELECT f, c, k, sum(exp(lr)) FROM (SELECT c, lr, unnest([0, 1, 2]) AS f, unnest([f0, f1, f2]) AS k FROM dj{s}) GROUP BY ALL),
gr{s} AS (SELECT f, c, k, x, m, v, CASE WHEN f < 0 THEN (SELECT count(*) FROM db{s}) ELSE sum(coalesce(r, 0)) OVER (PARTITION BY f, c) END * exp(lp) - coalesce(r, 0) AS g FROM lp{s} LEFT JOIN rs{s} USING (f, c, k)),
l{name}{t} AS (SELECT -sum(lse) AS loss FROM dj{s} WHERE c = 0)"""
        step = f"x - {rate} * sign(g)" if sign else f"x - {rate} * ((0.9 * m + 0.1 * g) / {1 - 0.9 ** (t + 1)!r}) / (sqrt((0.999 * v + 0.001 * g * g) / {1 - 0.999 ** (t + 1)!r}) + 1e-8)"
        out += f",\nx{t + 1}{name} AS MATERIALIZED (SELECT f, c, k, {step} AS x, 0.9 * m + 0.1 * g AS m, 0.999 * v + 0.001 * g * g AS v FROM gr{s})"
    return out


def losses(name: str, steps: int, lead: str = "") -> str:
    return " UNION ALL ".join(f"SELECT {lead}CAST({t} AS INTEGER) AS step, round(loss, 3) AS loss FROM l{name}{t}" for t in range(steps))


DESCENT = model_sql() + f", {_DM}, "
