"""One query for each operator, with SQL that says the same independently.

Doubles are rounded to six places on both sides, as sums differ in order.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import report
from .functions import draw_sql
from .lineage import cut, folder
from .model import Mdp, violations
from .operators import bellman, clusters, coloring, frontier, halo, solvers
from .operators.solvers import Run, SolverConfig
from .plans import autotune, cost, permutation, planners, schedulers
from .plans.planners import PlannerConfig
from .plans.schedulers import Scheduler
from .profiling import COUNTERS, SCANS, profile
from .sources import generators as gen
from .sources import tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = " ".join(sql.split())
        return f

    return add


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places, without negative zeros; counts as long."""
    kinds = {"double": lambda c: F.round(F.col(c), 6) + F.lit(0.0), "int": lambda c: F.col(c).cast("long")}
    return df.select(*[kinds[k](c).alias(c) if k in kinds else F.col(c) for c, k in df.dtypes])


# ---- generators -----------------------------------------------------------


def model_rows(m: Mdp) -> DataFrame:
    r = m.rewards.select(F.col("state").alias("src"), "r")
    return rounded(m.transitions.join(r, "src").select("src", "dst", "ord", "p", "r"))


def _gen_sql(n: int, entries: str, r: str) -> str:
    """``entries``: SELECT src, dst, p, k (order inside a row)."""
    return f"""WITH e AS ({entries}), q AS (SELECT range AS src, {r} AS r FROM range({n}))
    SELECT e.src, e.dst, row_number() OVER (PARTITION BY e.src ORDER BY k) - 1 AS ord, round(CAST(e.p AS DOUBLE), 6) AS p, round(CAST(q.r AS DOUBLE), 6) AS r FROM e JOIN q USING (src)"""


@query("gen_ring", _gen_sql(64, "SELECT i AS src, (i + k) % 64 AS dst, CASE k WHEN 0 THEN 0.3 ELSE 0.7 END AS p, k FROM (SELECT range AS i FROM range(64)) a CROSS JOIN (SELECT range AS k FROM range(2)) b", "1.0"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model_rows(gen.ring(spark, 64, 0.9, 0.3))


@query(
    "gen_grid",
    _gen_sql(
        16 * 24,
        """SELECT src, dst, CASE k WHEN 0 THEN 0.2 ELSE 0.8 / (count(*) OVER (PARTITION BY src) - 1) END AS p, k FROM (
        SELECT i AS src, CASE k WHEN 0 THEN i WHEN 1 THEN i - 24 WHEN 2 THEN i + 24 WHEN 3 THEN i - 1 ELSE i + 1 END AS dst, k FROM (SELECT range AS i FROM range(384)) a CROSS JOIN (SELECT range AS k FROM range(5)) b
        WHERE k = 0 OR (k = 1 AND i >= 24) OR (k = 2 AND i < 360) OR (k = 3 AND i % 24 > 0) OR (k = 4 AND i % 24 < 23))""",
        "1 + 0.5 * (23 - src % 24 + src // 24) / 38.0",
    ),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model_rows(gen.grid(spark, 16, 24, 0.9, gradient=0.5))


@query("gen_metastable", _gen_sql(32, "SELECT i AS src, j AS dst, CASE WHEN i // 16 = j // 16 THEN 0.95 / 16 ELSE 0.05 / 16 END AS p, CASE WHEN i // 16 = j // 16 THEN j ELSE 100 + j END AS k FROM (SELECT range AS i FROM range(32)) a CROSS JOIN (SELECT range AS j FROM range(32)) b", "CASE WHEN src < 16 THEN 1.0 ELSE 2.0 END"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model_rows(gen.metastable(spark, 33, 0.9))


@query("gen_star", _gen_sql(50, "SELECT 0 AS src, range AS dst, 1.0 / 49 AS p, range AS k FROM range(1, 50) UNION ALL SELECT range, 0, 0.8, 0 FROM range(1, 50) UNION ALL SELECT range, range, 0.2, 1 FROM range(1, 50)", "CASE WHEN src = 0 THEN 1.0 ELSE 0.5 END"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model_rows(gen.star(spark, 50, 0.9))


def _chain_sql(r: str, absorbing: bool = False) -> str:
    inner = "src BETWEEN 1 AND 98" if absorbing else "TRUE"
    ends = "UNION ALL SELECT 0, 0, 1.0, 0 UNION ALL SELECT 99, 99, 1.0, 0" if absorbing else ""
    return _gen_sql(100, f"""SELECT src, dst, p, k FROM (SELECT i AS src, i + k - 1 AS dst, CASE k WHEN 0 THEN 0.25 WHEN 2 THEN 0.25 ELSE 0.5 + CASE WHEN i = 0 THEN 0.25 ELSE 0 END + CASE WHEN i = 99 THEN 0.25 ELSE 0 END END AS p, k
        FROM (SELECT range AS i FROM range(100)) a CROSS JOIN (SELECT range AS k FROM range(3)) b) WHERE dst BETWEEN 0 AND 99 AND {inner} {ends}""", r)  # fmt: skip


for _name, _reward, _r in (("uniform", "uniform", "1.0"), ("linear", "linear", "(src + 1) / 100.0"), ("quadratic", "quadratic", "1 - 4 * power(src / 99.0 - 0.5, 2)"), ("absorbing", "uniform", "1.0")):
    query(f"gen_chain_{_name}", _chain_sql(_r, _name == "absorbing"))(lambda spark, sf_dir, reward=_reward, ends=_name: model_rows(gen.chain(spark, 100, 0.9, reward=reward, reflecting=ends != "absorbing")))


@query(
    "gen_random_sparse",
    _gen_sql(
        500,
        f"""SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS p, k FROM (SELECT i AS src, k, k * 500 // 8 + ({draw_sql('i', 'k', 42)}) % ((k + 1) * 500 // 8 - k * 500 // 8) AS dst, 0.1 + 0.9 * (({draw_sql('i', 'k + 8', 42)}) % 1000000) / 1000000.0 AS w
        FROM (SELECT range AS i FROM range(500)) a CROSS JOIN (SELECT range AS k FROM range(8)) b)""",
        f"(({draw_sql('range', '16', 42)}) % 1000000) / 1000000.0",
    ),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model_rows(gen.random_sparse(spark, 500, 8, 0.9))


@query("gen_multi_cluster", _gen_sql(50, "SELECT i AS src, j AS dst, CASE WHEN ci = cj THEN 0.9 / m ELSE 0.1 / (50 - m) END AS p, j AS k FROM (SELECT range AS i, CASE WHEN range < 26 THEN range // 13 ELSE 2 + (range - 26) // 12 END AS ci, CASE WHEN range < 26 THEN 13 ELSE 12 END AS m FROM range(50)) a CROSS JOIN (SELECT range AS j, CASE WHEN range < 26 THEN range // 13 ELSE 2 + (range - 26) // 12 END AS cj FROM range(50)) b", "CASE WHEN src < 26 THEN src // 13 ELSE 2 + (src - 26) // 12 END + 1"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model_rows(gen.multi_cluster(spark, 50, 4, 0.9))


_BROKEN = [(0, 0, 0.5), (0, 1, 0.5), (1, 2, 1.2), (2, 9, 1.0), (5, 0, 1.0)]


@query(
    "mdp_validate",
    """WITH t AS (SELECT * FROM (VALUES (0, 0, 0.5), (0, 1, 0.5), (1, 2, 1.2), (2, 9, 1.0), (5, 0, 1.0)) v(src, dst, p)), s AS (SELECT range AS state FROM range(4)),
    sums AS (SELECT s.state, coalesce(sum(t.p), 0) AS total FROM s LEFT JOIN t ON t.src = s.state GROUP BY s.state),
    f AS (SELECT 'beta outside (0, 1)' AS "check", NULL AS state, 1.0 AS value UNION ALL SELECT 'src is no state', src, p FROM t WHERE src NOT IN (SELECT state FROM s)
    UNION ALL SELECT 'dst is no state', dst, p FROM t WHERE dst NOT IN (SELECT state FROM s) UNION ALL SELECT 'p outside 0 to 1', src, p FROM t WHERE p < 0 OR p > 1 UNION ALL SELECT 'row sum', state, total FROM sums WHERE abs(total - 1) > 1e-9)
    SELECT "check", CAST(state AS BIGINT) AS state, round(CAST(value AS DOUBLE), 6) AS value FROM f""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.createDataFrame([(*e, i) for i, e in enumerate(_BROKEN)], "src long, dst long, p double, ord int")
    return rounded(violations(Mdp(t, spark.range(4).select(F.col("id").alias("state"), F.lit(1.0).alias("r")), 1.0)))


# ---- models from tables ---------------------------------------------------


def _model_sql(names: str, steps: str) -> str:
    """CTEs tt (src, dst, p), rr (state, r) from names (name, r) and steps (a, b)."""
    return f"""names AS ({names}), steps AS ({steps}), states AS (SELECT name, r, row_number() OVER (ORDER BY name) - 1 AS state FROM names),
    counts AS (SELECT a, b, count(*) AS c FROM steps WHERE b IS NOT NULL GROUP BY a, b),
    edges AS (SELECT s.state AS src, d.state AS dst, c FROM counts JOIN states s ON s.name = a JOIN states d ON d.name = b),
    tt AS (SELECT src, dst, CAST(c AS DOUBLE) / sum(c) OVER (PARTITION BY src) AS p FROM edges UNION ALL SELECT state, state, 1.0 FROM states WHERE state NOT IN (SELECT src FROM edges)),
    rr AS (SELECT state, r FROM states)"""


EVENTS_SQL = _model_sql("SELECT event_type AS name, avg(value) AS r FROM events GROUP BY event_type", "SELECT event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events")
_UE = "printf('%012d/%s', user_id, event_type)"
USERS_SQL = _model_sql(f"SELECT {_UE} AS name, avg(value) AS r FROM events GROUP BY 1", f"SELECT {_UE} AS a, lead({_UE}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events")
NATION_SQL = _model_sql("SELECT n_nationkey AS name, coalesce(avg(s_acctbal), 0) AS r FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey", "SELECT c_nationkey AS a, s_nationkey AS b FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey")
BRAND_SQL = _model_sql("SELECT p_brand AS name, avg(p_retailprice) AS r FROM part GROUP BY p_brand", "SELECT p_brand AS a, lead(p_brand) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS b FROM lineitem JOIN part ON l_partkey = p_partkey")


def _sweep_sql(name: str, before: str, alpha: float = 1.0, only: str = "TRUE") -> str:
    """A CTE: one synchronous sweep of the states that ``only`` names."""
    return f"""{name} AS (SELECT rr.state, CASE WHEN {only} THEN {1 - alpha} * max(o.v) + {alpha} * (max(rr.r) + 0.9 * coalesce(sum(tt.p * x.v), 0)) ELSE max(o.v) END AS v
    FROM rr JOIN {before} o ON o.state = rr.state LEFT JOIN tt ON tt.src = rr.state LEFT JOIN {before} x ON x.state = tt.dst GROUP BY rr.state)"""


ZEROS_SQL = "x0 AS (SELECT state, CAST(0 AS DOUBLE) AS v FROM rr)"
GIVEN_SQL = "x0 AS (SELECT state, CAST(state % 7 AS DOUBLE) AS v FROM rr)"


def _sweeps_sql(k: int, alpha: float = 1.0) -> str:
    return ", ".join([ZEROS_SQL, *[_sweep_sql(f"x{i + 1}", f"x{i}", alpha) for i in range(k)]])


def _values_sql(model: str, ctes: str, last: str) -> str:
    return f"WITH {model}, {ctes} SELECT state, round(v, 6) AS v FROM {last}"


#: (state, v, fv, residual) of x0.
RESIDUALS_SQL = f"{_sweep_sql('fx', 'x0')}, rs AS (SELECT x0.state, x0.v, fx.v AS fv, abs(fx.v - x0.v) AS residual FROM x0 JOIN fx USING (state))"


def kept(m: Mdp) -> Mdp:
    """The model as files: it is read by many sweeps or plans."""
    return Mdp(cut(m.transitions), cut(m.rewards), m.beta)


def given(m: Mdp) -> DataFrame:
    return m.rewards.select("state", (F.col("state") % 7).cast("double").alias("v"))


@query("mdp_profile", f"WITH {USERS_SQL}, d AS (SELECT rr.state, count(tt.dst) AS nnz FROM rr LEFT JOIN tt ON tt.src = rr.state GROUP BY rr.state) SELECT count(*) AS n, CAST(sum(nnz) AS BIGINT) AS nnz, max(nnz) AS max_row, min(nnz) AS min_row, CAST(0.9 AS DOUBLE) AS beta FROM d")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(tables.user_events_mdp(spark, sf_dir).profile())


for _name, _source, _sql in (("bellman_backup", tables.user_events_mdp, USERS_SQL), ("bellman_backup_nation", tables.nation_mdp, NATION_SQL), ("bellman_backup_brand", tables.brand_mdp, BRAND_SQL)):

    def _backup(spark: SparkSession, sf_dir: str, source: Callable = _source) -> DataFrame:
        m = source(spark, sf_dir)
        return rounded(bellman.backup(m, given(m)))

    query(_name, f"WITH {_sql}, {GIVEN_SQL}, {_sweep_sql('fx', 'x0')} SELECT state, round(v, 6) AS fv FROM fx")(_backup)


@query("residuals", f"WITH {USERS_SQL}, {GIVEN_SQL}, {RESIDUALS_SQL} SELECT state, v, round(fv, 6) AS fv, round(residual, 6) AS residual FROM rs")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = tables.user_events_mdp(spark, sf_dir)
    return rounded(bellman.residuals(m, given(m)))


@query("residual_inf", f"WITH {USERS_SQL}, {GIVEN_SQL}, {RESIDUALS_SQL} SELECT round(max(residual), 6) AS residual_inf FROM rs")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = tables.user_events_mdp(spark, sf_dir)
    return rounded(bellman.residual_inf(m, given(m)))


@query("residual_inf_strided", f"WITH {USERS_SQL}, {GIVEN_SQL}, {RESIDUALS_SQL} SELECT round(max(residual), 6) AS residual_inf FROM rs WHERE state % 3 = 0")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = tables.user_events_mdp(spark, sf_dir)
    return rounded(bellman.residual_inf(m, given(m), 3))


@query("bellman_error", f"WITH {EVENTS_SQL}, {_sweeps_sql(9)} SELECT round(max(abs(x9.v - x8.v)), 6) AS residual_inf FROM x8 JOIN x9 USING (state)")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = kept(tables.events_mdp(spark, sf_dir))
    return rounded(bellman.residual_inf(m, solvers.sweeps(m, m.zeros(), 8)))


# ---- solvers --------------------------------------------------------------

for _k in (1, 2, 4, 8):

    def _jacobi(spark: SparkSession, sf_dir: str, k: int = _k) -> DataFrame:
        m = kept(tables.events_mdp(spark, sf_dir))
        return rounded(solvers.sweeps(m, m.zeros(), k))

    query(f"jacobi_k{_k}", _values_sql(EVENTS_SQL, _sweeps_sql(_k), f"x{_k}"))(_jacobi)


@query("jacobi_damped", _values_sql(EVENTS_SQL, _sweeps_sql(4, 0.7), "x4"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = kept(tables.events_mdp(spark, sf_dir))
    return rounded(solvers.sweeps(m, m.zeros(), 4, 0.7))


@query("jacobi_budget", _values_sql(EVENTS_SQL, _sweeps_sql(5), "x5"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = tables.events_mdp(spark, sf_dir)
    return rounded(solvers.solve_many({"run": (m, SolverConfig(eps=0.0, max_sweeps=SolverConfig.sweeps_for(23, m.size())))}).select("state", "v"))


@query("residual_trace", f"WITH {EVENTS_SQL}, {_sweeps_sql(7)} " + " UNION ALL ".join(f"SELECT CAST({k} AS BIGINT) AS sweep, round(max(abs(a.v - b.v)), 6) AS residual FROM x{k} a JOIN x{k + 1} b USING (state)" for k in range(7)))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = tables.events_mdp(spark, sf_dir)
    runs = solvers.solve_many({"run": (m, SolverConfig(eps=0.0, max_sweeps=6))}, with_values=False)
    return rounded(runs.select(F.explode("trace").alias("t")).select("t.sweep", "t.residual"))


def _fixed_sql(model: str) -> str:
    return f"""WITH RECURSIVE {model}, it(k, state, v) AS (SELECT 0, state, CAST(0 AS DOUBLE) FROM rr UNION ALL
    SELECT it.k + 1, rr.state, max(rr.r) + 0.9 * sum(tt.p * it.v) FROM it JOIN tt ON tt.dst = it.state JOIN rr ON rr.state = tt.src WHERE it.k < 400 GROUP BY it.k, rr.state)
    SELECT state, round(v, 6) AS v FROM it WHERE k = 400"""


for _name, _config in {"jacobi_fixed_point": SolverConfig(eps=1e-11), "gauss_seidel_fixed_point": SolverConfig(mode="gauss_seidel", eps=1e-11), "async_block_fixed_point": SolverConfig(mode="async", eps=1e-11, threads=2, local_sweeps=4)}.items():
    query(_name, _fixed_sql(EVENTS_SQL))(lambda spark, sf_dir, c=_config: rounded(solvers.solve_many({"run": (tables.events_mdp(spark, sf_dir), c)}).select("state", "v")))


@query("plan_fixed_point", _fixed_sql(EVENTS_SQL))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = tables.events_mdp(spark, sf_dir)
    plan = planners.colored_plan(spark, m.size(), PlannerConfig(threads=2, blk=1, colors=2))
    return rounded(solvers.run_plan(m, plan.tasks, 2, 400))


for _name, _scheduler in {"shuffled": Scheduler("shuffled"), "topk": Scheduler("topk", K=2), "ca_topk": Scheduler("ca_topk", K=3, groups=2, block_size=1), "buckets": Scheduler("buckets")}.items():

    def _scheduled(spark: SparkSession, sf_dir: str, s: Scheduler = _scheduler) -> DataFrame:
        run = Run(tables.events_mdp(spark, sf_dir), SolverConfig(mode="async", eps=1e-11, threads=2, stale=1), s)
        return rounded(solvers.solve_many({"run": run}).select("state", "v"))

    query(f"async_{_name}_fixed_point", _fixed_sql(EVENTS_SQL))(_scheduled)


@query("plan_priority_fixed_point", _fixed_sql(EVENTS_SQL))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = kept(tables.events_mdp(spark, sf_dir))
    plan = planners.priority_plan(spark, m.size(), PlannerConfig(threads=2, blk=1, colors=2, K=2), cut(bellman.residuals(m, m.zeros())))
    return rounded(solvers.solve_plan(m, plan, SolverConfig(eps=1e-11)).values)


#: The first sweep whose residual is at most 0.001, and what a report says then.
_REPORT_SQL = _fixed_sql(EVENTS_SQL).replace("SELECT state, round(v, 6) AS v FROM it WHERE k = 400", """, rk AS (SELECT a.k, max(abs(b.v - a.v)) AS r, count(*) AS n FROM it a JOIN it b ON b.state = a.state AND b.k = a.k + 1 GROUP BY a.k)
    SELECT TRUE AS converged, CAST(k AS BIGINT) AS sweeps, k * n AS total_updates, round(r, 6) AS final_residual_inf FROM rk WHERE r <= 0.001 ORDER BY k LIMIT 1""")


@query("solver_report", _REPORT_SQL)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = solvers.solve_many({"run": (tables.events_mdp(spark, sf_dir), SolverConfig(eps=1e-3))}, with_values=False)
    return rounded(done.select("converged", "sweeps", "total_updates", "final_residual_inf"))


@query("solver_counters", f"WITH {EVENTS_SQL} SELECT state % 2 AS tid, count(*) * 6 AS updates_completed, CAST(8 AS BIGINT) AS scans FROM rr GROUP BY 1")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six epochs of a static plan of two threads, with a scan at the start, after each and at the end."""
    m = kept(tables.events_mdp(spark, sf_dir))
    done = solvers.solve_plan(m, planners.static_plan(spark, m.size(), PlannerConfig(threads=2, blk=1)), SolverConfig(eps=0.0, max_sweeps=6))
    return rounded(done.counters_frame("run").join(done.scans_frame("run"), "run_id").select("tid", "updates_completed", "scans"))


@query("nation_fixed_point", _fixed_sql(NATION_SQL))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(solvers.solve_many({"run": (tables.nation_mdp(spark, sf_dir), SolverConfig(eps=1e-11))}).select("state", "v"))


#: One coordinate after the other, for the five event types.
_IN_PLACE = ", ".join([ZEROS_SQL, *[_sweep_sql(f"x{i + 1}", f"x{i}", only=f"rr.state = {i}") for i in range(5)]])


@query("gauss_seidel_sweep", _values_sql(EVENTS_SQL, _IN_PLACE, "x5"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(solvers.solve_many({"run": (tables.events_mdp(spark, sf_dir), SolverConfig(mode="gauss_seidel", eps=0.0, max_sweeps=1))}).select("state", "v"))


@query("gauss_seidel_tables", _values_sql(EVENTS_SQL, _IN_PLACE, "x5"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = kept(tables.events_mdp(spark, sf_dir))
    return rounded(solvers.gauss_seidel_sweep(m, m.zeros(), m.size(), 2))


# ---- solvers over tables --------------------------------------------------

#: (k, state, pri, color): the rounds of the colouring, color -1 for none yet.
_COLORS_SQL = f"""nb AS (SELECT DISTINCT s, o FROM (SELECT src AS s, dst AS o FROM tt UNION ALL SELECT dst, src FROM tt) WHERE s != o),
    co(k, state, pri, color) AS (SELECT 0, state, {draw_sql('state', '0', 42)}, CAST(-1 AS BIGINT) FROM rr UNION ALL
    SELECT a.k + 1, a.state, a.pri, CASE WHEN a.color >= 0 THEN a.color WHEN coalesce(bool_or(b.color < 0 AND (b.pri > a.pri OR b.pri = a.pri AND b.state > a.state)), FALSE) THEN -1
    ELSE list_min(list_filter(range(64), lambda c: NOT list_contains(list(coalesce(b.color, -1)), c))) END
    FROM co a LEFT JOIN nb ON nb.s = a.state LEFT JOIN co b ON b.state = nb.o WHERE a.k < 40 GROUP BY a.k, a.state, a.pri, a.color), cs AS (SELECT state, color FROM co WHERE k = 40)"""


@query("graph_colors", f"WITH RECURSIVE {USERS_SQL}, {_COLORS_SQL} SELECT state, color FROM cs")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(coloring.colors(tables.user_events_mdp(spark, sf_dir)))


def _colored_sql(model: str) -> str:
    """Two sweeps by colours: a step updates one colour."""
    return f"""WITH RECURSIVE {model}, {_COLORS_SQL}, mc AS (SELECT max(color) + 1 AS c FROM cs),
    sw(t, state, v) AS (SELECT CAST(0 AS BIGINT), state, CAST(0 AS DOUBLE) FROM rr UNION ALL
    SELECT a.t + 1, a.state, CASE WHEN cs.color = a.t % mc.c THEN max(rr.r) + 0.9 * coalesce(sum(tt.p * x.v), 0) ELSE max(a.v) END
    FROM sw a JOIN cs ON cs.state = a.state JOIN rr ON rr.state = a.state CROSS JOIN mc LEFT JOIN tt ON tt.src = a.state LEFT JOIN sw x ON x.state = tt.dst WHERE a.t < 2 * mc.c GROUP BY a.t, a.state, cs.color, mc.c)
    SELECT state, round(v, 6) AS v FROM sw, mc WHERE t = 2 * mc.c"""


def _from_tables(m: Mdp, config: SolverConfig) -> DataFrame:
    return rounded(solvers.solve(kept(m), config, tier="frame").values)


@query("gauss_seidel_colored", _colored_sql(USERS_SQL))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _from_tables(tables.user_events_mdp(spark, sf_dir), SolverConfig(mode="colored", eps=0.0, max_sweeps=2, check_every=2))


def _owner_sql(x: str, blocks: int) -> str:
    """Contiguous blocks, the first ones a state larger."""
    size, extra = f"(sz.n // {blocks})", f"(sz.n % {blocks})"
    return f"CASE WHEN {x} < {extra} * ({size} + 1) THEN {x} // ({size} + 1) ELSE {extra} + ({x} - {extra} * ({size} + 1)) // greatest({size}, 1) END"


_SIZE_SQL = "sz AS (SELECT count(*) AS n FROM rr)"


def _halo_sql(model: str, blocks: int, rounds: int, local: int) -> str:
    """A step is one local sweep: against the step before inside a block, against the round before outside."""
    return f"""WITH RECURSIVE {model}, {_SIZE_SQL}, ow AS (SELECT state, {_owner_sql('state', blocks)} AS o FROM rr, sz), inn AS (SELECT tt.*, a.o = b.o AS own FROM tt JOIN ow a ON a.state = tt.src JOIN ow b ON b.state = tt.dst),
    hr(k, state, old, v) AS (SELECT 0, state, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE) FROM rr UNION ALL
    SELECT k + 1, state, CASE WHEN (k + 1) % {local} = 0 THEN nv ELSE old END, nv FROM (SELECT a.k, a.state, a.old, max(rr.r) + 0.9 * coalesce(sum(inn.p * CASE WHEN inn.own THEN x.v ELSE x.old END), 0) AS nv
    FROM hr a JOIN rr ON rr.state = a.state LEFT JOIN inn ON inn.src = a.state LEFT JOIN hr x ON x.state = inn.dst WHERE a.k < {rounds * local} GROUP BY a.k, a.state, a.old)) SELECT state, round(v, 6) AS v FROM hr WHERE k = {rounds * local}"""


for _name, _source, _sql in (("async_halo_users", tables.user_events_mdp, USERS_SQL), ("async_halo_nation", tables.nation_mdp, NATION_SQL)):
    query(_name, _halo_sql(_sql, 6, 3, 2))(lambda spark, sf_dir, source=_source: _from_tables(source(spark, sf_dir), SolverConfig(mode="async", threads=6, local_sweeps=2, eps=0.0, max_sweeps=3)))


@query("async_halo_sent", f"WITH {NATION_SQL}, {_SIZE_SQL} SELECT (SELECT count(DISTINCT ({_owner_sql('src', 6)}, dst)) FROM tt, sz WHERE {_owner_sql('src', 6)} != {_owner_sql('dst', 6)}) AS sent, n AS states FROM sz")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many values a round's messages carry, of how many states."""
    m = kept(tables.nation_mdp(spark, sf_dir))
    s = halo.Halo(m, bellman.PolicyEvaluation(m), m.zeros(), 6, 1, 1.0)
    found = s.look()
    s.end()
    return spark.createDataFrame([(s.sent, found.states)], "sent long, states long")


#: (k, state, v, d): a round takes up and passes on what is more than 5.
_PUSH = "CASE WHEN abs({x}.d) > 5 THEN {x}.d ELSE 0 END"
_FRONTIER_SQL = f"""fr(k, state, v, d) AS (SELECT 0, state, CAST(0 AS DOUBLE), r FROM rr UNION ALL
    SELECT a.k + 1, a.state, a.v + {_PUSH.format(x='a')}, a.d - {_PUSH.format(x='a')} + 0.9 * coalesce(sum(tt.p * {_PUSH.format(x='x')}), 0)
    FROM fr a LEFT JOIN tt ON tt.src = a.state LEFT JOIN fr x ON x.state = tt.dst WHERE a.k < 6 GROUP BY a.k, a.state, a.v, a.d)"""


def _pushes(spark: SparkSession, sf_dir: str) -> tuple[frontier.Frontier, solvers.Solution]:
    m = kept(tables.user_events_mdp(spark, sf_dir))
    s = frontier.Frontier(bellman.PolicyEvaluation(m), m.zeros(), 5.0, 1.0)
    return s, solvers.follow(s, SolverConfig(mode="frontier", eps=5.0, max_sweeps=6))


@query("frontier_values", f"WITH RECURSIVE {USERS_SQL}, {_FRONTIER_SQL} SELECT state, round(v, 6) AS v FROM fr WHERE k = 6")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_pushes(spark, sf_dir)[1].values)


@query("frontier_pushed", f"WITH RECURSIVE {USERS_SQL}, {_FRONTIER_SQL} SELECT CAST(k AS BIGINT) AS round, count(*) FILTER (abs(d) > 5) AS pushed FROM fr WHERE k < 6 GROUP BY k HAVING count(*) FILTER (abs(d) > 5) > 0")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many states each round updates."""
    return spark.createDataFrame(list(enumerate(_pushes(spark, sf_dir)[0].pushed)), "round long, pushed long")


#: Customers of a nation as a cluster: the more segments a nation has among them, the likelier they leave it.
_CLUSTER_SQL = """rr AS (SELECT c_custkey AS state, c_nationkey AS cluster, coalesce(c_acctbal, 0) AS r FROM customer WHERE c_nationkey IS NOT NULL),
    sh AS (SELECT c_nationkey AS cluster, 1 - count(DISTINCT c_mktsegment) / 20.0 AS intra FROM customer WHERE c_nationkey IS NOT NULL GROUP BY 1)"""


def _cluster_sql(sweeps: int) -> str:
    parts = ["x0 AS (SELECT state, cluster, r, CAST(0 AS DOUBLE) AS v FROM rr)"]
    for k in range(sweeps):
        parts.append(f"c{k} AS (SELECT cluster, sum(v) AS s, count(*) AS m FROM x{k} GROUP BY cluster), g{k} AS (SELECT cluster, 0.9 * (intra * s / m + (1 - intra) * coalesce(((SELECT sum(s) FROM c{k}) - s) / nullif((SELECT sum(m) FROM c{k}) - m, 0), 0)) AS g FROM c{k} JOIN sh USING (cluster))")
        parts.append(f"x{k + 1} AS (SELECT state, cluster, r, r + g AS v FROM x{k} JOIN g{k} USING (cluster))")
    return ", ".join(parts)


@query("clusters_customers", f"WITH {_CLUSTER_SQL}, {_cluster_sql(4)} SELECT state, round(CAST(v AS DOUBLE), 6) AS v FROM x4")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four sweeps of a dense model of all customers, whose matrix is never written."""
    rows = tables.read(spark, sf_dir, "customer")
    intra = 1 - F.count_distinct("c_mktsegment") / 20
    op = clusters.from_table(rows, F.col("c_custkey"), F.col("c_nationkey"), F.col("c_acctbal"), intra, 0.9)
    return rounded(solvers.iterate(op, op.zeros(), SolverConfig(eps=0.0, max_sweeps=4)).values)


@query("plan_static_t1", _values_sql(EVENTS_SQL, _IN_PLACE, "x5"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = tables.events_mdp(spark, sf_dir)
    plan = planners.static_plan(spark, m.size(), PlannerConfig(threads=1, blk=2))
    return rounded(solvers.run_plan(m, plan.tasks, 1, 1))


@query("plan_colored_sweep", _values_sql(EVENTS_SQL, f"{ZEROS_SQL}, {_sweep_sql('x1', 'x0', only='rr.state % 2 = 0')}, {_sweep_sql('x2', 'x1', only='rr.state % 2 = 1')}", "x2"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = kept(tables.events_mdp(spark, sf_dir))
    plan = planners.colored_plan(spark, m.size(), PlannerConfig(threads=2, blk=1, colors=2))
    return rounded(solvers.run_phases(m, m.zeros(), [plan.phase_states(i) for i in range(2)]))


_HOT2 = "(SELECT state FROM rs ORDER BY round(residual, 9) DESC, state LIMIT 2)"


@query("plan_priority_sweep", _values_sql(EVENTS_SQL, f"{ZEROS_SQL}, {RESIDUALS_SQL}, {_sweep_sql('x1', 'x0', only=f'rr.state IN {_HOT2} AND rr.state % 2 = 0')}, {_sweep_sql('x2', 'x1', only=f'rr.state IN {_HOT2} AND rr.state % 2 = 1')}, {_sweep_sql('x3', 'x2', only='rr.state % 2 = 0')}, {_sweep_sql('x4', 'x3', only='rr.state % 2 = 1')}", "x4"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = kept(tables.events_mdp(spark, sf_dir))
    plan = planners.priority_plan(spark, m.size(), PlannerConfig(threads=2, blk=1, colors=2, K=2), cut(bellman.residuals(m, m.zeros())))
    phases = sorted(r["phase"] for r in plan.phases.collect())  # at most two a color
    return rounded(solvers.run_phases(m, m.zeros(), [plan.phase_states(p) for p in phases]))


# ---- schedulers -----------------------------------------------------------

_RS = f"WITH {USERS_SQL}, {GIVEN_SQL}, {RESIDUALS_SQL}"
_N = "(SELECT count(*) FROM rr)"
_HOT = "hot AS (SELECT state, residual FROM rs ORDER BY round(residual, 9) DESC, state LIMIT 25)"
_BUCKET = "CASE WHEN residual <= 1.0 THEN 0 ELSE CAST(least(greatest(floor(log2(round(residual / 1.0, 9))), 0), 7) AS BIGINT) END"


def _scored(spark: SparkSession, sf_dir: str) -> tuple[Mdp, int, DataFrame]:
    m = kept(tables.user_events_mdp(spark, sf_dir))
    return m, m.size(), cut(bellman.residuals(m, given(m)))


@query("sched_static", f"WITH {USERS_SQL}, o AS (SELECT state, ntile(4) OVER (ORDER BY state) - 1 AS tid FROM rr) SELECT tid, row_number() OVER (PARTITION BY tid ORDER BY state) - 1 AS pos, state FROM o")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = tables.user_events_mdp(spark, sf_dir)
    return rounded(schedulers.static_blocks(m.rewards, m.size(), 4))


#: Threads' blocks of two sizes; a permutation gives each state its place.
_SHUFFLED_SQL = f"""o AS (SELECT state, ntile(4) OVER (ORDER BY state) - 1 AS tid FROM rr), i AS (SELECT *, state - min(state) OVER (PARTITION BY tid) AS y, count(*) OVER (PARTITION BY tid) AS b FROM o),
    z AS (SELECT DISTINCT b FROM i), sd AS ({permutation.sides_sql('z')})"""


@query("sched_shuffled", f"WITH {USERS_SQL}, {_SHUFFLED_SQL} SELECT tid, {permutation.permuted_sql('y', 'tid * 1009 + 3', 42)} AS pos, state FROM i JOIN sd USING (b)")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = tables.user_events_mdp(spark, sf_dir)
    return rounded(schedulers.shuffled_blocks(m.rewards, m.size(), 4, epoch=3))


@query("sched_topk_gs", f"{_RS}, {_HOT} SELECT row_number() OVER (ORDER BY round(residual, 9) DESC, state) - 1 AS pos, state FROM hot")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, n, rs = _scored(spark, sf_dir)
    return rounded(schedulers.topk(rs, n, 4, 25))


@query("sched_ca_topk_gs", f"{_RS}, {_HOT}, g AS (SELECT state, (state // 16) % 8 AS grp, row_number() OVER (PARTITION BY (state // 16) % 8 ORDER BY round(residual, 9) DESC, state) AS turn FROM hot) SELECT row_number() OVER (ORDER BY turn, grp) - 1 AS pos, grp, state FROM g")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, n, rs = _scored(spark, sf_dir)
    return rounded(schedulers.conflict_aware_topk(rs, n, 4, 25, 8, 16))


@query("sched_residual_buckets", f"{_RS}, b AS (SELECT state, {_BUCKET} AS bucket FROM rs) SELECT row_number() OVER (ORDER BY bucket DESC, state) - 1 AS pos, bucket, state FROM b")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(schedulers.residual_buckets(_scored(spark, sf_dir)[2], 1.0, 8))


@query("residual_bucket_hist", f"{_RS}, b AS (SELECT {_BUCKET} AS bucket, count(*) AS states FROM rs GROUP BY 1) SELECT bucket, states, CAST(sum(states) OVER (ORDER BY bucket DESC) AS BIGINT) AS running FROM b")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(schedulers.bucket_histogram(_scored(spark, sf_dir)[2], 1.0, 8))


@query("topk_then_coverage", f"{_RS}, {_HOT}, o AS (SELECT state, ntile(4) OVER (ORDER BY state) - 1 AS tid FROM rr) SELECT CAST(0 AS BIGINT) AS pass, CAST(NULL AS BIGINT) AS tid, row_number() OVER (ORDER BY round(residual, 9) DESC, state) - 1 AS pos, state FROM hot UNION ALL SELECT 1, tid, row_number() OVER (PARTITION BY tid ORDER BY state) - 1, state FROM o")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, n, rs = _scored(spark, sf_dir)
    return rounded(schedulers.topk_then_coverage(rs, n, 4, 25))


# ---- plans ----------------------------------------------------------------

_BLOCKS = f"bl AS (SELECT range AS b, range * 64 AS lo, least((range + 1) * 64, {_N}) AS hi FROM range((SELECT (count(*) + 63) // 64 FROM rr)))"
_TASK = "'BLOCK' AS kind, lo AS \"begin\", hi AS \"end\", round(CAST(w AS DOUBLE), 6) AS weight, b AS conflict_key"
_SCORES = "sc AS (SELECT bl.b, lo, hi, coalesce(sum(residual), 0) AS score FROM bl LEFT JOIN rs ON rs.state // 64 = bl.b GROUP BY bl.b, lo, hi)"
_HOT_BLOCKS = "hb AS (SELECT * FROM (SELECT *, coalesce(sum(hi - lo) OVER (ORDER BY round(score, 9) DESC, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS covered FROM sc) WHERE covered < 150)"
_PLAN = PlannerConfig(threads=4, blk=64, colors=3, K=150)
_STATIC_TASKS = "SELECT CAST(0 AS BIGINT) AS phase, b % 4 AS tid, b // 4 AS seq, b, lo, hi, hi - lo AS w FROM bl"
_COLORED_TASKS = "SELECT b % 3 AS phase, (b // 3) % 4 AS tid, (b // 3) // 4 AS seq, b, lo, hi, hi - lo AS w FROM bl"


@query("plan_static", f"WITH {USERS_SQL}, {_BLOCKS}, p AS ({_STATIC_TASKS}) SELECT phase, tid, seq, {_TASK} FROM p")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(planners.static_plan(spark, tables.user_events_mdp(spark, sf_dir).size(), _PLAN).tasks)


@query("plan_colored", f"WITH {USERS_SQL}, {_BLOCKS}, p AS ({_COLORED_TASKS}) SELECT phase, tid, seq, {_TASK} FROM p")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(planners.colored_plan(spark, tables.user_events_mdp(spark, sf_dir).size(), _PLAN).tasks)


@query("block_scores", f"{_RS}, {_BLOCKS}, {_SCORES} SELECT b, lo AS \"begin\", hi AS \"end\", round(score, 6) AS score FROM sc")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, n, rs = _scored(spark, sf_dir)
    return rounded(planners.block_scores(spark, n, 64, rs))


@query("hot_blocks", f"{_RS}, {_BLOCKS}, {_SCORES}, {_HOT_BLOCKS} SELECT b, lo AS \"begin\", hi AS \"end\", round(score, 6) AS score, CAST(covered AS BIGINT) AS covered FROM hb")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, n, rs = _scored(spark, sf_dir)
    return rounded(planners.hot_blocks(planners.block_scores(spark, n, 64, rs), 150))


@query(
    "plan_priority",
    f"""{_RS}, {_BLOCKS}, {_SCORES}, {_HOT_BLOCKS}, q AS (SELECT 0 AS part, b % 3 AS color, row_number() OVER (PARTITION BY b % 3 ORDER BY round(score, 9) DESC, b) - 1 AS rk, b, lo, hi, score AS w FROM hb UNION ALL SELECT 1, b % 3, b // 3, b, lo, hi, hi - lo FROM sc),
    p AS (SELECT dense_rank() OVER (ORDER BY part, color) - 1 AS phase, rk % 4 AS tid, rk // 4 AS seq, b, lo, hi, w FROM q) SELECT phase, tid, seq, {_TASK} FROM p""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, n, rs = _scored(spark, sf_dir)
    return rounded(planners.priority_plan(spark, n, _PLAN, rs).tasks)


@query("plan_metrics", f"WITH {USERS_SQL}, {_BLOCKS}, p AS ({_COLORED_TASKS}), t AS (SELECT phase, tid, sum(hi - lo) AS u, sum(w) AS w FROM p GROUP BY phase, tid), m AS (SELECT phase, sum(u) AS tu, max(u) AS mu, max(w) AS mw FROM t GROUP BY phase) SELECT range AS phase, CAST(coalesce(tu, 0) AS BIGINT) AS total_updates, CAST(coalesce(mu, 0) AS BIGINT) AS max_thread_updates, CAST(coalesce(mw, 0) AS DOUBLE) AS max_thread_weight FROM range(3) LEFT JOIN m ON phase = range")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(planners.phase_metrics(planners.colored_plan(spark, tables.user_events_mdp(spark, sf_dir).size(), _PLAN)))


@query("plan_summary", f"WITH {USERS_SQL} SELECT 'colored n=' || count(*) || ' T=4 blk=64 colors=3 K=150 phases=3 updates=' || count(*) AS summary, CAST(3 AS BIGINT) AS phases, count(*) AS total_updates FROM rr")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(planners.summary(planners.colored_plan(spark, tables.user_events_mdp(spark, sf_dir).size(), _PLAN)))


_NNZ = "nz AS (SELECT src // 64 AS b, count(*) AS nnz FROM tt GROUP BY 1)"


@query("task_weights", f"WITH {USERS_SQL}, {_BLOCKS}, {_NNZ}, p AS (SELECT phase, tid, seq, b, lo, hi, coalesce(nnz, 0) AS w FROM ({_STATIC_TASKS}) LEFT JOIN nz USING (b)) SELECT phase, tid, seq, {_TASK} FROM p")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = tables.user_events_mdp(spark, sf_dir)
    return rounded(cost.weighted(planners.static_plan(spark, m.size(), _PLAN), m.degrees()).tasks)


@query(
    "plan_cost",
    f"""WITH {USERS_SQL}, {_BLOCKS}, {_NNZ}, p AS (SELECT phase, tid, coalesce(nnz, 0) AS w, hi - lo AS size FROM ({_COLORED_TASKS}) LEFT JOIN nz USING (b)), t AS (SELECT phase, tid, sum(CASE WHEN w > 0 THEN w ELSE size END) AS c FROM p GROUP BY phase, tid), f AS (SELECT max(c) AS c, sum(c) AS s FROM t GROUP BY phase)
    SELECT CAST(sum(c) AS DOUBLE) AS compute_cost, CAST(300 AS DOUBLE) AS phase_cost, CAST(1500 AS DOUBLE) AS barrier_cost, CAST(sum(c) + 1800 AS DOUBLE) AS total_cost, CAST(sum(s) AS DOUBLE) AS work FROM f""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = tables.user_events_mdp(spark, sf_dir)
    plan = cost.weighted(planners.colored_plan(spark, m.size(), PlannerConfig(threads=4, blk=64, colors=3, barrier_between_colors=True)), m.degrees())
    return rounded(cost.estimate(plan.tasks, plan.phases))


@query(
    "plan_cost_ranges",
    f"""WITH {USERS_SQL}, {_SIZE_SQL}, d AS (SELECT rr.state, count(tt.dst) AS nnz FROM rr LEFT JOIN tt ON tt.src = rr.state GROUP BY rr.state),
    t AS (SELECT k, k % 3 AS phase, k % 4 AS tid, 13 * k AS lo, least(24 * k + 5, n) AS hi FROM (SELECT range AS k FROM range(40)), sz WHERE 13 * k < n),
    w AS (SELECT t.k, phase, tid, hi - lo AS size, coalesce(sum(nnz), 0) AS w FROM t LEFT JOIN d ON d.state >= lo AND d.state < hi GROUP BY ALL), c AS (SELECT phase, tid, sum(CASE WHEN w > 0 THEN w ELSE size END) AS c FROM w GROUP BY phase, tid), f AS (SELECT max(c) AS c, sum(c) AS s FROM c GROUP BY phase)
    SELECT CAST(sum(c) AS DOUBLE) AS compute_cost, CAST(sum(s) AS DOUBLE) AS work FROM f""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping ranges that no block size divides."""
    m = kept(tables.user_events_mdp(spark, sf_dir))
    n, k = m.size(), F.col("id")
    size = F.least(24 * k + 5, F.lit(n))
    tasks = spark.range(40).where(13 * k < n).select((k % 3).cast("int").alias("phase"), (k % 4).cast("int").alias("tid"), k.cast("int").alias("seq"), F.lit("BLOCK").alias("kind"), (13 * k).alias("begin"), size.alias("end"), F.lit(0.0).alias("weight"), k.alias("conflict_key"))
    found = cost.estimate(cost.weighted_ranges(tasks, m.degrees(), n), spark.range(3).select(F.lit(False).alias("barrier_after")))
    return rounded(found.select("compute_cost", "work"))


# ---- autotune -------------------------------------------------------------

_TUNE = autotune.AutotuneConfig(threads=2, blks=(32, 64), color_multipliers=(1, 2), hot_fractions=(0.05, 0.2), pilot_sweeps=5)
_CANDIDATES = ", ".join(f"({i}, '{p}', {blk}, {colors}, {p == 'priority'}, {f})" for i, (p, blk, colors, f) in enumerate((p, blk, m * 2, f) for blk in (32, 64) for p, m, f in [("static", 0, 0), ("colored", 1, 0), ("colored", 2, 0), ("priority", 1, 0.05), ("priority", 2, 0.05), ("priority", 1, 0.2), ("priority", 2, 0.2)]))
_CS = f"cs AS (SELECT CAST(cid AS BIGINT) AS cid, planner, CAST(blk AS BIGINT) AS blk, CAST(colors AS BIGINT) AS colors, CASE WHEN hot THEN least(greatest(CAST(floor({_N} * f) AS BIGINT), 2 * blk), {_N}) ELSE 0 END AS k FROM (VALUES {_CANDIDATES}) v(cid, planner, blk, colors, hot, f))"


@query("autotune_candidates", f"WITH {USERS_SQL}, {_CS} SELECT cid AS candidate_id, planner, blk, colors, CAST(k AS BIGINT) AS \"K\", CAST(2 AS BIGINT) AS threads FROM cs")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(autotune.candidates(spark, tables.user_events_mdp(spark, sf_dir).size(), _TUNE))


_RANKED = f"""{_RS}, {_CS}, bs AS (SELECT cid, planner, colors, k, b, least(blk, {_N} - b * blk) AS size, blk FROM cs CROSS JOIN (SELECT range AS b FROM range(10000)) WHERE b * blk < {_N}),
    nz AS (SELECT cid, src // blk AS b, count(*) AS nnz FROM cs CROSS JOIN tt GROUP BY 1, 2), sc AS (SELECT cid, state // blk AS b, sum(residual) AS score FROM cs CROSS JOIN rs GROUP BY 1, 2),
    w AS (SELECT bs.*, CASE WHEN coalesce(nnz, 0) > 0 THEN nnz ELSE size END AS c, coalesce(score, 0) AS score FROM bs LEFT JOIN nz USING (cid, b) LEFT JOIN sc USING (cid, b)),
    h AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY cid ORDER BY round(score, 9) DESC, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS covered FROM w WHERE planner = 'priority'),
    t AS (SELECT cid, 0 AS part, 0 AS color, b, b % 2 AS tid, c FROM w WHERE planner = 'static' UNION ALL SELECT cid, 1, b % colors, b, (b // colors) % 2, c FROM w WHERE planner <> 'static'
    UNION ALL SELECT cid, 0, b % colors, b, (row_number() OVER (PARTITION BY cid, b % colors ORDER BY round(score, 9) DESC, b) - 1) % 2, c FROM h WHERE covered < k),
    s AS (SELECT cid, part, color, tid, sum(c) AS c FROM t GROUP BY ALL), f AS (SELECT cid, part, color, max(c) AS c FROM s GROUP BY ALL),
    g AS (SELECT cid, sum(c) AS c, count(*) AS phases FROM f GROUP BY cid),
    rk AS (SELECT cs.cid, planner, blk, colors, CAST(k AS BIGINT) AS k, round(CAST(g.c + 100 * CASE WHEN planner = 'colored' THEN colors ELSE phases END AS DOUBLE), 6) AS est_cost FROM cs JOIN g USING (cid))"""


@query("autotune_ranking", f"{_RANKED} SELECT cid AS candidate_id, planner, blk, colors, k AS \"K\", CAST(2 AS BIGINT) AS threads, est_cost FROM rk")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, n, rs = _scored(spark, sf_dir)
    return rounded(autotune.ranking(m, n, rs, _TUNE))


#: Five epochs of the three cheapest plans: step by step, the phase's states of all three.
_PILOTED = _RANKED.replace("WITH ", "WITH RECURSIVE ", 1) + """, top AS MATERIALIZED (SELECT * FROM rk ORDER BY round(est_cost, 6), cid LIMIT 3),
    ph AS MATERIALIZED (SELECT cid, blk, b, dense_rank() OVER (PARTITION BY cid ORDER BY part, color) - 1 AS phase FROM t JOIN top USING (cid)), np AS MATERIALIZED (SELECT cid, any_value(blk) AS blk, max(phase) + 1 AS phases FROM ph GROUP BY cid),
    e AS MATERIALIZED (SELECT src, dst, p, 0.0 AS own, r FROM tt JOIN rr ON rr.state = src UNION ALL SELECT state, state, 0.0, 1.0, r FROM rr),
    it(step, cid, state, v) AS (SELECT 0, cid, state, CAST(0 AS DOUBLE) FROM top CROSS JOIN rr UNION ALL
    SELECT it.step + 1, it.cid, e.src, CASE WHEN max(ph.b) IS NOT NULL THEN max(e.r) + 0.9 * sum(e.p * it.v) ELSE sum(e.own * it.v) END FROM it JOIN np ON np.cid = it.cid JOIN e ON e.dst = it.state
    LEFT JOIN ph ON ph.cid = it.cid AND ph.phase = it.step % np.phases AND ph.b = e.src // np.blk WHERE it.step < 5 * np.phases GROUP BY it.step, it.cid, e.src),
    fin AS (SELECT it.* FROM it JOIN np ON np.cid = it.cid AND it.step = 5 * np.phases), ba AS (SELECT cid, e.src, max(e.r) + 0.9 * sum(e.p * fin.v) - sum(e.own * fin.v) AS d FROM fin JOIN e ON e.dst = fin.state GROUP BY cid, e.src),
    res AS (SELECT cid, max(abs(d)) AS final FROM ba GROUP BY cid),
    pil AS (SELECT cid AS candidate_id, planner, blk, colors, k AS "K", est_cost, round((SELECT max(abs(r)) FROM rr), 6) AS initial_residual, round(final, 6) AS final_residual, round((SELECT max(abs(r)) FROM rr) / final, 6) AS rdrop FROM top JOIN res USING (cid))"""
_PILOT_COLUMNS = ["candidate_id", "planner", "blk", "colors", "K", "est_cost", "initial_residual", "final_residual", "rdrop"]


@query("autotune_pilots", f"{_PILOTED} SELECT * FROM pil")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, n, rs = _scored(spark, sf_dir)
    return rounded(autotune.pilots(m, n, rs, _TUNE).select(*_PILOT_COLUMNS))


@query("autotune_best", f"{_PILOTED} SELECT * FROM pil ORDER BY rdrop DESC, candidate_id LIMIT 1")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, n, rs = _scored(spark, sf_dir)
    return rounded(autotune.best(autotune.pilots(m, n, rs, _TUNE)).select(*_PILOT_COLUMNS))


@query("autotune_plan", f"{_PILOTED}, best AS (SELECT candidate_id FROM pil ORDER BY rdrop DESC, candidate_id LIMIT 1) SELECT phase, ph.b AS conflict_key, ph.b * blk AS \"begin\" FROM ph JOIN best ON cid = candidate_id")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, n, rs = _scored(spark, sf_dir)
    return rounded(autotune.tune(m, n, rs, _TUNE).plan.tasks.select("phase", "conflict_key", "begin"))


# ---- profiling and reports ------------------------------------------------


def _values(rows: list[tuple], columns: str) -> str:
    text = lambda x: "NULL" if x is None else f"'{x}'" if isinstance(x, str) else f"CAST({x} AS DOUBLE)" if isinstance(x, float) else str(x)
    return f"(VALUES {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}) v({columns})"


_COUNTS = [("a", 0, 100, 5000), ("a", 1, 50, 1000), ("b", 0, 0, 0), ("c", 0, 7, 21)]
_SCAN_ROWS = [("a", 4, 1000), ("b", 0, 0)]


@query(
    "profiling",
    f"""WITH u AS (SELECT run_id, sum(n) AS n, sum(ns) AS ns FROM {_values(_COUNTS, 'run_id, tid, n, ns')} GROUP BY run_id), s AS (SELECT run_id, sum(n) AS sn, sum(ns) AS sns FROM {_values(_SCAN_ROWS, 'run_id, n, ns')} GROUP BY run_id),
    q AS (SELECT u.run_id, CAST(n AS BIGINT) AS updates, CASE WHEN n > 0 THEN ns / CAST(n AS DOUBLE) ELSE 0 END AS a, CASE WHEN sn > 0 THEN sns / CAST(sn AS DOUBLE) ELSE 0 END AS b FROM u LEFT JOIN s USING (run_id))
    SELECT run_id, updates, round(a, 6) AS avg_update_cost_ns, round(CAST(b AS DOUBLE), 6) AS avg_residual_scan_ns, printf('updates=%d update_ns=%.1f scan_ns=%.1f', updates, a, CAST(b AS DOUBLE)) AS summary FROM q""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(profile(spark.createDataFrame(_COUNTS, COUNTERS), spark.createDataFrame(_SCAN_ROWS, SCANS)))


@query("profiling_run", f"WITH {EVENTS_SQL}, {_SIZE_SQL} SELECT run_id, CAST(n * per AS BIGINT) AS updates, TRUE AS measured FROM sz, (VALUES ('async', 40), ('jacobi', 5), ('plan', 5)) r(run_id, per)")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counters of three real runs of five rounds; times are measured, and here only known to be there."""
    m = kept(tables.events_mdp(spark, sf_dir))
    plan = planners.static_plan(spark, m.size(), PlannerConfig(threads=2, blk=1))
    c = SolverConfig(eps=0.0, max_sweeps=5, threads=2, local_sweeps=8)
    runs = solvers.solve_many({"jacobi": Run(m, c), "async": Run(m, replace(c, mode="async")), "plan": Run(m, c, plan=plan.tasks)}, with_values=False)
    done = cut(runs.select("run_id", "counters", "scans", "scan_ns"))
    counters = done.select("run_id", F.explode("counters").alias("c")).select("run_id", "c.tid", F.col("c.updates").alias("updates_completed"), F.col("c.ns").alias("time_in_update_ns"))
    found = profile(counters, done.select("run_id", "scans", "scan_ns"))
    measured = (F.col("avg_update_cost_ns") > 0) & (F.col("avg_residual_scan_ns") > 0) & F.col("summary").startswith("updates=")
    return found.select("run_id", "updates", measured.alias("measured"))


def _ranked_sql(name: str, model: str) -> str:
    return f"SELECT '{name}' AS mdp, total_updates FROM ({_REPORT_SQL.replace(EVENTS_SQL, model)})"


@query("rep_run_ranking", f"WITH a AS ({_ranked_sql('events', EVENTS_SQL)} UNION ALL {_ranked_sql('nation', NATION_SQL)}) SELECT mdp, 'Jacobi' AS solver, 'Jacobi' AS label, total_updates, CAST(1 AS BIGINT) AS rank FROM a")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Real runs over the tables' models, written as records, read again and ranked."""
    models = {"events": kept(tables.events_mdp(spark, sf_dir)), "nation": kept(tables.nation_mdp(spark, sf_dir))}
    runs = solvers.solve_many({k: Run(m, SolverConfig(eps=1e-3)) for k, m in models.items()}, with_values=False)
    sizes = spark.createDataFrame([(k, m.size()) for k, m in models.items()], "run_id string, n long")
    records = runs.join(sizes, "run_id").select(F.col("run_id").alias("mdp"), F.lit("Jacobi").alias("solver"), "n", F.lit(0.9).alias("beta"), F.lit(1).alias("threads"), F.col("converged").cast("string").alias("converged"), F.col("wall_time_sec").alias("wall_sec"), "total_updates", "updates_per_sec", F.col("final_residual_inf").alias("final_residual"))
    path = f"{folder(spark)}/runs-{uuid.uuid4().hex[:12]}"
    report.write_csv(records, path)
    best = report.best_by(report.read_csv(spark, path, report.SUMMARY), "total_updates", False)
    return rounded(best.withColumn("label", report.solver_label(F.col("solver"))))


#: Defects of the users' model: some rows too heavy, some that lead nowhere, a state without a reward.
@query(
    "mdp_validate_users",
    f"""WITH {USERS_SQL}, n AS (SELECT max(state) AS last FROM rr), s AS (SELECT state FROM rr WHERE state != 17),
    t AS (SELECT src, CASE WHEN src % 50 = 4 THEN dst + 1000000000 ELSE dst END AS dst, CASE WHEN src % 50 = 3 THEN p * 1.5 ELSE p END AS p FROM tt),
    sums AS (SELECT s.state, coalesce(sum(t.p), 0) AS total FROM s LEFT JOIN t ON t.src = s.state GROUP BY s.state),
    f AS (SELECT 'states not 0 to n - 1' AS "check", NULL AS state, (SELECT count(*) FROM s) AS value UNION ALL SELECT 'src is no state', src, p FROM t WHERE src NOT IN (SELECT state FROM s)
    UNION ALL SELECT 'dst is no state', dst, p FROM t WHERE dst NOT IN (SELECT state FROM s) UNION ALL SELECT 'p outside 0 to 1', src, p FROM t WHERE p < 0 OR p > 1 UNION ALL SELECT 'row sum', state, total FROM sums WHERE abs(total - 1) > 1e-9)
    SELECT "check", CAST(state AS BIGINT) AS state, round(CAST(value AS DOUBLE), 6) AS value FROM f""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = kept(tables.user_events_mdp(spark, sf_dir))
    src = F.col("src") % 50
    t = m.transitions.withColumn("dst", F.when(src == 4, F.col("dst") + 1_000_000_000).otherwise(F.col("dst"))).withColumn("p", F.when(src == 3, F.col("p") * 1.5).otherwise(F.col("p")))
    return rounded(violations(Mdp(t, m.rewards.where("state != 17"), m.beta)))


#: Invented records in the summary's shape.
_RECORDS = [
    ("Alpha", "Jacobi", 1000, 0.9, 1, "True", 0.5, 40000, 80000.0, 1e-7), ("Alpha", "GaussSeidel", 1000, 0.9, 1, "true", 0.4, 20000, 50000.0, 2e-7), ("Alpha", "Plan_Static", 1000, 0.9, 1, "TRUE", 0.6, 30000, 50000.0, 3e-7),
    ("Alpha", "Plan_Static", 1000, 0.9, 2, "True", 0.35, 31500, 90000.0, 4e-7), ("Alpha", "Plan_Static", 1000, 0.9, 4, "True", 0.2, 32000, 160000.0, 5e-7), ("Alpha", "Async_TopKGS_x", 1000, 0.9, 4, "False", 3.0, 90000, 30000.0, 0.01),
    ("Beta_pb0.200", "Jacobi", 2500000, 0.99, 1, "False", 9.0, 5000000, 555555.5, 0.5), ("Beta_pb0.050", "Jacobi", 2500000, 0.99, 1, "True", 7.0, 4000000, 571428.5, 1e-6), ("Grid_b0.950", "Jacobi", 900, 0.95, 1, "True", 0.1, 9000, 90000.0, 1e-6),
    ("Grid_b0.990", "Jacobi", 900, 0.99, 1, "True", 0.7, 63000, 90000.0, 1e-6), ("Gamma", "Jacobi", 50000, 0.9, 1, "True", 4.0, 500000, 125000.0, 1e-6), ("Gamma", "Async_CATopKGS", 50000, 0.9, 4, "true", 2.5, 400000, 160000.0, 1e-6), ("Gamma", "Mystery", 999, 0.9, 4, "true", 1.5, 400, 266.5, 1e-6),
]
_COLUMNS = "mdp, solver, n, beta, threads, converged, wall_sec, total_updates, updates_per_sec, final_residual"
_REC = f"WITH rec AS (SELECT * FROM {_values(_RECORDS, _COLUMNS)})"
_PICK = "rec WHERE lower(converged) = 'true' AND NOT regexp_matches(mdp, '_p?b\\d')"
_PLACE_SQL = "CASE WHEN starts_with(solver, 'Jacobi') THEN 0 WHEN starts_with(solver, 'GaussSeidel') THEN 1 WHEN starts_with(solver, 'Plan_Static') THEN 2 WHEN starts_with(solver, 'Async_TopKGS') THEN 7 WHEN starts_with(solver, 'Async_CATopKGS') THEN 8 ELSE 99 END"
_LABEL_SQL = "CASE solver WHEN 'GaussSeidel' THEN 'Gauss-Seidel' WHEN 'Plan_Static' THEN 'Plan (Static)' WHEN 'Async_TopKGS_x' THEN 'Async (TopK-GS)' WHEN 'Async_CATopKGS' THEN 'Async (CA-TopK)' ELSE solver END"


def records(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_RECORDS, report.SUMMARY)


@query("rep_converged", f"{_REC} SELECT mdp, solver, CAST(n AS BIGINT) AS n FROM rec WHERE lower(converged) = 'true'")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.converged(records(spark)).select("mdp", "solver", "n")


@query(
    "rep_labels",
    f"""{_REC} SELECT DISTINCT solver, {_LABEL_SQL} AS label, CAST({_PLACE_SQL} AS BIGINT) AS place,
    CASE WHEN n >= 1000000 THEN regexp_replace(printf('%.1f', n / 1e6), '\\.0$', '') || 'M' WHEN n >= 1000 THEN regexp_replace(printf('%.1f', n / 1e3), '\\.0$', '') || 'K' ELSE CAST(n AS VARCHAR) END AS size FROM rec""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(report.labels(records(spark)))


for _name, _col, _largest in (("rep_solver_ranking", "wall_sec", False), ("rep_throughput", "updates_per_sec", True)):
    _way = "DESC" if _largest else "ASC"
    query(_name, f"{_REC}, b AS (SELECT *, row_number() OVER (PARTITION BY mdp, solver ORDER BY {_col} {_way}, threads, n) AS i FROM {_PICK}) SELECT mdp, solver, {_col}, row_number() OVER (PARTITION BY mdp ORDER BY {_col} {_way}, solver) AS rank FROM b WHERE i = 1")(lambda spark, sf_dir, c=_col, up=_largest: rounded(report.best_by(records(spark), c, up)))


@query("rep_thread_scaling", f"{_REC} SELECT a.mdp, a.solver, CAST(a.n AS BIGINT) AS n, CAST(a.threads AS BIGINT) AS threads, round(a.updates_per_sec / o.updates_per_sec, 6) AS speedup, round(a.updates_per_sec / 1e6, 6) AS mups FROM rec a JOIN rec o ON a.mdp = o.mdp AND a.solver = o.solver AND a.n = o.n AND o.threads = 1")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(report.thread_scaling(records(spark)))


@query("rep_size_scaling", f"{_REC}, j AS (SELECT n, min(wall_sec) AS w FROM rec WHERE solver = 'Jacobi' GROUP BY n ORDER BY n LIMIT 1) SELECT solver, CAST(rec.n AS BIGINT) AS n, wall_sec, round(w * rec.n / j.n, 6) AS linear_sec FROM rec CROSS JOIN j")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(report.size_scaling(records(spark)))


@query("rep_beta", f"{_REC} SELECT CAST(regexp_extract(mdp, '^Grid_b(\\d+\\.\\d+)', 1) AS DOUBLE) AS beta_of, solver, wall_sec FROM rec WHERE regexp_matches(mdp, '^Grid_b\\d+\\.\\d+')")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(report.beta_sensitivity(records(spark)))


@query("rep_difficulty", f"{_REC}, d AS (SELECT mdp, CAST(regexp_extract(mdp, '_pb(\\d+\\.\\d+)', 1) AS DOUBLE) AS p_bridge, solver, final_residual, converged FROM rec WHERE regexp_matches(mdp, '_pb\\d+\\.\\d+')) SELECT mdp, p_bridge, solver, round(final_residual, 6) AS final_residual, converged, mdp = max(mdp) OVER () AS hardest FROM d")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(report.difficulty(records(spark)))


@query("rep_heatmap", f"{_REC} SELECT mdp, " + ", ".join(f"round(log10(greatest(min(wall_sec) FILTER (solver = '{s}'), 1e-6)), 6) AS \"{s}\"" for s in ("Plan_Static", "GaussSeidel", "Mystery", "Jacobi", "Async_CATopKGS")) + " FROM rec WHERE mdp IN ('Alpha', 'Gamma') AND lower(converged) = 'true' GROUP BY mdp")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(report.heatmap(records(spark)))


@query("rep_csv", f"{_REC} SELECT mdp, solver, CAST(n AS BIGINT) AS n, CAST(beta AS DOUBLE) AS beta, CAST(threads AS BIGINT) AS threads, lower(converged) = 'true' AS converged, CAST(wall_sec AS DOUBLE) AS wall_sec, CAST(total_updates AS BIGINT) AS total_updates, CAST(updates_per_sec AS DOUBLE) AS updates_per_sec, round(CAST(final_residual AS DOUBLE), 6) AS final_residual FROM rec")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records through CSV files in the shared folder."""
    path = f"{folder(spark)}/records-{uuid.uuid4().hex[:12]}"
    report.write_csv(records(spark), path)
    return rounded(report.read_csv(spark, path, report.SUMMARY).withColumn("converged", F.lower("converged") == "true"))


_CURVE = [("Alpha", "Jacobi", 1000, 0.9, 1, t / 10, 2.0**-t) for t in (3, 1, 2, 1)]


@query("rep_curves", f"WITH c AS (SELECT DISTINCT mdp, solver, time_sec, residual FROM {_values(_CURVE, 'mdp, solver, n, beta, threads, time_sec, residual')}) SELECT mdp, solver, row_number() OVER (PARTITION BY mdp, solver ORDER BY time_sec) - 1 AS seq, time_sec, residual FROM c")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(report.curves(spark.createDataFrame(_CURVE, report.TRACES)))


_TUNED = [("Alpha", "static", 32, 0, 0, 3200.5, 1e8, 1500.25, 0.3, "True", 0.1, 2e8)]


@query("rep_autotune", f"SELECT mdp, planner, CAST(blk AS BIGINT) AS blk, CAST(colors AS BIGINT) AS colors, CAST(k AS BIGINT) AS \"K\", est_cost, pilot_ups, rdrop, at_sec, converged, wall_sec, ups, 'static (blk=32)' AS label FROM {_values(_TUNED, 'mdp, planner, blk, colors, k, est_cost, pilot_ups, rdrop, at_sec, converged, wall_sec, ups')}")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(report.autotune_report(spark.createDataFrame(_TUNED, report.AUTOTUNE)))
