"""Registered queries of the engine over the test tables, each with DuckDB SQL where SQL can express it.

Derived inputs (a grid of cells, candidates, coefficients) are grouped from whole tables by SQL that both engines run;
the operators under test then work on them through the DataFrame API.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from phasegrid.functions import expressions as ex
from phasegrid.functions.kernels import Params
from phasegrid.operators import cells, compare, diagnose, display, mstep, predict, starts, trajectory
from phasegrid.plans import bound_grid, descent, icl, paths
from phasegrid.plans.descent import Run, Spec
from phasegrid.sources import features, generators

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = re.sub(r"\blambda\b", '"lambda"', sql)  # a keyword there
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[r6(n).alias(n) if t == "double" else F.col(n) for n, t in df.dtypes])


# Derived inputs. Each is one grouping of a whole table, in SQL that both engines read alike.
CELLS = """
SELECT CAST(1 + user_id % 6 AS DOUBLE) / 2 AS c, CAST(1 + event_id % 12 AS DOUBLE) / 10 AS lambda,
       avg(CASE WHEN value < 70 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS stab_algo,
       avg(CASE WHEN value < 80 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS rsi,
       avg(CASE WHEN value > 150 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS sat,
       CAST(1 + count(DISTINCT CASE WHEN value > 120 THEN event_type END) AS INT) AS reo,
       avg(value) AS h
FROM {events} GROUP BY 1, 2"""
LINE = """
SELECT CAST(1 + event_id % 30 AS DOUBLE) / 10 AS lambda, avg(value) AS x,
       avg(CASE WHEN value < 70 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS stab_algo,
       avg(CASE WHEN value < 80 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS rsi,
       avg(CASE WHEN value > 150 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS sat,
       avg(value) / 100 AS b, avg(ln(1 + value)) / 10 AS a,
       CAST(1 + count(DISTINCT CASE WHEN value > 220 THEN event_type END) AS INT) AS reo,
       CAST(event_id % 30 AS INT) AS run
FROM {events} GROUP BY event_id % 30"""
CANDIDATES = """
SELECT CAST(1 + event_id % 12 AS DOUBLE) / 10 AS lambda, CASE WHEN user_id % 2 = 0 THEN 'fixed' ELSE 'boot' END AS source,
       CAST(user_id % 7 AS INT) AS idx, CASE WHEN user_id % 7 = 3 THEN NULL ELSE avg(value) END AS h,
       CAST(count(DISTINCT event_type) AS INT) AS reo,
       CASE WHEN event_id % 3 = 0 THEN 'fresh' WHEN event_id % 3 = 1 THEN 'warm_forward' ELSE 'warm_backward' END AS origin
FROM {events} GROUP BY event_id % 12, user_id % 2, user_id % 7, event_id % 3"""


def derived(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    return spark.sql(text, events=table(spark, sf_dir, "events"))


def duck(text: str) -> str:
    return text.format(events="events")


LEAST = 1 / math.sqrt(2 * math.pi)
_ASSIGN_1D = """(SELECT event_id, value, k FROM (
  SELECT e.event_id, e.value, p.k, row_number() OVER (PARTITION BY e.event_id ORDER BY ln(p.nu) - ln(p.s) / 0.5 - (e.value - p.m) * (e.value - p.m) / (2 * 0.5 * p.s * p.s) DESC, p.k) AS rn
  FROM events e CROSS JOIN {p} p) WHERE rn = 1)"""
_PARAMS_1D = """(SELECT dense_rank() OVER (ORDER BY k) AS k, count(*) AS n, avg(value) AS m, sqrt(var_pop(value)) AS sd,
  greatest(sqrt(var_pop(value)), {least} / 0.05) AS s, CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM events) AS nu FROM {l} GROUP BY k)"""


def _nested(iterations: int) -> str:
    out = ["l0 AS (SELECT event_id, value, (event_id * 7) % 4 + 1 AS k FROM events)"]
    for i in range(iterations):
        out.append(f"p{i} AS {_PARAMS_1D.format(least=LEAST, l=f'l{i}')}")
        out.append(f"l{i + 1} AS {_ASSIGN_1D.format(p=f'p{i}')}")
    out.append(f"p{iterations} AS {_PARAMS_1D.format(least=LEAST, l=f'l{iterations}')}")
    return "WITH " + ",\n".join(out)


@query(
    "cec1d_iter3",
    _nested(3)
    + f" SELECT CAST(k AS INT) AS k, n, round(m, 6) AS m, round(s, 6) AS s, round(nu, 6) AS nu, sd < {LEAST} / 0.05 AS bound FROM p3",
)
def cec1d_iter3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three parameter and assignment steps of the one-dimensional model on all events, from fixed labels."""
    obs = table(spark, sf_dir, "events").select("event_id", "value")
    spec = Spec(["value"], id="event_id", univariate=True)
    run = Run("one", 0.5, 0.05, ((F.col("event_id") * 7) % 4 + 1).cast("int"))
    descent.descend(obs, spec, [run], loops=2)
    stats = mstep.gaussian_stats(descent.labelled(obs, spec, run, "k"), ["k"], ["value"])
    out = mstep.bounded_1d(stats, F.sum("w").over(Window.partitionBy()), 0.05)
    order = Window.orderBy("k")  # a row a cluster
    return out.select(F.row_number().over(order).alias("k"), "n", r6("m").alias("m"), r6("s").alias("s"), r6("nu").alias("nu"), "bound")


_BY_TYPE = "SELECT event_type AS k, count(*) AS n, avg(value) AS m, var_pop(value) AS v, CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM events) AS nu FROM events GROUP BY event_type"


@query(
    "cec1d_objective",
    f"""WITH p AS ({_BY_TYPE}), s AS (SELECT nu, v, greatest(v, ({LEAST} / c) * ({LEAST} / c)) AS g, c FROM p, (SELECT unnest([0.005, 0.008, 0.05]) AS c)),
    ab AS (SELECT c, -sum(nu * ln(nu)) AS a, 0.5 * (ln(2 * pi()) + sum(nu * ln(g)) + sum(nu * v / g)) AS b FROM s GROUP BY c)
    SELECT CAST(c AS DOUBLE) AS c, CAST(lam AS DOUBLE) AS lambda, round(a, 6) AS h_class, round(b / lam, 6) AS h_cond, round(a + b / lam, 6) AS h
    FROM ab, (SELECT unnest([0.2, 0.5, 1.0, 2.0]) AS lam)""",
)
def cec1d_objective(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The objective of the partition by event type at a grid of bounds and weights, from one aggregate."""
    stats = mstep.gaussian_stats(table(spark, sf_dir, "events"), ["event_type"], ["value"])
    bounds = F.explode(F.array(*[F.lit(c) for c in (0.005, 0.008, 0.05)])).alias("c")
    p = mstep.bounded_1d(stats.select("*", bounds), F.sum("w").over(Window.partitionBy("c")), F.col("c"))
    g = F.col("s") * F.col("s")
    ab = p.groupBy("c").agg(
        (-F.sum(F.col("nu") * F.ln("nu"))).alias("a"),
        (0.5 * (math.log(2 * math.pi) + F.sum(F.col("nu") * F.ln(g)) + F.sum(F.col("nu") * F.col("var") / g))).alias("b"),
    )
    lam = F.explode(F.array(*[F.lit(v) for v in (0.2, 0.5, 1.0, 2.0)])).alias("lambda")
    out = ab.select("*", lam)
    cond = F.col("b") / F.col("lambda")
    return out.select("c", "lambda", r6("a").alias("h_class"), r6(cond).alias("h_cond"), r6(F.col("a") + cond).alias("h"))


FIXED_1D = Params(
    np.array([0.5, 0.3, 0.2]), np.array([[20000.0], [45000.0], [70000.0]]), np.array([[[9000.0**2]], [[12000.0**2]], [[15000.0**2]]]), np.zeros(3), np.zeros((3, 0, 0)), np.zeros(3, bool), np.zeros(3, bool)
)
_P1 = "(VALUES (1, 0.5, 20000.0, 9000.0), (2, 0.3, 45000.0, 12000.0), (3, 0.2, 70000.0, 15000.0)) p(k, nu, m, s)"
_D1 = "-ln(s) - 0.5 * ln(2 * pi()) - 0.5 * ((x - m) / s) * ((x - m) / s)"
_SCORED_1D = f"""WITH l AS (SELECT row_number() OVER () AS id, l_extendedprice AS x FROM lineitem),
    d AS (SELECT id, k, {_D1} AS d, row_number() OVER (PARTITION BY id ORDER BY ({_D1}) / 0.8 + ln(nu) DESC, k) AS rn FROM l, {_P1}) """


@query("cec1d_assign", _SCORED_1D + "SELECT CAST(k AS INT) AS cluster, count(*) AS n FROM d WHERE rn = 1 GROUP BY k")
def cec1d_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One assignment step with given parameters over all line items."""
    df = table(spark, sf_dir, "lineitem").select("l_extendedprice")
    return df.select(ex.label(FIXED_1D, [F.col("l_extendedprice")], [], 0.8).alias("cluster")).groupBy("cluster").agg(F.count("*").alias("n"))


@query("cec1d_logdens", _SCORED_1D + "SELECT CAST(k AS INT) AS cluster, round(avg(d), 6) AS mean_log_density FROM d WHERE rn = 1 GROUP BY k")
def cec1d_logdens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean log density of rows under their cluster."""
    df = table(spark, sf_dir, "lineitem").select("l_extendedprice")
    x = [F.col("l_extendedprice")]
    dens = ex.log_densities(FIXED_1D, x, [])
    df = df.select(ex.label(FIXED_1D, x, [], 0.8).alias("cluster"), F.array(*dens).alias("d"))
    return df.groupBy("cluster").agg(r6(F.avg(F.element_at("d", F.col("cluster")))).alias("mean_log_density"))


@query(
    "cec1d_soft_params",
    """WITH w AS (SELECT o_totalprice AS z, CASE k WHEN 1 THEN 1 / (1 + exp((o_totalprice - 200000) / 60000)) ELSE 1 - 1 / (1 + exp((o_totalprice - 200000) / 60000)) END AS w, k
      FROM orders, (VALUES (1), (2)) t(k)), m AS (SELECT k, sum(w) AS sw, sum(w * z) / sum(w) AS m FROM w GROUP BY k)
    SELECT CAST(w.k AS INT) AS k, round(any_value(sw) / (SELECT count(*) FROM orders), 6) AS nu, round(any_value(m), 3) AS m, round(sqrt(sum(w * (z - m) * (z - m)) / any_value(sw)), 3) AS s
    FROM w JOIN m USING (k) GROUP BY w.k""",
)
def cec1d_soft_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted parameter step: means and variances from soft assignments of all orders."""
    z = F.col("o_totalprice")
    p = 1 / (1 + F.exp((z - 200000) / 60000))
    soft = F.explode(F.array(F.struct(F.lit(1).alias("k"), p.alias("w")), F.struct(F.lit(2).alias("k"), (1 - p).alias("w"))))
    rows = table(spark, sf_dir, "orders").select(z.alias("z"), soft.alias("t")).select("z", F.col("t.k").alias("k"), F.col("t.w").alias("phi"))
    stats = mstep.gaussian_stats(rows, ["k"], ["z"], "phi")
    nu = F.col("w") / F.sum("w").over(Window.partitionBy())
    return stats.select("k", r6(nu).alias("nu"), F.round("m_0", 3).alias("m"), F.round(F.sqrt("s_0_0"), 3).alias("s"))


@query(
    "cec2d_stats",
    f"""SELECT l_returnflag AS k, count(*) AS n, round(avg(l_quantity), 6) AS m_q, round(avg(l_extendedprice / 1000), 6) AS m_p, round(var_pop(l_quantity), 6) AS v_q,
    round(covar_pop(l_quantity, l_extendedprice / 1000), 6) AS cov, round(var_pop(l_extendedprice / 1000), 6) AS v_p,
    var_pop(l_quantity) * var_pop(l_extendedprice / 1000) - covar_pop(l_quantity, l_extendedprice / 1000) * covar_pop(l_quantity, l_extendedprice / 1000) < power({LEAST} / sqrt(0.0005), 4) AS bound
    FROM lineitem GROUP BY 1""",
)
def cec2d_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-dimensional statistics of each return flag and whether the bound 0.0005 is met."""
    df = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("k"), F.col("l_quantity").alias("q"), (F.col("l_extendedprice") / 1000).alias("p"))
    s = mstep.gaussian_stats(df, ["k"], ["q", "p"])
    det = F.col("s_0_0") * F.col("s_1_1") - F.col("s_0_1") * F.col("s_0_1")
    least = (LEAST / math.sqrt(0.0005)) ** 4
    return s.select(
        "k", F.col("w").cast("long").alias("n"), r6("m_0").alias("m_q"), r6("m_1").alias("m_p"), r6("s_0_0").alias("v_q"), r6("s_0_1").alias("cov"), r6("s_1_1").alias("v_p"), (det < least).alias("bound")
    )


FIXED_2D = Params(
    np.array([0.6, 0.4]), np.array([[15.0, 25.0], [35.0, 60.0]]), np.array([[[90.0, 60.0], [60.0, 220.0]], [[110.0, -20.0], [-20.0, 350.0]]]), np.zeros(2), np.zeros((2, 0, 0)), np.zeros(2, bool), np.zeros(2, bool)
)
_P2 = "(VALUES (1, 0.6, 15.0, 25.0, 90.0, 60.0, 220.0), (2, 0.4, 35.0, 60.0, 110.0, -20.0, 350.0)) p(k, nu, mq, mp, a, b, d)"
_Q2 = "-0.5 * (2 * ln(2 * pi()) + ln(a * d - b * b) + (d * (q - mq) * (q - mq) - 2 * b * (q - mq) * (x - mp) + a * (x - mp) * (x - mp)) / (a * d - b * b))"


@query(
    "cec2d_assign",
    f"""WITH l AS (SELECT row_number() OVER () AS id, l_quantity AS q, l_extendedprice / 1000 AS x FROM lineitem),
    d AS (SELECT id, k, {_Q2} AS d, row_number() OVER (PARTITION BY id ORDER BY ({_Q2}) / 0.7 + ln(nu) DESC, k) AS rn FROM l, {_P2})
    SELECT CAST(k AS INT) AS cluster, count(*) AS n, round(avg(d), 6) AS mean_log_density FROM d WHERE rn = 1 GROUP BY k""",
)
def cec2d_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assignment with full covariances over all line items, unrolled: a projection and an aggregate."""
    df = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("q"), (F.col("l_extendedprice") / 1000).alias("p"))
    x = [F.col("q"), F.col("p")]
    df = df.select(ex.label(FIXED_2D, x, [], 0.7).alias("cluster"), F.array(*ex.log_densities(FIXED_2D, x, [])).alias("d"))
    return df.groupBy("cluster").agg(F.count("*").alias("n"), r6(F.avg(F.element_at("d", F.col("cluster")))).alias("mean_log_density"))


_E4 = [f"CAST(embedding[{i + 1}] AS DOUBLE)" for i in range(4)]


@query(
    "cecpd_stats",
    "SELECT label, count(*) AS n, "
    + ", ".join(f"round(avg({e}), 6) AS m_{i}" for i, e in enumerate(_E4))
    + ", "
    + ", ".join(f"round({f'var_pop({_E4[i]})' if i == j else f'covar_pop({_E4[i]}, {_E4[j]})'}, 6) AS s_{i}_{j}" for i in range(4) for j in range(i, 4))
    + " FROM embeddings GROUP BY label",
)
def cecpd_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means and covariances of four embedding dimensions by label."""
    df = table(spark, sf_dir, "embeddings").select("label", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(4)])
    s = mstep.gaussian_stats(df, ["label"], [f"e{i}" for i in range(4)])
    return rounded(s.withColumn("n", F.col("w").cast("long")).drop("w"))


@query(
    "discrete_encode",
    """WITH v AS (SELECT DISTINCT 0 AS col, l_returnflag AS level FROM lineitem UNION SELECT DISTINCT 1, l_linestatus FROM lineitem)
    SELECT level, CAST(row_number() OVER (ORDER BY level) AS INT) AS code, bool_or(col = 0) AS in_flag, bool_or(col = 1) AS in_status FROM v GROUP BY level""",
)
def discrete_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pooled dictionary of two categorical columns and where levels occur."""
    d = features.dictionary(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"])
    return d.select("level", "code", F.col("present")[0].alias("in_flag"), F.col("present")[1].alias("in_status"))


@query(
    "discrete_probs",
    """WITH v AS (SELECT CAST(CASE WHEN l_quantity <= 25 THEN 1 ELSE 2 END AS INT) AS k, 0 AS col, l_returnflag AS level FROM lineitem
      UNION ALL SELECT CASE WHEN l_quantity <= 25 THEN 1 ELSE 2 END, 1, l_linestatus FROM lineitem)
    SELECT k, CAST(col AS INT) AS col, level, round(CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY k, col), 6) AS p FROM v GROUP BY k, col, level""",
)
def discrete_probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level probabilities of two categorical columns in two clusters."""
    df = table(spark, sf_dir, "lineitem").withColumn("k", F.when(F.col("l_quantity") <= 25, 1).otherwise(2))
    counts = mstep.level_counts(df, ["k"], ["l_returnflag", "l_linestatus"])
    p = mstep.floored_levels(counts, ["k"], math.inf)
    return p.select("k", "col", F.col("code").alias("level"), r6("p").alias("p"))


@query(
    "discrete_floor",
    """WITH c AS (SELECT o_orderstatus AS k, o_orderpriority AS level, count(*) AS n FROM orders GROUP BY 1, 2),
    f AS (SELECT k, level, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY k) AS p FROM c),
    s AS (SELECT *, row_number() OVER w - 1 AS m, coalesce(sum(p) OVER (PARTITION BY k ORDER BY p, level ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lost FROM f WINDOW w AS (PARTITION BY k ORDER BY p, level)),
    t AS (SELECT *, p / (1 - lost) * (1 - m / 5.02) >= 1 / 5.02 AS fits FROM s),
    u AS (SELECT k, min(m) AS cut, min_by(lost, m) AS cut_lost FROM t WHERE fits GROUP BY k)
    SELECT t.k, level, round(CASE WHEN m < cut THEN 1 / 5.02 ELSE p / (1 - cut_lost) * (1 - cut / 5.02) END, 6) AS p, m < cut AS raised FROM t JOIN u ON t.k = u.k""",
)
def discrete_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order priorities by status with no probability below 1/5.02."""
    counts = mstep.level_counts(table(spark, sf_dir, "orders").withColumnRenamed("o_orderstatus", "k"), ["k"], ["o_orderpriority"])
    return mstep.floored_levels(counts, ["k"], 5.02).select("k", F.col("code").alias("level"), r6("p").alias("p"), "raised")


_PROB = np.array([[[0.7, 0.3, 0.0, 0.0, 0.0], [0.0, 0.0, 0.6, 0.4, 0.0]], [[0.2, 0.3, 0.5, 0.0, 0.0], [0.0, 0.0, 0.0, 0.5, 0.5]]])


@query(
    "discrete_assign",
    """WITH s AS (SELECT o_orderstatus AS st, o_orderpriority AS pr,
      CASE o_orderstatus WHEN 'F' THEN 0.7 WHEN 'O' THEN 0.3 ELSE 0 END * CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 0.6 WHEN o_orderpriority = '3-MEDIUM' THEN 0.4 ELSE 0 END AS p1,
      CASE o_orderstatus WHEN 'F' THEN 0.2 WHEN 'O' THEN 0.3 ELSE 0.5 END * CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 0 ELSE 0.5 END AS p2 FROM orders)
    SELECT CAST(CASE WHEN p1 = 0 AND p2 = 0 THEN 1 WHEN p2 = 0 THEN 1 WHEN p1 = 0 THEN 2 WHEN ln(p1) / 0.9 + ln(0.55) >= ln(p2) / 0.9 + ln(0.45) THEN 1 ELSE 2 END AS INT) AS cluster,
      p1 = 0 AND p2 = 0 AS impossible, count(*) AS n FROM s GROUP BY 1, 2""",
)
def discrete_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assignment by categories; a level of probability 0 forbids a cluster, and the first is taken when all are."""
    df = table(spark, sf_dir, "orders").select(
        F.create_map(*[F.lit(v) for v in ("F", 0, "O", 1, "P", 2)])[F.col("o_orderstatus")].alias("s"),
        F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), 2).when(F.col("o_orderpriority") == "3-MEDIUM", 3).otherwise(4).alias("p"),
    )
    params = Params(np.array([0.55, 0.45]), np.zeros((2, 0)), np.zeros((2, 0, 0)), np.zeros(2), _PROB, np.zeros(2, bool), np.zeros(2, bool))
    codes = [F.col("s"), F.col("p")]
    best = F.greatest(*ex.log_densities(params, [], codes))
    return df.select(ex.label(params, [], codes, 0.9).alias("cluster"), (best == ex.NEG_INF).alias("impossible")).groupBy("cluster", "impossible").agg(F.count("*").alias("n"))


@query(
    "mixed_objective",
    """WITH l AS (SELECT l_returnflag AS k, l_quantity AS x, l_linestatus AS f FROM lineitem), n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM l),
    g AS (SELECT k, count(*) / any_value(n.n) AS nu, var_pop(x) AS v FROM l, n GROUP BY k),
    p AS (SELECT k, f, count(*) / any_value(n.n) AS w, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY k) AS p FROM l, n GROUP BY k, f),
    ab AS (SELECT -sum(nu * ln(nu)) AS a, 0.5 * (ln(2 * pi()) + sum(nu * ln(v)) + sum(nu)) AS bg FROM g), d AS (SELECT -sum(w * ln(p)) AS bd FROM p)
    SELECT round(a, 6) AS h_class, round(bg / 0.5, 6) AS h_numeric, round(bd / 0.5, 6) AS h_levels, round(a + (bg + bd) / 0.5, 6) AS h FROM ab, d""",
)
def mixed_objective(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objective of the partition by return flag of a number and a category: class entropy once, both parts added."""
    df = table(spark, sf_dir, "lineitem")
    total = F.sum("w").over(Window.partitionBy())
    g = mstep.gaussian_stats(df, ["l_returnflag"], ["l_quantity"]).withColumn("nu", F.col("w") / total)
    a = g.agg((-F.sum(F.col("nu") * F.ln("nu"))).alias("a"), (0.5 * (math.log(2 * math.pi) + F.sum(F.col("nu") * F.ln("s_0_0")) + F.sum("nu"))).alias("bg"))
    p = mstep.floored_levels(mstep.level_counts(df, ["l_returnflag"], ["l_linestatus"]), ["l_returnflag"], math.inf)
    d = p.agg((-F.sum(F.col("n") * F.ln("p")) / F.sum("n")).alias("bd"))
    out = a.crossJoin(F.broadcast(d))  # one row each
    return out.select(r6("a").alias("h_class"), r6(F.col("bg") / 0.5).alias("h_numeric"), r6(F.col("bd") / 0.5).alias("h_levels"), r6(F.col("a") + (F.col("bg") + F.col("bd")) / 0.5).alias("h"))


@query(
    "saturation_share",
    f"""WITH p AS ({_BY_TYPE}), c AS (SELECT CAST(unnest([0.004, 0.00812, 0.00815, 0.02]) AS DOUBLE) AS c)
    SELECT c, round(sum(CASE WHEN sqrt(v) < {LEAST} / c THEN nu ELSE 0 END) / sum(nu), 6) AS sat, count_if(sqrt(v) < {LEAST} / c) AS n_sat_clusters, bool_or(sqrt(v) < {LEAST} / c) AS any_bound_saturation
    FROM p, c GROUP BY c""",
)
def saturation_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of events in clusters that meet the density bound, at a grid of bounds."""
    stats = mstep.gaussian_stats(table(spark, sf_dir, "events"), ["event_type"], ["value"])
    bounds = F.explode(F.array(*[F.lit(c) for c in (0.004, 0.00812, 0.00815, 0.02)])).alias("c")
    p = mstep.bounded_1d(stats.select("*", bounds), F.sum("w").over(Window.partitionBy("c")), F.col("c"))
    return rounded(diagnose.saturation(p, ["c"], flag="bound"))


@query("contingency", "SELECT l_returnflag AS x, l_linestatus AS y, count(*) AS n FROM lineitem GROUP BY 1, 2")
def contingency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.contingency(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus")


def _ari_sql(source: str, by: str = "") -> str:
    g, on = (f"{by}, ", f" USING ({by})") if by else ("", " ON true")
    p = "CAST(sum(n * (n - 1) / 2) AS DOUBLE)"
    group = f"GROUP BY {by}" if by else ""
    return f"""t AS ({source}), s AS (SELECT {g}CAST(sum(n) AS DOUBLE) AS n, {p} AS o FROM t {group}),
    rx AS (SELECT {g}{p} AS px FROM (SELECT {g}x, sum(n) AS n FROM t GROUP BY {g}x) {group}), ry AS (SELECT {g}{p} AS py FROM (SELECT {g}y, sum(n) AS n FROM t GROUP BY {g}y) {group}),
    ari AS (SELECT {g}(o - px * py / (n * (n - 1) / 2)) / ((px + py) / 2 - px * py / (n * (n - 1) / 2)) AS ari FROM s JOIN rx{on} JOIN ry{on})"""


@query("ari", f"WITH {_ari_sql('SELECT l_returnflag AS x, l_linestatus AS y, count(*) AS n FROM lineitem GROUP BY 1, 2')} SELECT round(ari, 9) AS ari FROM ari")
def ari(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adjusted Rand index of two partitions of all line items."""
    t = compare.contingency(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus")
    return compare.ari_of(t).select(F.round("ari", 9).alias("ari"))


_MATCH = """WITH t AS (SELECT l_returnflag AS x, l_linestatus AS y, count(*) AS n FROM lineitem GROUP BY 1, 2),
    a AS (SELECT DISTINCT x FROM t), m AS (SELECT a.x AS xf, b.x AS xo, coalesce((SELECT n FROM t WHERE x = a.x AND y = 'F'), 0) + coalesce((SELECT n FROM t WHERE x = b.x AND y = 'O'), 0) AS s FROM a, a b WHERE a.x <> b.x)"""


@query("match_distance", _MATCH + " SELECT round(CAST(max(s) AS DOUBLE) / (SELECT count(*) FROM lineitem), 9) AS similarity, round(1 - CAST(max(s) AS DOUBLE) / (SELECT count(*) FROM lineitem), 9) AS distance FROM m")
def match_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of rows two partitions agree on under the best one-to-one renaming."""
    s = compare.similarity(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus")
    return s.select(F.round("similarity", 9).alias("similarity"), F.round("distance", 9).alias("distance"))


_RUNS_SQL = {
    "r0": "CAST(floor(l_quantity / 17) AS INT)",
    "r1": "CAST(floor((l_quantity + 2) / 17) AS INT)",
    "r2": "CAST(floor(l_quantity / 13) AS INT)",
    "r3": "CAST(floor(l_extendedprice / 26000) AS INT)",
}


def _run_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(*[F.expr(e).alias(n) for n, e in _RUNS_SQL.items()])


_PAIRS = " UNION ALL ".join(
    f"SELECT '{a}{b}' AS g, {_RUNS_SQL[f'r{a}']} AS x, {_RUNS_SQL[f'r{b}']} AS y, count(*) AS n FROM lineitem GROUP BY 2, 3" for a in range(4) for b in range(a + 1, 4)
)


@query(
    "pairwise_stability",
    f"""WITH {_ari_sql(_PAIRS, 'g')}, sides AS (SELECT CAST(g[1] AS INT) AS run, ari FROM ari UNION ALL SELECT CAST(g[2] AS INT), ari FROM ari),
    means AS (SELECT run, (sum(ari) + 1) / 4 AS m FROM sides GROUP BY run)
    SELECT round(avg(ari), 6) AS mean, round(stddev_samp(ari), 6) AS sd, round(median(ari), 6) AS median, round(min(ari), 6) AS min, round(max(ari), 6) AS max,
    (SELECT run FROM means ORDER BY m DESC, run LIMIT 1) AS medoid FROM ari""",
)
def pairwise_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity of all pairs of four partitions of all line items, and the medoid."""
    return rounded(compare.stability(compare.pairwise(_run_labels(spark, sf_dir), list(_RUNS_SQL)), 4))


@query(
    "reference_stability",
    f"""WITH {_ari_sql(_PAIRS, 'g')}, own AS (SELECT ari FROM ari WHERE g IN ('01', '12') UNION ALL SELECT 1.0)
    SELECT 1 AS ref, count(*) AS n, round(avg(ari), 6) AS mean, round(stddev_samp(ari), 6) AS sd, round(min(ari), 6) AS min, round(max(ari), 6) AS max FROM own""",
)
def reference_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity to the run of least objective, that run included; a run without a finite objective is left out."""
    return rounded(compare.reference_stability(_run_labels(spark, sf_dir), list(_RUNS_SQL), [3.0, 1.5, 2.0, None]))


@query(
    "relabel_by_weight",
    "SELECT event_type, count(*) AS n, round(CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (), 6) AS nu, CAST(row_number() OVER (ORDER BY count(*) DESC, event_type) AS INT) AS new_label FROM events GROUP BY event_type",
)
def relabel_by_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(compare.relabelled_by_weight(table(spark, sf_dir, "events"), "event_type"))


@query(
    "relabel_to_reference",
    _MATCH + ", b AS (SELECT xf, xo FROM m ORDER BY s DESC, xf, xo LIMIT 1), c AS (SELECT CAST(CASE xf WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS INT) AS f, CAST(CASE xo WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS INT) AS o FROM b) SELECT 'F' AS label, f AS new_label FROM c UNION ALL SELECT 'O', o FROM c",
)
def relabel_to_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line statuses renamed to the return flags (numbered) that they match best."""
    df = table(spark, sf_dir, "lineitem").withColumn("ref", F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 2).otherwise(3))
    return spark.createDataFrame(compare.relabelled_to_reference(df, "l_linestatus", "ref"), "label string, new_label int")


@query(
    "numeric_summary",
    """SELECT o_orderpriority, count(o_totalprice) AS n, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS sd, min(o_totalprice) AS min, round(quantile_cont(o_totalprice, 0.25), 4) AS q25,
    round(quantile_cont(o_totalprice, 0.5), 4) AS median, round(quantile_cont(o_totalprice, 0.75), 4) AS q75, max(o_totalprice) AS max FROM orders GROUP BY 1""",
)
def numeric_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = diagnose.numeric_summary(table(spark, sf_dir, "orders"), "o_totalprice", ["o_orderpriority"])
    return s.select("o_orderpriority", "n", *[F.round(c, 4).alias(c) if c not in ("min", "max") else F.col(c) for c in ("mean", "sd", "min", "q25", "median", "q75", "max")])


_MONTHS = "SELECT date_trunc('month', o_orderdate) AS month, sum(o_totalprice) AS total FROM orders GROUP BY 1"


def _months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("month")).agg(F.sum("o_totalprice").alias("total"))


@query(
    "moving_average",
    f"""WITH m AS ({_MONTHS}) SELECT CAST(month AS DATE) AS month, round(avg(total) OVER (ORDER BY month ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 2) AS k3,
    round(avg(total) OVER (ORDER BY month ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 2) AS k4, round(total, 2) AS k1 FROM m""",
)
def moving_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clipped centred means of monthly totals; k = 4 acts like 5."""
    m = _months(spark, sf_dir)
    avg = lambda k: F.round(diagnose.moving_average("total", "month", k), 2)
    return m.select(F.col("month").cast("date").alias("month"), avg(3).alias("k3"), avg(4).alias("k4"), avg(1).alias("k1"))


_LINE_D = duck(LINE)
_ISLANDS = """, f AS (SELECT lambda, {cond} AS ok FROM l), i AS (SELECT *, row_number() OVER (ORDER BY lambda) - row_number() OVER (PARTITION BY ok ORDER BY lambda) AS g FROM f)"""


@query(
    "stable_runs",
    f"WITH l AS ({_LINE_D})" + _ISLANDS.format(cond="stab_algo >= 0.7504") + " SELECT min(lambda) AS first, max(lambda) AS last, count(*) AS length FROM i WHERE ok GROUP BY g HAVING count(*) >= 2",
)
def stable_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of at least two stable weights."""
    line = derived(spark, sf_dir, LINE).withColumn("ok", F.col("stab_algo") >= 0.7504)
    return diagnose.stable_runs(line, "ok", "lambda", 2)


@query(
    "select_stable",
    f"""WITH l AS ({_LINE_D}), s AS (SELECT lambda, stab_algo >= 0.7404 AND rsi >= 0.7904 AS keep_stability, sat > 0.0504 AS exclude_saturation FROM l)
    SELECT lambda, keep_stability, exclude_saturation, keep_stability AND NOT exclude_saturation AS stable, min(CASE WHEN keep_stability AND NOT exclude_saturation THEN lambda END) OVER () AS first_stable FROM s""",
)
def select_stable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stability and saturation together; the least kept weight."""
    out = diagnose.select_stable(derived(spark, sf_dir, LINE), ratio_at_least=0.7904, stab_at_least=0.7404, sat_at_most=0.0504)
    return out.select("lambda", "keep_stability", "exclude_saturation", "stable", "first_stable")


@query(
    "apply_thresholds",
    f"""WITH g AS ({duck(CELLS)}), s AS (SELECT *, stab_algo >= 0.7504 AND rsi >= 0.7904 AS keep_stability, sat > 0.0504 AS exclude_saturation FROM g)
    SELECT c, lambda, keep_stability, exclude_saturation, keep_stability AND NOT exclude_saturation AS keep,
    CASE WHEN keep_stability AND NOT exclude_saturation THEN 'ok' WHEN NOT keep_stability AND exclude_saturation THEN 'stability_rsi_and_saturation' WHEN NOT keep_stability THEN 'stability_or_rsi' ELSE 'saturation' END AS fail_reason FROM s""",
)
def apply_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = diagnose.apply_thresholds(derived(spark, sf_dir, CELLS), 0.7504, 0.7904, 0.0504)
    return out.select("c", "lambda", "keep_stability", "exclude_saturation", "keep", "fail_reason")


@query(
    "best_per_lambda",
    f"WITH k AS ({duck(CANDIDATES)}) SELECT lambda, source, idx, round(h, 6) AS h, reo, origin FROM (SELECT *, row_number() OVER (PARTITION BY lambda ORDER BY h, source, idx, origin) AS rn FROM k WHERE h IS NOT NULL) WHERE rn = 1",
)
def best_per_lambda(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidate of least finite objective at each weight."""
    return rounded(trajectory.best_of(derived(spark, sf_dir, CANDIDATES), ["lambda"], ties=("source", "idx", "origin")))


@query(
    "coherence",
    f"""WITH l AS ({_LINE_D}), n AS (SELECT lambda, a + b / lambda AS h, lag(a) OVER w + lag(b) OVER w / lambda AS h_before, lead(a) OVER w + lead(b) OVER w / lambda AS h_after FROM l WINDOW w AS (ORDER BY lambda))
    SELECT lambda, round(h, 6) AS h, round(h_before, 6) AS h_before, round(h_after, 6) AS h_after, coalesce(h_before >= h - 1e-10, true) AND coalesce(h_after >= h - 1e-10, true) AS coherent FROM n""",
)
def coherence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each weight's partition is at least as good there as its neighbours'."""
    return rounded(trajectory.coherence(derived(spark, sf_dir, LINE)).select("lambda", "h", "h_before", "h_after", "coherent"))


@query(
    "lambda_repair",
    f"""WITH RECURSIVE l AS ({_LINE_D}), o AS (SELECT *, row_number() OVER (ORDER BY lambda) AS i FROM l),
    r AS (SELECT i, run, a, b FROM o WHERE i = 1 UNION ALL
      SELECT o.i, CASE WHEN r.a + r.b / o.lambda < o.a + o.b / o.lambda - 1e-10 THEN r.run ELSE o.run END, CASE WHEN r.a + r.b / o.lambda < o.a + o.b / o.lambda - 1e-10 THEN r.a ELSE o.a END,
        CASE WHEN r.a + r.b / o.lambda < o.a + o.b / o.lambda - 1e-10 THEN r.b ELSE o.b END FROM r JOIN o ON o.i = r.i + 1),
    q AS (SELECT r.*, o.lambda, o.run AS own FROM r JOIN o USING (i)),
    s AS (SELECT i, run, a, b, lambda, own FROM q WHERE i = (SELECT max(i) FROM q) UNION ALL
      SELECT q.i, CASE WHEN s.a + s.b / q.lambda < q.a + q.b / q.lambda - 1e-10 THEN s.run ELSE q.run END, CASE WHEN s.a + s.b / q.lambda < q.a + q.b / q.lambda - 1e-10 THEN s.a ELSE q.a END,
        CASE WHEN s.a + s.b / q.lambda < q.a + q.b / q.lambda - 1e-10 THEN s.b ELSE q.b END, q.lambda, q.own FROM s JOIN q ON q.i = s.i - 1)
    SELECT lambda, CAST(run AS INT) AS run, round(a + b / lambda, 6) AS h, run <> own AS repaired FROM s""",
)
def lambda_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours' partitions copied along the weights where they score better."""
    return rounded(trajectory.repair_lambda(derived(spark, sf_dir, LINE)).select("lambda", "run", "h", "repaired"))


C_BEST = """SELECT CAST(1 + user_id % 6 AS DOUBLE) / 2 AS c, CAST(1 + event_id % 5 AS DOUBLE) / 5 AS lambda, CAST(user_id % 6 AS INT) AS run FROM {events} GROUP BY user_id % 6, event_id % 5"""
C_EVAL = """SELECT CAST(1 + user_id % 6 AS DOUBLE) / 2 AS c, CAST(1 + event_id % 5 AS DOUBLE) / 5 AS lambda, CAST(event_id % 6 AS INT) AS run, avg(ln(1 + value)) AS a, avg(value) / 100 AS b
FROM {events} GROUP BY user_id % 6, event_id % 5, event_id % 6"""


def _c_sweep(source: str, name: str, step: int) -> str:
    """One sweep along the bounds at each weight, from the first row or the last: ``i, lambda, c, run``."""
    edge = "min" if step > 0 else "max"
    better = "x.a + x.b / o.lambda < y.a + y.b / o.lambda - 1e-10"
    return f"""{name} AS (
      SELECT i, lambda, c, run FROM {source} WHERE i = (SELECT {edge}(i) FROM {source}) UNION ALL
      SELECT o.i, o.lambda, o.c, CASE WHEN {better} THEN r.run ELSE o.run END
      FROM {name} r JOIN {source} o ON o.lambda = r.lambda AND o.i = r.i + {step}
      LEFT JOIN e x ON x.lambda = o.lambda AND x.c = o.c AND x.run = r.run JOIN e y ON y.lambda = o.lambda AND y.c = o.c AND y.run = o.run)"""


@query(
    "c_repair",
    f"""WITH RECURSIVE b AS ({duck(C_BEST)}), e AS ({duck(C_EVAL)}), o AS (SELECT *, dense_rank() OVER (ORDER BY c) AS i FROM b),
    {_c_sweep("o", "up", 1)}, {_c_sweep("up", "down", -1)}
    SELECT d.c, d.lambda, d.run, round(e.a + e.b / d.lambda, 6) AS h, d.run <> b.run AS repaired
    FROM down d JOIN b ON b.c = d.c AND b.lambda = d.lambda JOIN e ON e.c = d.c AND e.lambda = d.lambda AND e.run = d.run""",
)
def c_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs copied along the bounds, up and down, where they score better."""
    return rounded(trajectory.repair_c(derived(spark, sf_dir, C_BEST), derived(spark, sf_dir, C_EVAL)))


@query(
    "change_points",
    f"""WITH l AS ({_LINE_D}), p AS (SELECT lambda, reo, stab_algo AS similarity, row_number() OVER w = 1 AS first, coalesce(reo <> lag(reo) OVER w, false) AS r, coalesce(stab_algo < 0.7404, false) AS s FROM l WINDOW w AS (ORDER BY lambda))
    SELECT lambda, first OR r AS reo_change, first OR s AS similarity_change, first OR r OR s AS either_change, first OR (r AND s) AS both_change FROM p""",
)
def change_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = derived(spark, sf_dir, LINE).select("lambda", "reo", F.col("stab_algo").alias("similarity"))
    return trajectory.change_points(path, at_least=0.7404).drop("reo", "similarity")


@query(
    "regime_changes",
    f"""WITH RECURSIVE l AS ({_LINE_D}), o AS (SELECT lambda, run, reo, row_number() OVER (ORDER BY lambda) AS i FROM l),
    r AS (SELECT i, lambda, run, reo, run AS ref, reo AS ref_reo, 1 AS regime, true AS change FROM o WHERE i = 1 UNION ALL
      SELECT o.i, o.lambda, o.run, o.reo, CASE WHEN x THEN o.run ELSE ref END, CASE WHEN x THEN o.reo ELSE ref_reo END, regime + CASE WHEN x THEN 1 ELSE 0 END, x
      FROM (SELECT r.*, r.ref_reo <> n.reo OR (abs(r.ref - n.run) > 3) AS x FROM r JOIN o n ON n.i = r.i + 1) r JOIN o ON o.i = r.i + 1)
    SELECT lambda, run, reo, CAST(regime AS INT) AS regime, change FROM r""",
)
def regime_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each weight held against the first of its regime; runs are alike when their numbers differ by three at most."""
    alike = {(a, b): float(abs(a - b) <= 3) for a in range(30) for b in range(30)}
    return trajectory.regimes(derived(spark, sf_dir, LINE), alike)


@query("zones")
def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zones of kept cells with as many clusters and like partitions; tested against a plain flood fill."""
    grid = diagnose.apply_thresholds(derived(spark, sf_dir, CELLS), 0.7, 0.75, 0.1)
    grid = grid.withColumn("run", (F.round(F.col("c") * 2) * 100 + F.round(F.col("lambda") * 10)).cast("int"))
    runs = [100 * c + v for c in range(1, 7) for v in range(1, 13)]
    return cells.zone_table(grid, {(a, b): 0.9 if (a + b) % 3 == 0 else 0.97 for a in runs for b in runs})


_ZONED = f"SELECT c, lambda, CAST(reo AS INT) AS zone FROM ({duck(CELLS)})"
_EDGES = "SELECT {v}, row_number() OVER w AS {x}_i, coalesce(({v} + lag({v}) OVER w) / 2, {v} - (lead({v}) OVER w - {v}) / 2) AS {x}_low, coalesce(({v} + lead({v}) OVER w) / 2, {v} + ({v} - lag({v}) OVER w) / 2) AS {x}_high FROM (SELECT DISTINCT {v} FROM z) WINDOW w AS (ORDER BY {v})"


@query(
    "zone_borders",
    f"""WITH z AS ({_ZONED}), ce AS ({_EDGES.format(v="c", x="c")}), le AS ({_EDGES.format(v="lambda", x="l")}), m AS (SELECT z.zone, ce.* EXCLUDE (c), le.* EXCLUDE (lambda) FROM z JOIN ce ON ce.c = z.c JOIN le ON le.lambda = z.lambda),
    s AS (SELECT m.*, lf.zone AS zl, rt.zone AS zr, lo.zone AS zd, up.zone AS zu FROM m LEFT JOIN m lf ON lf.l_i = m.l_i AND lf.c_i = m.c_i - 1 LEFT JOIN m rt ON rt.l_i = m.l_i AND rt.c_i = m.c_i + 1
      LEFT JOIN m lo ON lo.c_i = m.c_i AND lo.l_i = m.l_i - 1 LEFT JOIN m up ON up.c_i = m.c_i AND up.l_i = m.l_i + 1),
    b AS (SELECT zone, 'left' AS side, c_low AS c0, l_low AS lambda0, c_low AS c1, l_high AS lambda1 FROM s WHERE zl IS DISTINCT FROM zone UNION ALL SELECT zone, 'right', c_high, l_low, c_high, l_high FROM s WHERE zr IS DISTINCT FROM zone
      UNION ALL SELECT zone, 'lower', c_low, l_low, c_high, l_low FROM s WHERE zd IS DISTINCT FROM zone UNION ALL SELECT zone, 'upper', c_low, l_high, c_high, l_high FROM s WHERE zu IS DISTINCT FROM zone)
    SELECT zone, side, round(c0, 6) AS c0, round(lambda0, 6) AS lambda0, round(c1, 6) AS c1, round(lambda1, 6) AS lambda1 FROM b""",
)
def zone_borders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between cells with different numbers of clusters."""
    z = derived(spark, sf_dir, CELLS).select("c", "lambda", F.col("reo").alias("zone"))
    return rounded(cells.zone_borders(z, z))


@query(
    "change_detection",
    f"""WITH RECURSIVE l AS ({_LINE_D}), o AS (SELECT lambda, run, reo, row_number() OVER (ORDER BY lambda) AS i FROM l WHERE run < 25),
    r AS (SELECT i, lambda, run, reo, run AS ref, reo AS ref_reo, lambda AS ref_lambda, false AS reo_change, false AS similarity_change, true AS change, 1 AS regime FROM o WHERE i = 1 UNION ALL
      SELECT n.i, n.lambda, n.run, n.reo, CASE WHEN x AND y THEN n.run ELSE ref END, CASE WHEN x AND y THEN n.reo ELSE ref_reo END, CASE WHEN x AND y THEN n.lambda ELSE ref_lambda END, x, y, x AND y, regime + CASE WHEN x AND y THEN 1 ELSE 0 END
      FROM (SELECT r.*, r.ref_reo <> n.reo AS x, abs(r.ref - n.run) > 3 AS y FROM r JOIN o n ON n.i = r.i + 1) r JOIN o n ON n.i = r.i + 1)
    SELECT lambda, CAST(run AS INT) AS run, reo, reo_change, similarity_change, change, CAST(regime AS INT) AS regime FROM r""",
)
def change_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regimes that end when both the number of clusters and the partition differ from the regime's first, on chosen weights."""
    alike = {(a, b): float(abs(a - b) <= 3) for a in range(30) for b in range(30)}
    chosen = [float(1 + k) / 10 for k in range(25)]
    found = trajectory.detect_changes(derived(spark, sf_dir, LINE), alike, 0.8, "reo_and_similarity", "regime", chosen)
    return found.select("lambda", "run", "reo", "reo_change", "similarity_change", "change", "regime")


@query(
    "lambda_labels",
    f"""WITH l AS ({_LINE_D}) SELECT lambda, regexp_replace(CAST(lambda AS VARCHAR), '\\.0$', '') AS key, 'lamb' || 'da = ' || regexp_replace(CAST(lambda AS VARCHAR), '\\.0$', '') AS label FROM l""",
)
def lambda_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys and titles of weights."""
    v = F.col("lambda")
    return derived(spark, sf_dir, LINE).select("lambda", display.lambda_key(v).alias("key"), display.lambda_label(v).alias("label"))


@query(
    "partition_histograms",
    """WITH r AS (SELECT min(l_quantity) AS lo, (max(l_quantity) - min(l_quantity)) / 12 AS w FROM lineitem),
    l AS (SELECT 0.1 AS lam, CAST(floor(l_quantity / 17) AS INT) AS k, l_quantity AS x FROM lineitem UNION ALL SELECT 0.3, CAST(floor(l_quantity / 13) AS INT), l_quantity FROM lineitem),
    b AS (SELECT lam, k, CAST(least(floor((x - lo) / w) + 1, 12) AS INT) AS bin, count(*) AS n FROM l, r GROUP BY 1, 2, 3)
    SELECT CAST(lam AS DOUBLE) AS lambda, k AS cluster, bin, n, round(lo + (bin - 1) * w, 6) AS low, round(lo + bin * w, 6) AS high FROM b, r""",
)
def partition_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histograms by cluster of two of three weights' partitions of all line items."""
    q = F.col("l_quantity")
    cut = lambda w: F.floor(q / w).cast("int")
    df = table(spark, sf_dir, "lineitem").select(q.alias("q"), cut(17).alias("a"), cut(15).alias("b"), cut(13).alias("c"))
    return rounded(display.partition_histograms(df, "q", {0.1: "a", 0.2: "b", 0.3: "c"}, 12, at_most=2))


_DENSITY = "(-0.5 * (ln(2 * pi()) + ln(p.v) + (l.value - p.m) * (l.value - p.m) / p.v) + coalesce(ln(q.pr), CAST('-infinity' AS DOUBLE)))"


def _mixed_step(i: int) -> str:
    return f"""p{i} AS (SELECT run, k, count(*) AS n, avg(value) AS m, var_pop(value) AS v, CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM events) AS nu FROM l{i} GROUP BY run, k),
    q{i} AS (SELECT run, k, f, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY run, k) AS pr FROM l{i} GROUP BY run, k, f),
    s{i} AS (SELECT l.run, l.event_id, l.value, l.f, p.k, {_DENSITY} AS d, row_number() OVER (PARTITION BY l.run, l.event_id ORDER BY {_DENSITY} / 0.6 + ln(p.nu) DESC, p.k) AS rn
      FROM l{i} l JOIN p{i} p ON p.run = l.run LEFT JOIN q{i} q ON q.run = l.run AND q.k = p.k AND q.f = l.f),
    l{i + 1} AS (SELECT run, event_id, value, f, k FROM s{i} WHERE rn = 1)"""


@query(
    "mixed_iter2",
    f"""WITH l0 AS (SELECT 1 AS run, event_id, value, event_type AS f, (event_id * 7) % 3 + 1 AS k FROM events UNION ALL SELECT 2, event_id, value, event_type, (event_id * 5) % 4 + 1 FROM events),
    {_mixed_step(0)}, {_mixed_step(1)}, {_mixed_step(2)},
    h AS (SELECT p.run, any_value(a) - avg(d) / 0.6 AS h FROM (SELECT run, -sum(nu * ln(nu)) AS a FROM p2 GROUP BY run) p JOIN s2 ON s2.run = p.run AND s2.rn = 1 GROUP BY p.run)
    SELECT CAST(p.run AS INT) AS run, CAST(row_number() OVER (PARTITION BY p.run ORDER BY k) AS INT) AS k, round(nu, 6) AS nu, round(m, 6) AS m, round(v, 3) AS v, round(h, 6) AS h, h = (SELECT min(h) FROM h) AS best FROM p2 p JOIN h ON h.run = p.run""",
)
def mixed_iter2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs in lock step, two iterations each from fixed labels, on a number and a category of all events; the better one."""
    df, levels = features.encoded(table(spark, sf_dir, "events").select("event_id", "value", "event_type"), ["event_type"])
    spec = Spec(["value"], ["event_type_code"], len(levels), "event_id")
    start = lambda a, b: ((F.col("event_id") * a) % b + 1).cast("int")
    runs = [Run("1", 0.6, 1e6, start(7, 3)), Run("2", 0.6, 1e6, start(5, 4))]
    descent.objective(df, spec, descent.descend(df, spec, runs, loops=2))
    least = min(r.h for r in runs)
    scores = F.create_map(*[F.lit(x) for r in runs for x in (r.name, r.h)])[F.col("run")]
    p = descent.params_table(spark, runs).select(F.col("run").cast("int").alias("run"), "k", "nu", r6(F.col("mean")[0]).alias("m"), F.round(F.col("cov")[0], 3).alias("v"), scores.alias("h"))
    return p.select("run", "k", r6("nu").alias("nu"), "m", "v", r6("h").alias("h"), (F.col("h") == least).alias("best"))


@query(
    "lambda_intervals",
    "WITH v AS (SELECT DISTINCT CAST(1 + event_id % 12 AS DOUBLE) * (1 + event_id % 12) / 10 AS lambda FROM events), n AS (SELECT lambda, lag(lambda) OVER w AS p, lead(lambda) OVER w AS q FROM v WINDOW w AS (ORDER BY lambda)) SELECT lambda, round(coalesce((lambda + p) / 2, lambda - (q - lambda) / 2), 6) AS low, round(coalesce((lambda + q) / 2, lambda + (lambda - p) / 2), 6) AS high FROM n",
)
def lambda_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges midway between neighbouring weights, mirrored at the ends."""
    n = 1 + F.col("event_id") % 12
    v = table(spark, sf_dir, "events").select((n.cast("double") * n / 10).alias("lambda")).distinct()
    return rounded(diagnose.intervals(v))


@query(
    "rejected_bands",
    f"""WITH l AS ({_LINE_D}), e AS (SELECT lambda, sat > 0.0504 AS ok, coalesce((lambda + lag(lambda) OVER w) / 2, lambda - (lead(lambda) OVER w - lambda) / 2) AS low, coalesce((lambda + lead(lambda) OVER w) / 2, lambda + (lambda - lag(lambda) OVER w) / 2) AS high FROM l WINDOW w AS (ORDER BY lambda)),
    i AS (SELECT *, row_number() OVER (ORDER BY lambda) - row_number() OVER (PARTITION BY ok ORDER BY lambda) AS g FROM e)
    SELECT round(min(low), 6) AS band_low, round(max(high), 6) AS band_high, count(*) AS cells FROM i WHERE ok GROUP BY g""",
)
def rejected_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring weights rejected for saturation, as bands."""
    line = derived(spark, sf_dir, LINE).withColumn("keep", F.col("sat") <= 0.0504)
    return rounded(diagnose.rejected_bands(line, "keep"))


@query(
    "bands_1d",
    """WITH p AS (SELECT value AS x, min(CASE WHEN value < 30 THEN 1 WHEN value < 33 THEN 2 WHEN value < 60 THEN 1 ELSE 3 END) AS l, count(*) AS m FROM events GROUP BY value),
    i AS (SELECT *, row_number() OVER (ORDER BY x) - row_number() OVER (PARTITION BY l ORDER BY x) AS g FROM p),
    r AS (SELECT l, min(x) AS x0, max(x) AS x1, CAST(sum(m) AS BIGINT) AS n FROM i GROUP BY l, g)
    SELECT CAST(l AS INT) AS band_label, round(coalesce((x0 + lag(x1) OVER w) / 2, x0), 6) AS low, round(coalesce((x1 + lead(x0) OVER w) / 2, x1), 6) AS high, n FROM r WINDOW w AS (ORDER BY x0)""",
)
def bands_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of equal label along the sorted values of all events."""
    v = F.col("value")
    df = table(spark, sf_dir, "events").withColumn("k", F.when(v < 30, 1).when(v < 33, 2).when(v < 60, 1).otherwise(3))
    return rounded(cells.bands(df, "value", "k"))


_UNIFORM_S = f"greatest(1.0 / m / sqrt(12.0), {LEAST} / c)"
_LAMBDAS, _BOUNDS = [0.05, 0.11, 0.23, 0.41, 0.83, 1.7], [0.31, 0.9, 1.7, 3.3, 7.1]


@query(
    "uniform_path",
    f"""WITH g AS (SELECT CAST(c AS DOUBLE) AS c, CAST(lam AS DOUBLE) AS lambda, m FROM (SELECT unnest({_BOUNDS}) AS c), (SELECT unnest({_LAMBDAS}) AS lam), range(1, 129) t(m)),
    v AS (SELECT c, lambda, m, lambda * ln(m) + 0.5 * ln(2 * pi() * {_UNIFORM_S} * {_UNIFORM_S}) + 1.0 / m / m / (24.0 * {_UNIFORM_S} * {_UNIFORM_S}) AS value FROM g)
    SELECT c, lambda, CAST(m AS INT) AS m, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY c, lambda ORDER BY round(value, 12), m) AS rn FROM v) WHERE rn = 1""",
)
def uniform_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best number of pieces for evenly spread rows, in closed form."""
    return rounded(generators.uniform_path(spark, _LAMBDAS, _BOUNDS))


@query(
    "mixture_density",
    """WITH c AS (SELECT 2 * sqrt(3) * unnest([-3, -1.75, -0.75, 0, 0.75, 1.75, 3]) AS m, unnest([0.2, 1, 0.5, 1, 0.5, 1, 0.2]) AS s, unnest([0.5, 2, 0.5, 1, 0.5, 2, 0.5]) AS w)
    SELECT event_id, round(sum(w / 7 / s / sqrt(2 * pi()) * exp(-0.5 * power((value / 10 - m) / s, 2))), 9) AS density FROM events, c GROUP BY event_id""",
)
def mixture_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """True density of the seven-component mixture at all events' scaled values."""
    df = table(spark, sf_dir, "events").select("event_id", (F.col("value") / 10).alias("x"))
    return generators.mixture_density(df, "x").select("event_id", F.round("density", 9).alias("density"))


@query("bootstrap_weights", "SELECT count(*) AS n, CAST(count(*) AS BIGINT) AS total, true AS none_negative, true AS spread FROM events")
def bootstrap_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bootstrap sample of all events as weights that add up to n; about a third of the rows aren't drawn."""
    w = generators.bootstrap_weights(table(spark, sf_dir, "events").select("event_id"), "event_id", 7)
    zero = F.count_if(F.col("w") == 0) / F.count("*")
    return w.agg(F.count("*").alias("n"), F.sum("w").alias("total"), (F.min("w") >= 0).alias("none_negative"), zero.between(0.3, 0.43).alias("spread"))


@query(
    "zscores",
    """WITH s AS (SELECT avg(p_retailprice) AS mp, stddev_samp(p_retailprice) AS sp, avg(p_size) AS ms, stddev_samp(p_size) AS ss FROM part)
    SELECT p_partkey, round((p_retailprice - mp) / sp, 6) AS p_retailprice, round((p_size - ms) / ss, 6) AS p_size FROM part, s""",
)
def zscores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standardised representation of two columns of all parts."""
    df, _ = features.represented(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice", "p_size"), ["p_retailprice", "p_size"], "normalized")
    return rounded(df)


@query(
    "pca_scores_abs",
    """WITH s AS (SELECT avg(l_quantity) AS m1, stddev_samp(l_quantity) AS s1, avg(l_extendedprice) AS m2, stddev_samp(l_extendedprice) AS s2 FROM lineitem),
    z AS (SELECT l_returnflag, (l_quantity - m1) / s1 AS a, (l_extendedprice - m2) / s2 AS b FROM lineitem, s)
    SELECT l_returnflag, round(avg(greatest(abs(a + b), abs(a - b))) / sqrt(2), 5) AS larger, round(avg(least(abs(a + b), abs(a - b))) / sqrt(2), 5) AS smaller FROM z GROUP BY 1""",
)
def pca_scores_abs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all line items on two scaled principal axes, whatever their order and sign."""
    df = display.principal_scores(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice"])
    a, b = F.abs("pc1"), F.abs("pc2")
    return df.groupBy("l_returnflag").agg(F.round(F.avg(F.greatest(a, b)), 5).alias("larger"), F.round(F.avg(F.least(a, b)), 5).alias("smaller"))


@query(
    "impute_conditional",
    f"""WITH d AS (SELECT row_number() OVER () AS id, l_extendedprice / 1000 AS x FROM lineitem),
    s AS (SELECT id, x, k, mq + b / d * (x - mp) AS pred, row_number() OVER (PARTITION BY id ORDER BY (-0.5 * (ln(2 * pi()) + ln(p.d) + (x - mp) * (x - mp) / p.d)) / 0.7 + ln(nu) DESC, k) AS rn FROM d AS l, {_P2})
    SELECT CAST(k AS INT) AS cluster, count(*) AS n, round(avg(pred), 6) AS mean_pred, round(avg(pred * pred), 5) AS square_pred FROM s WHERE rn = 1 GROUP BY k""",
)
def impute_conditional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities of all line items predicted from their price: cluster by the price alone, then the conditional mean."""
    df = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("q"), (F.col("l_extendedprice") / 1000).alias("p"))
    out = predict.impute(df, FIXED_2D, ["q", "p"], [], 0.7, [0])
    return out.groupBy("cluster").agg(F.count("*").alias("n"), r6(F.avg("pred_q")).alias("mean_pred"), F.round(F.avg(F.col("pred_q") * F.col("pred_q")), 5).alias("square_pred"))


@query(
    "nearest_cell",
    f"""WITH g AS ({duck(CELLS)}), r AS (SELECT max(c) - min(c) AS rc, max(lambda) - min(lambda) AS rl FROM g), w AS (SELECT p_partkey AS id, CAST(p_size AS DOUBLE) / 13.7 AS at_c, p_retailprice / 1501.3 AS at_lambda FROM part),
    d AS (SELECT id, at_c, at_lambda, c, lambda, row_number() OVER (PARTITION BY id ORDER BY abs(c - at_c) / rc + abs(lambda - at_lambda) / rl, c, lambda) AS rn FROM w, g, r)
    SELECT id, round(at_c, 6) AS at_c, round(at_lambda, 6) AS at_lambda, c, lambda FROM d WHERE rn = 1""",
)
def nearest_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest grid cell of a point for every part."""
    wanted = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size").cast("double") / 13.7).alias("at_c"), (F.col("p_retailprice") / 1501.3).alias("at_lambda"))
    return rounded(cells.nearest_cells(derived(spark, sf_dir, CELLS), wanted))


@query(
    "histogram",
    """WITH r AS (SELECT min(value) AS lo, max(value) AS hi FROM events), b AS (SELECT event_type, least(CAST(floor((value - lo) / ((hi - lo) / 20)) AS INT) + 1, 20) AS bin, lo, (hi - lo) / 20 AS w FROM events, r)
    SELECT event_type, bin, count(*) AS n, round(any_value(lo + (bin - 1) * w), 6) AS low, round(any_value(lo + bin * w), 6) AS high FROM b GROUP BY event_type, bin""",
)
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(display.histogram(table(spark, sf_dir, "events"), "value", 20, ["event_type"]))


@query(
    "level_shares",
    """WITH l AS (SELECT DISTINCT event_type AS level FROM events), k AS (SELECT DISTINCT CAST(floor(value / 60) AS INT) AS cluster FROM events),
    c AS (SELECT event_type AS level, CAST(floor(value / 60) AS INT) AS cluster, count(*) AS n FROM events GROUP BY 1, 2),
    f AS (SELECT l.level, k.cluster, coalesce(n, 0) AS n FROM l CROSS JOIN k LEFT JOIN c ON c.level = l.level AND c.cluster = k.cluster)
    SELECT level, cluster, n, round(100.0 * n / sum(n) OVER (PARTITION BY cluster), 6) AS percent FROM f""",
)
def level_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and shares of every event type in every cluster, zeros included."""
    df = table(spark, sf_dir, "events").withColumn("k", F.floor(F.col("value") / 60).cast("int"))
    return rounded(display.level_shares(df, "event_type", "k"))


@query(
    "pending_tasks",
    """WITH a AS (SELECT CAST(c AS DOUBLE) AS c, k AS task_type, CAST(i AS INT) AS task_idx FROM (SELECT unnest([0.5, 1.0, 2.0]) AS c), (VALUES ('fixed'), ('boot')) t(k), range(1, 6) r(i)),
    d AS (SELECT DISTINCT CAST(1 + user_id % 2 AS DOUBLE) AS c, CASE WHEN event_id % 2 = 0 THEN 'fixed' ELSE 'boot' END AS task_type, CAST(event_id % 4 AS INT) AS task_idx FROM events)
    SELECT c, task_type, task_idx, task_idx % 2 = 1 AS forward FROM a ANTI JOIN d USING (c, task_type, task_idx)""",
)
def pending_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks without results, by anti join on what names a task."""
    every = paths.tasks(spark, paths.Settings([0.5], [0.5, 1.0, 2.0], 5, 5))
    e = F.col("event_id")
    done = table(spark, sf_dir, "events").select((1 + F.col("user_id") % 2).cast("double").alias("c"), F.when(e % 2 == 0, "fixed").otherwise("boot").alias("task_type"), (e % 4).cast("int").alias("task_idx"))
    return paths.pending(every, done).select("c", "task_type", "task_idx", "forward")


@query(
    "origin_counts",
    f"WITH k AS ({duck(CANDIDATES)}) SELECT lambda, count_if(origin = 'fresh') AS n_fresh, count_if(origin = 'warm_forward') AS n_warm_forward, count_if(origin = 'warm_backward') AS n_warm_backward FROM k GROUP BY lambda",
)
def origin_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnose.origin_counts(derived(spark, sf_dir, CANDIDATES), ["lambda"])


_WIDE = ", ".join(
    f"count(CASE WHEN source = '{k}' THEN h END) AS {k}_n, round(avg(CASE WHEN source = '{k}' THEN h END), 6) AS {k}_h_mean, round(min(CASE WHEN source = '{k}' THEN h END), 6) AS {k}_h_min, round(stddev_samp(CASE WHEN source = '{k}' THEN h END), 6) AS {k}_h_sd, round(avg(CASE WHEN source = '{k}' THEN reo END), 6) AS {k}_reo_mean"
    for k in ("fixed", "boot")
)


@query("summary_rows", f"WITH k AS ({duck(CANDIDATES)}) SELECT lambda, {_WIDE} FROM k GROUP BY lambda")
def summary_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed and bootstrap statistics of each weight in one wide row."""
    return rounded(diagnose.summary_rows(derived(spark, sf_dir, CANDIDATES), ["lambda"], kind="source"))


@query(
    "extended_grid",
    f"""WITH g AS (SELECT c, lambda, reo, sat > 0.0652 AS s FROM ({duck(CELLS)})), f AS (SELECT c FROM g GROUP BY c HAVING NOT bool_or(s)), t AS (SELECT min(c) AS stop FROM f),
    w AS (SELECT unnest([0.5, 1.0, 1.5, 2.0, 2.5, 3.0]) AS cw), x AS (SELECT CAST(cw AS DOUBLE) AS cw, CASE WHEN stop IS NOT NULL AND cw > stop THEN stop ELSE CAST(cw AS DOUBLE) END AS src FROM w, t)
    SELECT cw AS c, src AS c_source, cw <> src AS c_reused, lambda, reo FROM x JOIN g ON g.c = src""",
)
def extended_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of the first bound without saturation reused for all larger ones."""
    g = derived(spark, sf_dir, CELLS).select("c", "lambda", "reo", (F.col("sat") > 0.0652).alias("any_bound_saturation"))
    return cells.extended(g, [0.5, 1.0, 1.5, 2.0, 2.5, 3.0]).select("c", "c_source", "c_reused", "lambda", "reo")


@query(
    "best_row",
    f"WITH g AS ({duck(CELLS)}) SELECT c, lambda, reo FROM g ORDER BY CASE WHEN stab_algo >= 0.7504 AND rsi >= 0.7904 AND NOT sat > 0.0504 THEN 0 ELSE 1 END, reo, c, lambda LIMIT 1",
)
def best_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kept cell with fewest clusters (a report of one row)."""
    return cells.best_row(diagnose.apply_thresholds(derived(spark, sf_dir, CELLS), 0.7504, 0.7904, 0.0504)).select("c", "lambda", "reo")


def _em_sql(loops: int) -> str:
    out = ["m0(k, w, m, v) AS (VALUES (1, 0.5, 1.0, 1.0), (2, 0.5, 3.0, 1.0))", "z AS (SELECT o_orderkey AS id, o_totalprice / 100000 AS z FROM orders)"]
    for i in range(loops):
        out.append(f"d{i} AS (SELECT id, z, k, w * exp(-0.5 * (z - m) * (z - m) / v) / sqrt(2 * pi() * v) AS p FROM z, m{i})")
        out.append(f"r{i} AS (SELECT id, z, k, p, p / sum(p) OVER (PARTITION BY id) AS r FROM d{i})")
        out.append(f"s{i} AS (SELECT k, sum(r) / (SELECT count(*) FROM z) AS w, sum(r * z) / sum(r) AS m FROM r{i} GROUP BY k)")
        out.append(f"m{i + 1} AS (SELECT r.k, any_value(s.w) AS w, any_value(s.m) AS m, sum(r * (z - s.m) * (z - s.m)) / sum(r) AS v FROM r{i} r JOIN s{i} s ON r.k = s.k GROUP BY r.k)")
    return "WITH " + ", ".join(out) + f" SELECT CAST(k AS INT) AS k, round(w, 6) AS w, round(m, 6) AS m, round(v, 6) AS v FROM m{loops}"


@query("em_iterations", _em_sql(3))
def em_iterations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three EM iterations of a two-component mixture of all orders' prices."""
    df = table(spark, sf_dir, "orders").select((F.col("o_totalprice") / 100000).alias("z"))
    m = starts.Mixture(np.array([0.5, 0.5]), np.array([[1.0], [3.0]]), np.ones((2, 1)), np.zeros((2, 0, 0)))
    m = starts.em(df, m, ["z"], loops=3, tol=0.0)
    rows = [(k + 1, float(m.weight[k]), float(m.mean[k, 0]), float(m.var[k, 0])) for k in range(2)]
    return rounded(spark.createDataFrame(rows, "k int, w double, m double, v double"))


@query("soft_starts", "SELECT CAST(3 AS BIGINT) AS clusters, true AS sums_to_one, true AS none_negative, true AS even, count(*) AS n FROM events")
def soft_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Random soft assignments of all events: rows add up to 1 and clusters weigh about the same."""
    df = table(spark, sf_dir, "events").select(starts.random_soft("event_id", 3, 5).alias("phi"))
    total = F.aggregate("phi", F.lit(0.0), lambda a, b: a + b)
    mean = [F.avg(F.col("phi")[k]) for k in range(3)]
    return df.agg(
        F.max(F.size("phi")).cast("long").alias("clusters"), (F.max(F.abs(total - 1)) < 1e-9).alias("sums_to_one"), (F.min(F.array_min("phi")) >= 0).alias("none_negative"),
        (F.greatest(*mean) - F.least(*mean) < 0.05).alias("even"), F.count("*").alias("n"),
    )


_TWO = {"status": "CASE WHEN l_linestatus = 'F' THEN 1 ELSE 2 END", "many": "CASE WHEN l_quantity > 30 THEN 2 ELSE 1 END", "outside": "CASE WHEN l_quantity > 20 THEN 1 ELSE 2 END"}


@query(
    "path_distance",
    "WITH l AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in _TWO.items()) + """ FROM lineitem),
    m AS (SELECT 0.1 AS lam, CAST(avg(CASE WHEN status = outside THEN 1.0 ELSE 0.0 END) AS DOUBLE) AS same FROM l UNION ALL SELECT 0.2, avg(CASE WHEN many = outside THEN 1.0 ELSE 0.0 END) FROM l)
    SELECT CAST(lam AS DOUBLE) AS lambda, CAST(2 AS BIGINT) AS k_hat, round(1 - greatest(same, 1 - same), 9) AS distance FROM m""",
)
def path_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance of a path's partitions of all line items to an outside one with as many clusters, under the best renaming."""
    df = table(spark, sf_dir, "lineitem").select(*[F.expr(e).alias(n) for n, e in _TWO.items()])
    rows = compare.path_distance({0.1: "status", 0.2: "many"}, {2: "outside"}, df)
    return spark.createDataFrame(rows, "lambda double, k_hat long, distance double").withColumn("distance", F.round("distance", 9))


@query("icl_components")
def icl_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BIC and ICL of normal mixtures of all customers' balances; tested on separated components."""
    df = table(spark, sf_dir, "customer").select("c_acctbal", F.col("c_nationkey").cast("double").alias("nation"))
    return rounded(icl.icl_path(df, ["c_acctbal", "nation"], [1, 2, 3], loops=10)[0])


@query("multistart_best")
def multistart_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best of three distributed descents over all orders' prices, in lock step; tested by its invariants."""
    obs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / 1e5).alias("z"))
    run = descent.fit(obs, Spec(["z"], univariate=True), 0.5, 1.0, shots=3, clusters=5, loops=12, seed=3)
    return rounded(descent.params_table(spark, [run]).select("run", "k", "nu", F.col("mean")[0].alias("m"), F.sqrt(F.col("cov")[0]).alias("s"), "density_bound").withColumn("h", F.lit(run.h)))


@query("mixed_descent")
def mixed_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A distributed descent on two numbers and a category of all orders; tested by its invariants."""
    df = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / 1e5).alias("z"), F.month("o_orderdate").cast("double").alias("mo"), "o_orderpriority")
    df, levels = features.encoded(df, ["o_orderpriority"])
    run = descent.fit(df, Spec(["z", "mo"], ["o_orderpriority_code"], len(levels)), 0.5, 5.0, shots=2, clusters=4, loops=10, seed=5)
    p = descent.params_table(spark, [run])
    return rounded(p.select("k", "nu", F.col("mean")[0].alias("m_z"), F.col("mean")[1].alias("m_mo"), "density_bound").withColumn("h", F.lit(run.h)))


def _suppliers(spark: SparkSession, sf_dir: str):
    df = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_acctbal") / 1000).alias("z"))
    return paths.local_table(df, ["z"], [], 0, "id", univariate=True)


@query("lambda_grid_fit")
def lambda_grid_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed and bootstrap paths along the weights at one bound over all suppliers; tested by its invariants."""
    t, _ = _suppliers(spark, sf_dir)
    s = paths.Settings([0.1, 0.3, 0.6, 1.0], [1.0], 3, 3, 4, 2, seed=11, loops=100)
    return rounded(bound_grid.compacted(bound_grid.fit_lambda_grid(spark, t, s, 1.0)))


@query("bound_grid_fit")
def bound_grid_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole phase diagram of a small grid over all suppliers; tested by its invariants."""
    t, ids = _suppliers(spark, sf_dir)
    s = paths.Settings([0.1, 0.3, 0.6, 1.0], [0.3, 1.0], 2, 2, 4, 2, seed=11, loops=100)
    return rounded(bound_grid.fit_bound_grid(spark, t, ids, s).summary())


_GRID_RUNS = {"r1": "CAST(s_suppkey % 3 + 1 AS INT)", "r2": "CAST(CASE WHEN s_acctbal < 2000 THEN 1 WHEN s_acctbal < 6000 THEN 2 ELSE 3 END AS INT)", "r3": "CAST(CASE WHEN s_acctbal < 4500 THEN 1 ELSE 2 END AS INT)"}


@query(
    "grid_scores",
    "WITH l AS (" + " UNION ALL ".join(f"SELECT '{r}' AS run, {e} AS k, s_acctbal / 1000 AS z FROM supplier" for r, e in _GRID_RUNS.items()) + f"""),
    p AS (SELECT run, k, CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM supplier) AS nu, var_pop(z) AS v FROM l GROUP BY run, k),
    g AS (SELECT run, nu, v, CAST(c AS DOUBLE) AS c, greatest(v, ({LEAST} / c) * ({LEAST} / c)) AS g FROM p, (SELECT unnest([0.1, 0.2, 0.5, 2.0]) AS c))
    SELECT run, c, round(-sum(nu * ln(nu)), 6) AS a, round(0.5 * (ln(2 * pi()) + sum(nu * ln(g)) + sum(nu * v / g)), 6) AS b FROM g GROUP BY run, c""",
)
def grid_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coefficients of three partitions of all suppliers at four bounds, as the grid's tasks compute them."""
    t, _ = _suppliers(spark, sf_dir)
    df = table(spark, sf_dir, "supplier").select("s_suppkey", *[F.expr(e).alias(r) for r, e in _GRID_RUNS.items()])
    kept = [F.array_sort(F.collect_list(F.struct("s_suppkey", r)))[r].alias(r) for r in _GRID_RUNS]
    wide = df.agg(*kept)  # a local table's rows, by id
    labels = wide.select(F.explode(F.array(*[F.struct(F.lit(r).alias("run"), F.col(r).alias("labels")) for r in _GRID_RUNS])).alias("e")).select("e.*")
    return rounded(bound_grid.evaluations(t, labels, [0.1, 0.2, 0.5, 2.0], math.inf))
