"""Queries: hide-one-field explanations (linear scorer with an oracle; forest rows-only)."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.encoders import MedianImputer
from ..operators.explain import explain, linear_scorer
from .registry import register
from .tables import r6, table

# Fixed values for this binding: the linear scorer's weights (in summation order).
WEIGHTS = {"x": 2.0, "y": 1.0, "z": -3.0, "w": 0.5}
FIELDS = list(WEIGHTS)
TOP_N = 2


def order_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey",
                    (F.col("o_totalprice") / 1e4).alias("x"),
                    (F.col("o_custkey") / 1000.0).alias("y"),
                    (F.dayofmonth("o_orderdate") / 10.0).alias("z"),
                    F.when(F.col("o_orderstatus") != "P", F.month("o_orderdate") / 12.0).alias("w"))


_FIELDS_SQL = """SELECT o_orderkey, o_totalprice / 1e4::DOUBLE AS x, o_custkey / 1000::DOUBLE AS y,
       dayofmonth(o_orderdate) / 10::DOUBLE AS z,
       CASE WHEN o_orderstatus <> 'P' THEN month(o_orderdate) / 12::DOUBLE END AS w FROM orders"""


def _score_sql(sub: dict[str, str]) -> str:
    expr = "0.0::DOUBLE"
    for f, wgt in WEIGHTS.items():
        expr = f"({expr} + {wgt}::DOUBLE * {sub.get(f, f'coalesce({f}, m.m_{f})')})"
    return expr


_VARIANTS = " UNION ALL ".join(
    f"SELECT o_orderkey, '{f}' AS feature, {i} AS ord, {f} AS cur, "
    f"{_score_sql({f: f'm.m_{f}'})} AS p FROM b CROSS JOIN m" for i, f in enumerate(FIELDS))

EXPLAIN_SQL = f"""
WITH b AS ({_FIELDS_SQL}),
m AS (SELECT {", ".join(f"quantile_cont({f}, 0.5) AS m_{f}" for f in FIELDS)} FROM b),
base AS (SELECT o_orderkey, {_score_sql({})} AS current_log FROM b CROSS JOIN m),
v AS ({_VARIANTS}),
r AS (SELECT v.*, base.current_log, base.current_log - v.p AS delta_log, abs(base.current_log - v.p) AS imp,
             row_number() OVER (PARTITION BY v.o_orderkey ORDER BY abs(base.current_log - v.p) DESC, v.ord) AS rank
      FROM v JOIN base USING (o_orderkey)),
t AS (SELECT *, sum(imp) OVER (PARTITION BY o_orderkey) AS all_t,
             sum(CASE WHEN rank <= {TOP_N} THEN imp END) OVER (PARTITION BY o_orderkey) AS top_t,
             count(CASE WHEN rank <= {TOP_N} THEN 1 END) OVER (PARTITION BY o_orderkey) AS top_c FROM r)
SELECT o_orderkey, feature, round(cur, 6) AS current_value, round(p, 6) AS pred_log_without_feature,
       round(delta_log, 6) AS delta_log, round(imp, 6) AS impact_log_abs,
       CASE WHEN delta_log >= 0 THEN 'increases' ELSE 'decreases' END AS direction,
       CAST(rank AS INTEGER) AS rank,
       round(CASE WHEN top_t > 0 THEN imp / top_t * 100.0 ELSE 0.0 END, 6) AS share_top_percent,
       round(CASE WHEN all_t > 0 THEN imp / all_t * 100.0 ELSE 0.0 END, 6) AS share_all_percent,
       round(current_log, 6) AS current_log, CAST(top_c AS INTEGER) AS top_driver_count,
       round(CASE WHEN all_t > 0 THEN top_t / all_t * 100.0 ELSE 0.0 END, 6) AS coverage_percent,
       round(all_t, 6) AS total_impact_log_abs
FROM t WHERE rank <= {TOP_N}
"""


@register("explain_topk", EXPLAIN_SQL)
def q_explain_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-2 drivers per order: each of four fields hidden in turn (falls back to its
    exact median in a linear scorer), changes ranked and shared."""
    df = order_fields(spark, sf_dir)
    med = MedianImputer(FIELDS, add_indicator=False).fit(df).medians
    out = explain(df, "o_orderkey", FIELDS, linear_scorer(WEIGHTS, med), top_n=TOP_N)
    dbl = ["pred_log_without_feature", "delta_log", "impact_log_abs", "share_top_percent",
           "share_all_percent", "current_log", "coverage_percent", "total_impact_log_abs"]
    return out.select("o_orderkey", "feature", r6(F.col("current_value").cast("double")).alias("current_value"),
                      *[r6(c).alias(c) if c in dbl else F.col(c) for c in
                        ["pred_log_without_feature", "delta_log", "impact_log_abs", "direction", "rank",
                         "share_top_percent", "share_all_percent", "current_log", "top_driver_count",
                         "coverage_percent", "total_impact_log_abs"]])
