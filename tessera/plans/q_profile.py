"""Queries: label floor, numeric/option profiles, range checks, completeness, defaults, units."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import clip0
from ..operators.profile import (completeness, fill_defaults, profile_numeric, profile_options,
                                 quantile_floor, range_check)
from .registry import register
from .tables import r6, table


@register("quantile_floor", """
WITH f AS (SELECT quantile_cont(o_totalprice, 0.01) AS floor FROM orders WHERE o_totalprice > 0)
SELECT o_orderkey, o_totalprice, round(f.floor, 6) AS floor
FROM orders CROSS JOIN f WHERE o_totalprice > 0 AND o_totalprice >= f.floor
""")
def q_quantile_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label must be > 0; then rows under the exact 1 % quantile are dropped."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").filter(F.col("o_totalprice") > 0)
    kept, floor = quantile_floor(o, "o_totalprice", 0.01)
    return kept.withColumn("floor", F.round(F.lit(floor), 6))


_PROF_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


# decimals at which float averages of either engine round alike (a mean of these columns
# can lie on an exact tie at 6)
_MEAN_DECIMALS = {"l_quantity": 5, "l_extendedprice": 3, "l_discount": 8, "l_tax": 8}


@register("profile_numeric", " UNION ALL ".join(
    f"""SELECT '{c}' AS column, round(min({c}), 6) AS min, round(max({c}), 6) AS max,
        round(quantile_cont({c}, 0.5), 6) AS median, round(avg({c}), {_MEAN_DECIMALS[c]}) AS mean FROM lineitem"""
    for c in _PROF_COLS))
def q_profile_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """min / max / exact median / mean per numeric column of line items."""
    p = profile_numeric(table(spark, sf_dir, "lineitem"), _PROF_COLS)
    mean = F.lit(None).cast("double")
    for c, n in _MEAN_DECIMALS.items():
        mean = F.when(F.col("column") == c, F.round("mean", n)).otherwise(mean)
    return p.select("column", *[r6(c).alias(c) for c in ("min", "max", "median")], mean.alias("mean"))


_OPT_COLS = ["p_brand", "p_type", "p_name"]


@register("profile_options", " UNION ALL ".join(
    f"SELECT DISTINCT '{c}' AS column, {c} AS value FROM part WHERE {c} IS NOT NULL" for c in _OPT_COLS))
def q_profile_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct non-missing values per text column of parts (long form)."""
    return profile_options(table(spark, sf_dir, "part"), _OPT_COLS)


_RANGE_COLS = ["o_totalprice", "order_year"]
_RANGE_SRC = "SELECT o_orderkey, o_orderstatus, o_totalprice, CAST(year(o_orderdate) AS DOUBLE) AS order_year FROM orders"


@register("range_check", f"""
WITH o AS ({_RANGE_SRC}),
tr AS (SELECT * FROM o WHERE order_year <= 1998),
prof AS ({" UNION ALL ".join(f"SELECT '{c}' AS col, min({c}) AS p_min, max({c}) AS p_max FROM tr" for c in _RANGE_COLS)}),
lv AS ({" UNION ALL ".join(f"SELECT o_orderkey, '{c}' AS col, CAST({c} AS DOUBLE) AS value FROM o" for c in _RANGE_COLS)})
SELECT lv.o_orderkey, lv.col AS "column", lv.value, prof.p_min, prof.p_max,
       format('{{}} is outside the training range ({{:g}} ~ {{:g}}).', CASE lv.col WHEN 'o_totalprice' THEN 'Total price' ELSE lv.col END, prof.p_min, prof.p_max) AS warning
FROM lv JOIN prof USING (col)
WHERE lv.value IS NOT NULL AND (lv.value < prof.p_min OR lv.value > prof.p_max)
""")
def q_range_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order values outside the ranges profiled on the orders up to 1998."""
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_orderstatus", "o_totalprice", F.year("o_orderdate").cast("double").alias("order_year"))
    prof = profile_numeric(o.filter(F.col("order_year") <= 1998), _RANGE_COLS)
    return range_check(o, "o_orderkey", _RANGE_COLS, prof, labels={"o_totalprice": "Total price"}).select(
        "o_orderkey", "column", "value", "p_min", "p_max", "warning")


@register("completeness", """
SELECT o_orderkey,
       CAST((CASE WHEN nullif(o_orderstatus, 'P') IS NULL THEN 0 ELSE 1 END)
          + (CASE WHEN o_totalprice IS NULL OR isnan(o_totalprice) THEN 0 ELSE 1 END)
          + (CASE WHEN o_orderpriority LIKE '4%' THEN 0 ELSE 1 END)
          + (CASE WHEN nullif(o_custkey % 10, 0) IS NULL THEN 0 ELSE 1 END) AS INTEGER) AS filled,
       CAST(4 AS INTEGER) AS total
FROM orders
""")
def q_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filled fields per order out of four (NULL, NaN and blank text are not filled)."""
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("status"),
        F.col("o_totalprice").alias("price"),
        F.when(F.col("o_orderpriority").startswith("4"), F.lit("  ")).otherwise(F.col("o_orderpriority")).alias("priority"),
        F.nullif(F.col("o_custkey") % 10, F.lit(0)).alias("cust_digit"))
    return completeness(o, ["status", "price", "priority", "cust_digit"]).select("o_orderkey", "filled", "total")


# Fixed values for this binding: numeric defaults and a category default.
_DEFAULTS = {"qty": 25.0}
_NO_MEDIAN = ["tax"]
_CAT_DEFAULTS = {"flag": "R", "status": "X"}


@register("fill_defaults", """
WITH b AS (SELECT l_orderkey, l_linenumber, nullif(l_quantity, 1.0) AS qty, nullif(l_discount, 0.0) AS disc,
                  nullif(l_tax, 0.0) AS tax, nullif(l_returnflag, 'N') AS flag, nullif(l_linestatus, 'O') AS status
           FROM lineitem),
m AS (SELECT quantile_cont(disc, 0.5) AS md FROM b)
SELECT l_orderkey, l_linenumber, coalesce(qty, 25.0) AS qty, round(coalesce(disc, m.md), 6) AS disc, tax,
       coalesce(flag, 'R') AS flag, status
FROM b CROSS JOIN m
""")
def q_fill_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing inputs: fixed default, else profile median (not for 'no median' fields);
    a category default only when it is a known option."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.nullif(F.col("l_quantity"), F.lit(1.0)).alias("qty"),
        F.nullif(F.col("l_discount"), F.lit(0.0)).alias("disc"), F.nullif(F.col("l_tax"), F.lit(0.0)).alias("tax"),
        F.nullif(F.col("l_returnflag"), F.lit("N")).alias("flag"),
        F.nullif(F.col("l_linestatus"), F.lit("O")).alias("status"))
    prof = profile_numeric(li, ["qty", "disc", "tax"])
    opts = profile_options(li, ["flag", "status"])
    out = fill_defaults(li, _DEFAULTS, prof, _NO_MEDIAN, _CAT_DEFAULTS, opts, ["qty", "disc", "tax"])
    return out.select("l_orderkey", "l_linenumber", "qty", r6("disc").alias("disc"), "tax", "flag", "status")


@register("unit_breakdown", """
WITH p AS (SELECT event_id, value / 100::DOUBLE AS pred_log FROM events),
t AS (SELECT event_id, pred_log, exp(pred_log) - 1 AS tau FROM p)
SELECT event_id, round(pred_log, 6) AS pred_log,
       round(CASE WHEN tau < 0 THEN 0.0 ELSE tau END, 6) AS milliseconds,
       round(CASE WHEN tau < 0 THEN 0.0 ELSE tau END / 1000.0, 6) AS seconds,
       round(CASE WHEN tau < 0 THEN 0.0 ELSE tau END / 1000.0 / 60.0, 6) AS minutes,
       round(CASE WHEN tau < 0 THEN 0.0 ELSE tau END / 1000.0 / 3600.0, 6) AS hours,
       round(CASE WHEN tau < 0 THEN 0.0 ELSE tau END / 1000.0 / 86400.0, 6) AS days
FROM t
""")
def q_unit_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Back-transform a log prediction (expm1), clamp at 0 for display, and break the
    milliseconds into seconds, minutes, hours and days."""
    from ..operators.model import unit_breakdown
    e = table(spark, sf_dir, "events").select("event_id", (F.col("value") / 100.0).alias("pred_log"))
    tau = clip0(F.expm1(F.col("pred_log")))
    out = unit_breakdown(e.withColumn("tau", tau), "tau")
    return out.select("event_id", r6("pred_log").alias("pred_log"),
                      *[r6(c).alias(c) for c in ("milliseconds", "seconds", "minutes", "hours", "days")])
