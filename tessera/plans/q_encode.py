"""Queries: folds, splits, category encoders, imputation, target quantiles, metrics."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.encoders import (CountFrequencyEncoder, KFoldTargetEncoder, MedianImputer,
                                  OrdinalEncoder)
from ..operators.metrics import regression_metrics
from ..operators.quantile_target import QuantileTarget
from ..operators.split import balanced_fold, exact_split, hash_fold, hash_split
from . import bindings as B
from .registry import register
from .sql import LI_KEY_TXT, LI_PARTS, OOF_FROM, OOF_SQL, OOF_WITH, h32
from .tables import r6, table

ENC_COLS = ["p_brand", "p_type"]
LI_KEY = ["l_orderkey", "l_linenumber"]

# fit rows for the encoders: hash-train side, and one brand held out so that the
# "unseen category" path runs when the fitted maps are applied to all rows
FIT_SQL = f"""fitrows AS (
  SELECT * FROM base WHERE {h32('split', LI_KEY_TXT)} / 4294967296.0 >= 0.2 AND p_brand <> 'Brand#1')"""


def _fit_rows(df: DataFrame) -> DataFrame:
    train, _ = hash_split(df, LI_KEY, 0.2, "split")
    return train.filter(F.col("p_brand") != "Brand#1")


# ------------------------------------------------------------------ out-of-fold TE
@register("target_encode_oof", OOF_SQL)
def target_encode_oof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold smoothed target mean (s=5, 5 hash folds) of brand and type on
    log1p(extended price), one row per line item."""
    df = hash_fold(B.lineitem_parts(spark, sf_dir), LI_KEY, 5, "fold", output="fold")
    enc = KFoldTargetEncoder(ENC_COLS, "y", smoothing=5.0, folds=5, fold_col="fold")
    out, _ = enc.fit_transform_oof(df)
    return out.select(*LI_KEY, "l_partkey", "p_brand", "p_type", "fold", r6("y").alias("y"),
                      r6("p_brand_te").alias("p_brand_te"), r6("p_type_te").alias("p_type_te"))


# ------------------------------------------------------------------ plain TE (fit -> apply)
@register("target_encode", f"""
WITH base AS ({LI_PARTS}), {FIT_SQL},
gm AS (SELECT avg(y) AS gm FROM fitrows),
mb AS (SELECT coalesce(p_brand, 'Missing') AS cat, (sum(y) + 5.0 * max(g.gm)) / (count(y) + 5.0) AS te
       FROM fitrows CROSS JOIN gm g GROUP BY 1),
mt AS (SELECT coalesce(p_type, 'Missing') AS cat, (sum(y) + 5.0 * max(g.gm)) / (count(y) + 5.0) AS te
       FROM fitrows CROSS JOIN gm g GROUP BY 1)
SELECT b.l_orderkey, b.l_linenumber, b.p_brand, b.p_type,
       round(coalesce(mb.te, g.gm), 6) AS p_brand_te, round(coalesce(mt.te, g.gm), 6) AS p_type_te
FROM base b CROSS JOIN gm g
LEFT JOIN mb ON coalesce(b.p_brand, 'Missing') = mb.cat
LEFT JOIN mt ON coalesce(b.p_type, 'Missing') = mt.cat
""")
def target_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smoothed target mean fitted on the train side (one brand held out), applied
    to every line item; unseen categories get the global mean."""
    df = B.lineitem_parts(spark, sf_dir)
    model = KFoldTargetEncoder(ENC_COLS, "y", smoothing=5.0).fit(_fit_rows(df))
    out = model.transform(df)
    return out.select(*LI_KEY, "p_brand", "p_type", r6("p_brand_te").alias("p_brand_te"),
                      r6("p_type_te").alias("p_type_te"))


# ------------------------------------------------------------------ count / frequency
@register("count_freq_encode", f"""
WITH base AS ({LI_PARTS}), {FIT_SQL},
n AS (SELECT count(*) AS n FROM fitrows),
cb AS (SELECT coalesce(p_brand, 'Missing') AS cat, count(*) AS c FROM fitrows GROUP BY 1),
ct AS (SELECT coalesce(p_type, 'Missing') AS cat, count(*) AS c FROM fitrows GROUP BY 1)
SELECT b.l_orderkey, b.l_linenumber, b.p_brand, b.p_type,
       CAST(coalesce(cb.c, 0) AS DOUBLE) AS p_brand_count,
       round(coalesce(cb.c / n.n, 0.0), 6) AS p_brand_freq,
       CAST(coalesce(ct.c, 0) AS DOUBLE) AS p_type_count,
       round(coalesce(ct.c / n.n, 0.0), 6) AS p_type_freq
FROM base b CROSS JOIN n
LEFT JOIN cb ON coalesce(b.p_brand, 'Missing') = cb.cat
LEFT JOIN ct ON coalesce(b.p_type, 'Missing') = ct.cat
""")
def count_freq_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category counts and frequencies fitted on the train side, applied to all rows
    (unseen -> 0)."""
    df = B.lineitem_parts(spark, sf_dir)
    model = CountFrequencyEncoder(ENC_COLS).fit(_fit_rows(df))
    out = model.transform(df)
    return out.select(*LI_KEY, "p_brand", "p_type", "p_brand_count", r6("p_brand_freq").alias("p_brand_freq"),
                      "p_type_count", r6("p_type_freq").alias("p_type_freq"))


# ------------------------------------------------------------------ ordinal
@register("ordinal_encode", f"""
WITH base AS ({LI_PARTS}), {FIT_SQL},
vb AS (SELECT cat, CAST(row_number() OVER (ORDER BY cat) - 1 AS DOUBLE) AS idx
       FROM (SELECT DISTINCT coalesce(p_brand, 'Missing') AS cat FROM fitrows)),
vt AS (SELECT cat, CAST(row_number() OVER (ORDER BY cat) - 1 AS DOUBLE) AS idx
       FROM (SELECT DISTINCT coalesce(p_type, 'Missing') AS cat FROM fitrows))
SELECT b.l_orderkey, b.l_linenumber, b.p_brand, b.p_type,
       coalesce(vb.idx, -1.0) AS p_brand_ord, coalesce(vt.idx, -1.0) AS p_type_ord
FROM base b
LEFT JOIN vb ON coalesce(b.p_brand, 'Missing') = vb.cat
LEFT JOIN vt ON coalesce(b.p_type, 'Missing') = vt.cat
""")
def ordinal_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index in the sorted vocabulary of the train side; unseen -> -1."""
    df = B.lineitem_parts(spark, sf_dir)
    model = OrdinalEncoder(ENC_COLS).fit(_fit_rows(df))
    return model.transform(df).select(*LI_KEY, "p_brand", "p_type", "p_brand_ord", "p_type_ord")


# ------------------------------------------------------------------ folds and split
@register("hash_fold", f"""
SELECT o_orderkey, CAST({h32('fold', 'CAST(o_orderkey AS VARCHAR)')} % 5 AS INTEGER) AS fold FROM orders
""")
def q_hash_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five folds from the order key hash."""
    return hash_fold(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 5)


@register("hash_split", f"""
SELECT o_orderkey, {h32('split', 'CAST(o_orderkey AS VARCHAR)')} / 4294967296.0 < 0.2 AS is_test FROM orders
""")
def q_hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """80/20 train/test flag from the order key hash."""
    return hash_split(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 0.2,
                      output="is_test")


_RANK = "row_number() OVER (ORDER BY {}, o_orderkey) - 1"


@register("balanced_fold", f"""
SELECT o_orderkey, CAST(({_RANK.format(h32('fold', 'CAST(o_orderkey AS VARCHAR)'))}) % 5 AS INTEGER) AS fold FROM orders
""")
def q_balanced_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five folds by the rank of the order key hash: sizes differ by one at most."""
    return balanced_fold(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 5)


@register("exact_split", f"""
SELECT o_orderkey, {_RANK.format(h32('split', 'CAST(o_orderkey AS VARCHAR)'))} < ceil(0.2 * (SELECT count(*) FROM orders)) AS is_test FROM orders
""")
def q_exact_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train/test flag by the rank of the order key hash: exactly a fifth are test rows."""
    return exact_split(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 0.2)


# ------------------------------------------------------------------ median imputation
@register("median_impute", """
WITH base AS (SELECT l_orderkey, l_linenumber, nullif(l_discount, 0.0) AS d, nullif(l_tax, 0.0) AS t FROM lineitem),
m AS (SELECT quantile_cont(d, 0.5) AS md, quantile_cont(t, 0.5) AS mt FROM base)
SELECT l_orderkey, l_linenumber, round(coalesce(d, m.md), 6) AS d, round(coalesce(t, m.mt), 6) AS t,
       CAST(d IS NULL AS DOUBLE) AS missingindicator_d,
       CAST(t IS NULL AS DOUBLE) AS missingindicator_t
FROM base CROSS JOIN m
""")
def median_impute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact medians fill the blanks; indicators flag the filled cells."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.nullif(F.col("l_discount"), F.lit(0.0)).alias("d"),
        F.nullif(F.col("l_tax"), F.lit(0.0)).alias("t"))
    model = MedianImputer(["d", "t"]).fit(li)
    out = model.transform(li)
    return out.select("l_orderkey", "l_linenumber", r6("d").alias("d"), r6("t").alias("t"),
                      "missingindicator_d", "missingindicator_t")


# ------------------------------------------------------------------ quantile normalisation
def _grid_sql(n: int = 200) -> str:
    probs = ", ".join(repr(i / (n - 1)) for i in range(n))
    return f"""
g0 AS (SELECT quantile_cont(o_totalprice, [{probs}]) AS q FROM orders),
g AS (SELECT i, q[i + 1] AS q, q[i + 2] AS q2, i / {n - 1}.0 AS r, (i + 1) / {n - 1}.0 AS r2
      FROM g0, range({n}) t(i)),
ends AS (SELECT min(q) AS qmin, max(q) AS qmax FROM g)"""


@register("quantile_uniform", f"""
WITH {_grid_sql()}
SELECT o.o_orderkey,
       round(CASE WHEN o.o_totalprice - 1e-7 < e.qmin THEN 0.0
                  WHEN o.o_totalprice + 1e-7 > e.qmax THEN 1.0
                  ELSE g.r + (o.o_totalprice - g.q) / (g.q2 - g.q) * (g.r2 - g.r) END, 6) AS u
FROM orders o CROSS JOIN ends e
LEFT JOIN g ON o.o_totalprice >= g.q AND o.o_totalprice < g.q2
""")
def quantile_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order totals mapped through their 200-point quantile grid to [0, 1]."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    model = QuantileTarget(200, "uniform").fit(o, "o_totalprice")
    return o.select("o_orderkey", r6(model.forward("o_totalprice")).alias("u"))


# Coefficients of a published rational approximation of the normal
# quantile (absolute error under 5e-9), as plain SQL arithmetic.
_A = (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239)
_B = (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0)
_C = (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
_D = (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0)


def _poly(cs, x: str) -> str:
    out = f"{cs[0]}::DOUBLE"
    for c in cs[1:]:
        out = f"({out} * {x} + {c}::DOUBLE)"
    return out


def _normal_sql(p: str) -> str:
    tail = lambda q: f"({_poly(_C, q)} / {_poly(_D, q)})"
    low, high, mid = f"sqrt(-2 * ln({p}))", f"sqrt(-2 * ln(1 - ({p})))", f"(({p}) - 0.5)"
    return (f"CASE WHEN {p} < 0.02425 THEN {tail(low)} WHEN {p} > 0.97575 THEN -{tail(high)} "
            f"ELSE {_poly(_A, f'({mid} * {mid})')} * {mid} / {_poly(_B, f'({mid} * {mid})')} END")


@register("quantile_normal", f"""
WITH {_grid_sql()},
u AS (SELECT o.o_orderkey, o.o_totalprice AS x,
             CASE WHEN o.o_totalprice - 1e-7 < e.qmin THEN 0.0
                  WHEN o.o_totalprice + 1e-7 > e.qmax THEN 1.0
                  ELSE g.r + (o.o_totalprice - g.q) / (g.q2 - g.q) * (g.r2 - g.r) END AS p
      FROM orders o CROSS JOIN ends e LEFT JOIN g ON o.o_totalprice >= g.q AND o.o_totalprice < g.q2)
SELECT o_orderkey, round(x, 6) AS x, round(x, 3) AS back,
       round(CASE WHEN p <= 1e-7 THEN -5.199337582 WHEN p >= 1 - 1e-7 THEN 5.199337582 ELSE {_normal_sql('p')} END, 4) AS z
FROM u
""")
def quantile_normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normal-output quantile transform of order totals and its inverse (round trip)."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    model = QuantileTarget(200, "normal").fit(o, "o_totalprice")
    z = o.withColumn("z", model.forward("o_totalprice"))
    return z.withColumn("back", model.inverse("z")).select(
        "o_orderkey", r6("o_totalprice").alias("x"), F.round("z", 4).alias("z"), F.round("back", 3).alias("back"))


# ------------------------------------------------------------------ metrics
@register("metrics", OOF_WITH + """,
scored AS (SELECT b.fold, b.y, coalesce(ob.te, g.gm) AS pred""" + OOF_FROM + """)
SELECT fold, count(*) AS n,
       round(1 - sum((y - pred) * (y - pred)) / (var_pop(y) * count(y)), 6) AS r2_log,
       round(sqrt(avg((y - pred) * (y - pred))), 6) AS rmse_log,
       round(avg(abs(y - pred)), 6) AS mae_log
FROM scored GROUP BY fold""")
def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R^2 / RMSE / MAE per fold of the out-of-fold brand encoding used as a
    prediction of log1p(price)."""
    df = hash_fold(B.lineitem_parts(spark, sf_dir), LI_KEY, 5, "fold", output="fold")
    out, _ = KFoldTargetEncoder(["p_brand"], "y", 5.0, 5, fold_col="fold").fit_transform_oof(df)
    m = regression_metrics(out, "y", "p_brand_te", by="fold")
    return m.select("fold", "n", r6("r2_log").alias("r2_log"), r6("rmse_log").alias("rmse_log"),
                    r6("mae_log").alias("mae_log"))

