"""Queries: cleaning, canonical spellings, numbers, schema operators, derived features."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import NUMBER_PATTERN, format_g, parse_number, parse_user_number
from ..functions.text import clean_text, is_missing, match_key
from ..operators.canonical import canonicalize, canonicalize_all
from ..operators.dictionaries import DEVICE_DICTIONARIES
from ..operators.features import FEATURE_NAMES, add_features
from ..operators.repair import null_unless_contains, repair_swapped
from ..operators.schema import (align_columns, all_null_columns, apply_names, drop_columns,
                                drop_empty_rows, parse_ratios, rename_map)
from ..functions.text import MISSING_TOKENS
from ..roles import ALIASES, CATEGORICAL
from . import bindings as B
from .registry import register
from .tables import r6, table

# ---------------------------------------------------------------- SQL snippets
_TOKENS = ", ".join("'" + t.replace("'", "''") + "'" for t in MISSING_TOKENS)


def s_strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def s_missing(x: str) -> str:
    return f"({x} IS NULL OR lower({s_strip(x)}) IN ({_TOKENS}))"


def s_clean(x: str) -> str:
    return f"(CASE WHEN {s_missing(x)} THEN NULL ELSE regexp_replace({s_strip(x)}, '\\s+', ' ', 'g') END)"


def s_key(x: str) -> str:
    return f"regexp_replace(lower({s_strip(x)}), '[^a-z0-9]+', '', 'g')"


def s_num(x: str) -> str:
    v = f"TRY_CAST({s_strip(x)} AS DOUBLE)"
    return (f"(CASE WHEN regexp_matches({x}, '{NUMBER_PATTERN}') AND NOT isinf({v}) "
            f"THEN {v} END)")


def s_canonical(x: str, mapping: dict | None, replace_to: str | None) -> str:
    cleaned = s_clean(x)
    fb = cleaned if replace_to is None else f"replace({cleaned}, '_', '{replace_to}')"
    if not mapping:
        return fb
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items())
    return f"(CASE WHEN {cleaned} IS NULL THEN NULL ELSE (CASE {s_key(cleaned)} {whens} ELSE {fb} END) END)"


# ---------------------------------------------------------------- canonicalisation
# Fixed values for this binding: spellings of the order priorities.
PRIORITY_DICT = {"1urgent": "Urgent", "2high": "High", "3medium": "Medium"}
_PRI_CASE = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in PRIORITY_DICT.items())
_PRI_CLEAN = s_clean("o_orderpriority")


@register("canonicalize", f"""
SELECT o_orderkey, o_orderpriority, {s_key('o_orderpriority')} AS priority_key,
       CASE WHEN {_PRI_CLEAN} IS NULL THEN NULL
            ELSE (CASE {s_key(_PRI_CLEAN)} {_PRI_CASE} ELSE replace({_PRI_CLEAN}, '-', ' ') END) END AS priority,
       CASE WHEN {_PRI_CLEAN} IS NULL THEN NULL
            ELSE (CASE {s_key(_PRI_CLEAN)} {_PRI_CASE} ELSE replace({_PRI_CLEAN}, '-', ' ') END) END AS priority_joined
FROM orders
""")
def q_canonicalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order priorities through a spelling dictionary, fallback '-' -> ' ', once with a
    literal map and once with a dictionary table joined on the match key."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    o = o.withColumn("priority_key", match_key(F.col("o_orderpriority")))
    o = canonicalize(o, "o_orderpriority", PRIORITY_DICT, replace_to=" ", replace_from="-", output="priority")
    dic = spark.createDataFrame(list(PRIORITY_DICT.items()), "key string, canonical string")
    return canonicalize(o, "o_orderpriority", dic, replace_to=" ", replace_from="-", output="priority_joined")


_DEV_COLS = [c for c in CATEGORICAL if c != "Paper_ID"]


# The stand-in's spellings: the dictionaries' own keys, picked by the order key, in upper
# case, with a stray sign, or as they are; every eleventh order keeps a table value
_SPELLINGS = {c: sorted(DEVICE_DICTIONARIES[c][0] or {}) for c in _DEV_COLS}


def _spelled_sql(col: str, table_value: str) -> str:
    keys = _SPELLINGS[col]
    if not keys:
        return table_value
    key = "[" + ", ".join(f"'{k}'" for k in keys) + f"][CAST(o_orderkey % {len(keys)} AS INTEGER) + 1]"
    return (f"CASE WHEN o_orderkey % 11 = 0 THEN {table_value} WHEN o_custkey % 3 = 0 THEN upper({key}) "
            f"WHEN o_custkey % 3 = 1 THEN ' ' || {key} || '- ' ELSE {key} END")


_TABLE_VALUES = {
    "Channel": "c_mktsegment", "Solvent": "split_part(o_orderpriority, '-', -1)",
    "Process": "CASE o_orderstatus WHEN 'O' THEN 'spin_coat' WHEN 'F' THEN 'Drop casting' ELSE 'N/A' END",
    "Ion_type": "'ion_' || o_orderstatus",
    "polymer": "CASE WHEN o_orderkey % 7 = 0 THEN CAST(round(o_totalprice / 1e6, 3) AS VARCHAR) ELSE lower(c_mktsegment) END",
    "Cation": "'[' || substr(c_mktsegment, 1, 3) || ']+'", "Anion": "o_orderstatus || '-'",
    "Electrode_type": "split_part(c_mktsegment, 'I', 1)"}


@register("canonicalize_device", "SELECT o.o_orderkey, " + ", ".join(
    f"{s_canonical(c, *DEVICE_DICTIONARIES[c])} AS {c}" for c in _DEV_COLS) + " FROM (SELECT o_orderkey, " + ", ".join(
    f"{_spelled_sql(c, _TABLE_VALUES[c])} AS {c}" for c in _DEV_COLS) + """
FROM orders LEFT JOIN customer ON o_custkey = c_custkey) o
""")
def q_canonicalize_device(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight fixed spelling dictionaries with their fallbacks, on an
    experiment-shaped projection of orders x customer whose spellings meet every one."""
    ex = B.experiments_from_orders(spark, sf_dir).select("o_orderkey", F.col("Paper_ID").cast("long").alias("o_custkey"), *_DEV_COLS)
    for c in _DEV_COLS:
        if keys := _SPELLINGS[c]:
            key = F.get(F.array(*[F.lit(k) for k in keys]), (F.col("o_orderkey") % len(keys)).cast("int"))
            ex = ex.withColumn(c, F.when(F.col("o_orderkey") % 11 == 0, F.col(c)).when(F.col("o_custkey") % 3 == 0, F.upper(key))
                               .when(F.col("o_custkey") % 3 == 1, F.concat(F.lit(" "), key, F.lit("- "))).otherwise(key))
    return canonicalize_all(ex.drop("o_custkey"), _DEV_COLS)


# ---------------------------------------------------------------- missing tokens
@register("missing_tokens", f"""
SELECT o_orderkey, split_part(o_orderpriority, '-', -1) AS token,
       {s_missing("split_part(o_orderpriority, '-', -1)")} AS is_missing,
       {s_clean("split_part(o_orderpriority, '-', -1)")} AS cleaned
FROM orders
""")
def q_missing_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing-token test and text cleaning on the words after the priority number."""
    o = table(spark, sf_dir, "orders")
    tok = F.substring_index(F.col("o_orderpriority"), "-", -1)
    return o.select("o_orderkey", tok.alias("token"), is_missing(tok).alias("is_missing"),
                    clean_text(tok).alias("cleaned"))


# ---------------------------------------------------------------- numbers
@register("numeric_coerce", f"""
SELECT event_id,
       {s_num("json_extract_string(props, '$.k')")} AS k,
       {s_num('event_type')} AS type_num,
       {s_num('CAST(value AS VARCHAR)')} AS value_num
FROM events
""")
def q_numeric_coerce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Guarded text -> number coercion (JSON field, a label column, printed doubles)."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", parse_number(F.get_json_object("props", "$.k")).alias("k"),
                    parse_number(F.col("event_type")).alias("type_num"),
                    parse_number(F.col("value").cast("string")).alias("value_num"))


_RATIO_COLS = {
    "o_orderpriority": "o_orderpriority",
    "o_orderstatus": "o_orderstatus",
    "price_txt": "CAST(o_totalprice AS VARCHAR)",
    "mixed": "CASE WHEN o_orderkey % 4 = 0 THEN o_orderstatus ELSE CAST(o_custkey AS VARCHAR) END",
}


@register("parse_ratio", " UNION ALL ".join(
    f"""SELECT '{name}' AS column, count({expr}) AS present, count({s_num(expr)}) AS numeric,
        round(count({s_num(expr)}) / count({expr}), 6) AS ratio,
        CASE WHEN count({s_num(expr)}) / count({expr}) >= 0.7 THEN 'double' ELSE 'string' END AS decided
    FROM orders""" for name, expr in _RATIO_COLS.items()))
def q_parse_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of values that parse as numbers per text column, and the 70 % type rule."""
    o = table(spark, sf_dir, "orders").select(
        "o_orderpriority", "o_orderstatus", F.col("o_totalprice").cast("string").alias("price_txt"),
        F.when(F.col("o_orderkey") % 4 == 0, F.col("o_orderstatus"))
         .otherwise(F.col("o_custkey").cast("string")).alias("mixed"))
    r = parse_ratios(o, list(_RATIO_COLS))
    return r.select("column", "present", "numeric", r6("ratio").alias("ratio"),
                    F.when(F.col("ratio") >= 0.7, "double").otherwise("string").alias("decided"))


@register("user_numbers", f"""
WITH s AS (SELECT o_orderkey, ' ' || format('{{:,.2f}}', o_totalprice) || ' ' AS r1, o_orderpriority AS r2,
                  CASE WHEN o_orderstatus = 'P' THEN '   ' ELSE CAST(o_custkey AS VARCHAR) END AS r3 FROM orders),
p AS (SELECT o_orderkey, replace({s_strip('r1')}, ',', '') AS t1, replace({s_strip('r2')}, ',', '') AS t2,
             replace({s_strip('r3')}, ',', '') AS t3 FROM s)
SELECT o_orderkey,
       {s_num('t1')} AS v1, (t1 <> '' AND {s_num('t1')} IS NULL) AS v1_invalid,
       {s_num('t2')} AS v2, (t2 <> '' AND {s_num('t2')} IS NULL) AS v2_invalid,
       {s_num('t3')} AS v3, (t3 <> '' AND {s_num('t3')} IS NULL) AS v3_invalid
FROM p
""")
def q_user_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form-number parsing: thousands commas dropped, blank -> NULL, other text flagged invalid."""
    o = table(spark, sf_dir, "orders")
    r1 = F.concat(F.lit(" "), F.format_number("o_totalprice", 2), F.lit(" "))
    r3 = F.when(F.col("o_orderstatus") == "P", F.lit("   ")).otherwise(F.col("o_custkey").cast("string"))
    cols = []
    for name, raw in (("v1", r1), ("v2", F.col("o_orderpriority")), ("v3", r3)):
        v, bad = parse_user_number(raw)
        cols += [v.alias(name), bad.alias(f"{name}_invalid")]
    return o.select("o_orderkey", *cols)


@register("format_values", """
SELECT o_orderkey, format('{:,.4g}', o_totalprice) AS price_txt,
       format('{:,.4g}', o_totalprice / 1e7) AS small_txt,
       format('{:,.4g}', CAST(o_custkey AS DOUBLE) * 1e5) AS big_txt,
       CASE WHEN o_orderstatus = 'P' THEN 'Not specified' ELSE format('{:,.4g}', o_totalprice / 100) END AS maybe_txt
FROM orders
""")
def q_format_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Display text of numbers: 4 significant digits, thousands separators,
    scientific notation outside [1e-4, 1e4), 'Not specified' for missing."""
    o = table(spark, sf_dir, "orders")
    maybe = F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice") / 100)
    return o.select("o_orderkey", format_g(F.col("o_totalprice")).alias("price_txt"),
                    format_g(F.col("o_totalprice") / 1e7).alias("small_txt"),
                    format_g(F.col("o_custkey").cast("double") * 1e5).alias("big_txt"),
                    format_g(maybe).alias("maybe_txt"))


# ---------------------------------------------------------------- row repairs
_A = "CASE p_partkey % 4 WHEN 0 THEN p_type WHEN 2 THEN NULL ELSE CAST(p_size AS VARCHAR) END"
_B = ("CASE p_partkey % 4 WHEN 0 THEN CAST(p_size AS VARCHAR) WHEN 1 THEN p_name "
      "ELSE CAST(p_retailprice AS VARCHAR) END")


@register("swap_repair", f"""
WITH s AS (SELECT p_partkey, {_A} AS a, {_B} AS b FROM part),
n AS (SELECT *, {s_num('a')} AS an, {s_num('b')} AS bn FROM s),
w AS (SELECT *, (a IS NOT NULL AND an IS NULL AND b IS NOT NULL AND bn IS NOT NULL) AS sw FROM n),
s1 AS (SELECT p_partkey, CASE WHEN sw THEN bn ELSE an END AS a1n, CASE WHEN sw THEN a ELSE b END AS b1,
              CASE WHEN sw THEN NULL ELSE bn END AS b1n FROM w)
SELECT p_partkey,
       CASE WHEN b1 IS NOT NULL AND b1n IS NOT NULL AND a1n IS NULL THEN b1n ELSE a1n END AS wt,
       CASE WHEN b1 IS NOT NULL AND b1n IS NOT NULL THEN NULL ELSE b1 END AS polymer
FROM s1
""")
def q_swap_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers typed into the text column (and text into the number column) repaired."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey") % 4
    a = (F.when(k == 0, F.col("p_type")).when(k == 2, F.lit(None).cast("string"))
         .otherwise(F.col("p_size").cast("string")))
    b = (F.when(k == 0, F.col("p_size").cast("string")).when(k == 1, F.col("p_name"))
         .otherwise(F.col("p_retailprice").cast("string")))
    s = p.select("p_partkey", a.alias("wt"), b.alias("polymer"))
    return repair_swapped(s, "wt", "polymer")


@register("null_unless", f"""
SELECT l_orderkey, l_linenumber, l_returnflag,
       CASE WHEN NOT {s_missing('l_returnflag')} AND contains(lower({s_strip('l_returnflag')}), 'r')
            THEN l_discount END AS l_discount
FROM lineitem
""")
def q_null_unless(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dependent value is kept only where its parent text applies (contains 'r')."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_discount")
    return null_unless_contains(li, "l_discount", "l_returnflag", "r")


# ---------------------------------------------------------------- schema operators
@register("drop_all_null", """
SELECT l_orderkey, l_linenumber, nullif(l_discount, 0.0) AS d, nullif(l_returnflag, 'N') AS f
FROM lineitem WHERE nullif(l_discount, 0.0) IS NOT NULL OR nullif(l_returnflag, 'N') IS NOT NULL
""")
def q_drop_all_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns without any value are dropped, then rows whose data columns are all empty."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.nullif(F.col("l_discount"), F.lit(0.0)).alias("d"),
        F.nullif(F.col("l_returnflag"), F.lit("N")).alias("f"),
        F.nullif(F.col("l_tax"), F.col("l_tax")).alias("z"))
    data = ["d", "f", "z"]
    empty = all_null_columns(li, data)
    kept = drop_columns(li, empty)
    return drop_empty_rows(kept, [c for c in data if c not in empty])


@register("align_columns", """
SELECT s_suppkey, s_name, CAST(NULL AS VARCHAR) AS s_phone, s_acctbal, CAST(NULL AS DOUBLE) AS s_rating
FROM supplier
""")
def q_align_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projection to a frozen feature list; absent columns arrive as typed NULLs."""
    s = table(spark, sf_dir, "supplier")
    return align_columns(s, ["s_suppkey", "s_name", "s_phone", "s_acctbal", "s_rating"],
                         {"s_phone": "string", "s_rating": "double"})


@register("column_names", """
SELECT l_orderkey AS Paper_ID, l_quantity AS Concentration_mg_ml, l_partkey AS Spin_RPM,
       l_discount AS Yield_percent, l_tax AS Gate_voltage_V, l_extendedprice AS Tau,
       l_linenumber AS Tau_ms
FROM lineitem
""")
def q_column_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messy headers normalised and mapped through the ordered alias rules."""
    li = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("Unnamed: 0"), F.col("l_quantity").alias("Concentration (mg/mL)"),
        F.col("l_partkey").alias(" Spin rpm "), F.col("l_discount").alias("Yield %"),
        F.col("l_tax").alias("Gate - voltage"), F.col("l_extendedprice").alias("Tau"),
        F.col("l_linenumber").alias("Tau_ms"))
    return apply_names(li, rename_map(li.columns, ALIASES))


# ---------------------------------------------------------------- derived features
def lineitem_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items projected onto the experiment's numeric inputs (typed doubles)."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        "l_orderkey", "l_linenumber",
        (F.col("l_discount") - 0.05).alias("Gate_voltage_V"),
        F.col("l_tax").alias("Drain_voltage_V"),
        (F.col("l_extendedprice") / 100).alias("Gate_pulse_width_ms"),
        F.col("l_quantity").alias("Pulse_number"),
        (F.col("l_linenumber") - 2).cast("double").alias("Concentration_mg_ml"),
        F.col("l_partkey").cast("double").alias("Spin_RPM"),
        F.col("l_suppkey").cast("double").alias("Annealing_temp_C"),
        (F.col("l_discount") * 10).alias("Annealing_time_h"),
        (F.col("l_tax") * 100).alias("Operating_temp_C"),
        (F.col("l_quantity") / 100).alias("Cation_radius"),
        F.col("l_discount").alias("Anion_radius"),
        (F.col("l_extendedprice") / 1000).alias("Ion_diffusion"),
        F.col("l_tax").alias("Ion_viscosity"),
        F.when(F.col("l_returnflag") == "R", "Spin-coating")
         .when(F.col("l_returnflag") == "A", "drop casting").alias("Process"))


_LC_SQL = """SELECT l_orderkey, l_linenumber, l_discount - 0.05 AS g, l_tax AS d, l_extendedprice / 100 AS w,
       l_quantity AS n, CAST(l_linenumber - 2 AS DOUBLE) AS conc, CAST(l_partkey AS DOUBLE) AS spin,
       CAST(l_suppkey AS DOUBLE) AS a_t, l_discount * 10 AS a_h, l_tax * 100 AS o_t, l_quantity / 100 AS cr,
       l_discount AS ar, l_extendedprice / 1000 AS diff, l_tax AS visc,
       CASE l_returnflag WHEN 'R' THEN 'Spin-coating' WHEN 'A' THEN 'drop casting' END AS process
FROM lineitem"""


def _clip(x: str) -> str:
    return f"(CASE WHEN {x} < 0 THEN 0.0 ELSE {x} END)"


def _fin(x: str) -> str:
    return f"(CASE WHEN isfinite({x}) THEN {x} END)"


_FEAT_SQL = {
    "abs_Gate_voltage_V": "abs(g)",
    "abs_Drain_voltage_V": "abs(d)",
    "voltage_difference_V": "abs(g - d)",
    "voltage_ratio": "abs(g) / (abs(d) + 1e-9)",
    "gate_pulse_dose": "abs(g) * w",
    "total_gate_dose": "abs(g) * w * n",
    "log1p_total_gate_dose": f"ln(1 + {_clip('abs(g) * w * n')})",
    "concentration_gate_dose": "conc * (abs(g) * w * n)",
    "log1p_concentration": f"ln(1 + {_clip('conc')})",
    "log1p_concentration_gate_dose": f"ln(1 + {_clip('conc * (abs(g) * w * n)')})",
    "radius_diff_abs": "abs(cr - ar)",
    "radius_sum": "cr + ar",
    "radius_ratio": "cr / (ar + 1e-9)",
    "diffusion_viscosity_ratio": "diff / (visc + 1e-9)",
    "ion_mobility_proxy": "diff / (visc + 1e-9)",
    "annealing_thermal_budget": "a_t * a_h",
    "log1p_annealing_time_h": f"ln(1 + {_clip('a_h')})",
    "Operating_temp_K": "o_t + 273.15",
    "Annealing_temp_K": "a_t + 273.15",
    "inv_Operating_temp_K": "1 / (o_t + 273.15 + 1e-9)",
    "inv_Annealing_temp_K": "1 / (a_t + 273.15 + 1e-9)",
    "spin_x_concentration": "spin * conc",
    "annealing_temp_x_time": "a_t * a_h",
    "gate_voltage_x_pulse_number": "abs(g) * n",
    "pulse_width_x_pulse_number": "w * n",
    "voltage_diff_x_pulse_number": "abs(g - d) * n",
    "is_spin_process": "CASE WHEN process IS NOT NULL AND contains(lower(process), 'spin') THEN 1.0 ELSE 0.0 END",
    "spin_rpm_effective": ("coalesce(spin, 0.0) * (CASE WHEN process IS NOT NULL AND "
                           "contains(lower(process), 'spin') THEN 1.0 ELSE 0.0 END)"),
    "log1p_spin_rpm_effective": ("ln(1 + " + _clip(
        "coalesce(spin, 0.0) * (CASE WHEN process IS NOT NULL AND contains(lower(process), 'spin') "
        "THEN 1.0 ELSE 0.0 END)") + ")"),
}


@register("engineered_features", "SELECT l_orderkey, l_linenumber, " + ", ".join(
    f"round(CAST({_fin(_FEAT_SQL[n])} AS DOUBLE), 6) AS {n}" for n in FEATURE_NAMES) + f" FROM ({_LC_SQL})")
def q_engineered_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 29 derived features over every line item."""
    out = add_features(lineitem_conditions(spark, sf_dir))
    return out.select("l_orderkey", "l_linenumber", *[r6(n).alias(n) for n in FEATURE_NAMES])
