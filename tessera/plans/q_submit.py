"""Queries: submission validation, payload, approved-row flattening, error analysis, stream."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import parse_number
from ..operators.keyed_table import KeyedTable
from ..operators.submissions import (assemble_payload, flatten_submissions, flatten_variants, submission_errors,
                                     validate_submissions)
from ..roles import MODEL_FAMILY
from ..session import shared_path
from .registry import register
from .tables import r6, table


def event_submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events read as form submissions: measured label typed as text, a confirm box,
    a review status, free text, and the inputs as JSON (``props``)."""
    e = table(spark, sf_dir, "events")
    tau_raw = (F.when(F.col("event_type") == "error", F.concat(F.col("value").cast("string"), F.lit(" ms")))
               .when(F.col("event_type") == "signup", F.format_number(F.col("value") * 100, 2))
               .otherwise((F.col("value") - 5).cast("string")))
    status = (F.when(F.col("event_type") == "purchase", "approved")
              .when(F.col("event_type") == "signup", "rejected").otherwise("pending"))
    return e.select(
        "event_id", "user_id", "event_type", "value", "props",
        tau_raw.alias("tau_raw"), (F.col("event_type") != "view").alias("confirmed"),
        status.alias("status"),
        F.when(F.col("event_type") == "click", F.lit("  ")).otherwise(F.col("event_type")).alias("notes"))


_SUB_SQL = """SELECT event_id, user_id, event_type, value, props,
  CASE WHEN event_type = 'error' THEN CAST(value AS VARCHAR) || ' ms'
       WHEN event_type = 'signup' THEN format('{:,.2f}', value * 100)
       ELSE CAST(value - 5 AS VARCHAR) END AS tau_raw,
  event_type <> 'view' AS confirmed,
  CASE event_type WHEN 'purchase' THEN 'approved' WHEN 'signup' THEN 'rejected' ELSE 'pending' END AS status,
  CASE WHEN event_type = 'click' THEN '  ' ELSE event_type END AS notes
FROM events"""

_NUM = "^\\s*[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?\\s*$"


def _parsed(x: str) -> str:
    t = f"replace(regexp_replace({x}, '^\\s+|\\s+$', '', 'g'), ',', '')"
    return f"(CASE WHEN regexp_matches({t}, '{_NUM}') THEN TRY_CAST({t} AS DOUBLE) END)"


@register("submission_validate", f"""
WITH s AS ({_SUB_SQL}),
p AS (SELECT *, {_parsed('tau_raw')} AS tau_ms,
             replace(regexp_replace(tau_raw, '^\\s+|\\s+$', '', 'g'), ',', '') AS t FROM s),
r AS (SELECT event_id, status, tau_ms,
  CASE WHEN t <> '' AND tau_ms IS NULL THEN 'invalid_number'
       WHEN tau_ms IS NULL OR tau_ms <= 0 THEN 'tau_not_positive'
       WHEN NOT confirmed THEN 'not_confirmed'
       WHEN status NOT IN ('pending', 'approved', 'rejected') THEN 'bad_status'
       WHEN status <> 'pending' THEN 'not_pending' END AS reject_reason FROM p)
SELECT event_id, status, tau_ms, reject_reason, reject_reason IS NULL AS accepted FROM r
""")
def q_submission_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label parses and is > 0, row confirmed, status allowed and pending."""
    v = validate_submissions(event_submissions(spark, sf_dir), status="status")
    return v.select("event_id", "status", "tau_ms", "reject_reason", "accepted")


_INPUTS = ["k", "user_id", "event_type", "seen"]


@register("submission_payload", f"""
WITH s AS ({_SUB_SQL}),
p AS (SELECT *, {_parsed('tau_raw')} AS tau_ms,
             CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM s)
SELECT CAST(event_id AS VARCHAR) AS id, 'pending' AS status, 'user_submission' AS source,
       nullif(regexp_replace(notes, '^\\s+|\\s+$', '', 'g'), '') AS notes, tau_ms,
       round(k * 5, 6) AS pred_tau_ms, round(ln(1 + k * 5), 6) AS pred_log1p_tau_ms,
       '{{"k":' || coalesce(CAST(k AS VARCHAR), 'null') || ',"user_id":' || coalesce(CAST(user_id AS VARCHAR), 'null')
         || ',"event_type":' || coalesce('"' || event_type || '"', 'null')
         || ',"seen":[' || coalesce(CAST(k AS VARCHAR), 'null') || ',null]}}' AS input_data,
       '{MODEL_FAMILY}' AS model_type,
       CAST((CASE WHEN k IS NULL THEN 0 ELSE 1 END) + (CASE WHEN user_id IS NULL THEN 0 ELSE 1 END)
          + (CASE WHEN event_type IS NULL OR regexp_replace(event_type, '^\\s+|\\s+$', '', 'g') = '' THEN 0 ELSE 1 END) + 1
          AS INTEGER) AS input_completeness_filled,
       CAST(4 AS INTEGER) AS input_completeness_total
FROM p
WHERE tau_ms IS NOT NULL AND tau_ms > 0 AND confirmed
""")
def q_submission_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted submissions as submission-table rows (defaults, blank text -> NULL,
    stored prediction, inputs JSON, completeness)."""
    s = event_submissions(spark, sf_dir).withColumn("k", parse_number(F.get_json_object("props", "$.k")))
    v = validate_submissions(s.drop("status"))
    ok = v.filter(F.col("accepted")).withColumns({
        "pred_tau_ms": F.col("k") * 5, "pred_log1p_tau_ms": F.log1p(F.col("k") * 5),
        "seen": F.array(F.col("k"), F.lit(float("nan")))})  # a nested value that JSON cannot hold
    pay = assemble_payload(ok, _INPUTS, id_col="event_id")
    return pay.select("id", "status", "source", "notes", "tau_ms", r6("pred_tau_ms").alias("pred_tau_ms"),
                      r6("pred_log1p_tau_ms").alias("pred_log1p_tau_ms"), "input_data", "model_type",
                      "input_completeness_filled", "input_completeness_total")


_IN_SCHEMA = T.StructType([T.StructField("k", T.DoubleType())])


@register("submission_flatten", f"""
WITH s AS ({_SUB_SQL})
SELECT CAST(event_id AS VARCHAR) AS row_key, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, value AS Tau_ms
FROM s WHERE event_type = 'view'
UNION ALL
SELECT 'submission-' || CAST(event_id AS VARCHAR) AS row_key, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k,
       value * 100 AS Tau_ms
FROM s WHERE status = 'approved'
""")
def q_submission_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approved submissions' JSON inputs expanded and appended to a training table."""
    s = event_submissions(spark, sf_dir)
    subs = s.select(F.col("event_id").cast("string").alias("id"), "status",
                    F.col("props").alias("input_data"), (F.col("value") * 100).alias("tau_ms"))
    training = s.filter(F.col("event_type") == "view").select(
        F.col("event_id").alias("row_key"),
        parse_number(F.get_json_object("props", "$.k")).alias("k"), F.col("value").alias("Tau_ms"))
    return flatten_submissions(subs, _IN_SCHEMA, "Tau_ms", training).select("row_key", "k", "Tau_ms")


@register("submission_variants", """
SELECT 'submission-' || CAST(event_id AS VARCHAR) AS row_key,
       CASE event_id % 3 WHEN 0 THEN CAST(json_extract_string(props, '$.k') AS DOUBLE) WHEN 1 THEN CAST(user_id AS DOUBLE) END AS k,
       CASE WHEN event_id % 3 = 1 THEN CAST(event_id AS DOUBLE) END AS gate_v, CASE WHEN event_id % 3 = 1 THEN event_type END AS gate_mode,
       CASE WHEN event_id % 3 = 2 THEN CASE WHEN event_id % 2 = 0 THEN CAST(event_id AS VARCHAR) ELSE 't' || CAST(user_id AS VARCHAR) END END AS drift,
       value * 100 AS Tau_ms
FROM events WHERE event_type <> 'error'""")
def q_submission_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approved submissions whose JSON is nested, lacks fields and drifts in type, flattened
    by the schema found in them."""
    e, text = table(spark, sf_dir, "events"), lambda c: F.col(c).cast("string")
    nested = F.concat(F.lit('{"k": '), text("user_id"), F.lit(', "gate": {"v": '), text("event_id"), F.lit(', "mode": "'), "event_type", F.lit('"}}'))
    drift = F.concat(F.lit('{"drift": '), F.when(F.col("event_id") % 2 == 0, text("event_id")).otherwise(F.concat(F.lit('"t'), text("user_id"), F.lit('"'))), F.lit("}"))
    kind = F.col("event_id") % 3
    subs = e.select(text("event_id").alias("id"), F.when(F.col("event_type") != "error", "approved").otherwise("pending").alias("status"),
                    F.when(kind == 0, F.col("props")).when(kind == 1, nested).otherwise(drift).alias("input_data"), (F.col("value") * 100).alias("tau_ms"))
    return flatten_variants(subs).select("row_key", "k", "gate_v", "gate_mode", "drift", "Tau_ms")


@register("keyed_append", """
SELECT event_id, user_id, value, CASE WHEN event_id % 3 < 2 THEN 1 ELSE 2 END AS batch FROM events""")
def q_keyed_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two appends that share a third of the events, into a table keyed by the event: an id
    is added once, by the first."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    keyed = KeyedTable(spark, shared_path(spark, "keyed"), e.withColumn("batch", F.lit(1)).schema, "event_id")
    keyed.append(e.where("event_id % 3 < 2").withColumn("batch", F.lit(1)))
    keyed.append(e.where("event_id % 3 > 0").withColumn("batch", F.lit(2)))
    return keyed.read()


@register("submission_errors", f"""
WITH s AS ({_SUB_SQL}),
p AS (SELECT event_type AS model_type, status, ln(1 + value) AS y,
             ln(1 + CAST(json_extract_string(props, '$.k') AS DOUBLE) / 10) AS pred FROM s)
SELECT model_type, status, count(*) AS n,
       round(1 - sum((y - pred) * (y - pred)) / (var_pop(y) * count(y)), 6) AS r2_log,
       round(sqrt(avg((y - pred) * (y - pred))), 6) AS rmse_log,
       round(avg(abs(y - pred)), 6) AS mae_log
FROM p GROUP BY model_type, status
""")
def q_submission_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored prediction vs measured label (log1p space) per model type and status."""
    s = event_submissions(spark, sf_dir)
    sub = s.select(F.col("event_type").alias("model_type"), "status", F.col("value").alias("tau_ms"),
                   F.log1p(parse_number(F.get_json_object("props", "$.k")) / 10).alias("pred_log1p_tau_ms"))
    m = submission_errors(sub)
    return m.select("model_type", "status", "n", *[r6(c).alias(c) for c in ("r2_log", "rmse_log", "mae_log")])
