"""Submitted labelled rows: validation, payload assembly, append, review flattening, errors.

A submission carries the raw inputs of one condition plus a measured label. It is
validated (label parses, > 0, confirmed; status allowed; only 'pending' may be
inserted), turned into the submission-table row (defaults, JSON of the inputs,
completeness, stored prediction), appended to a status-partitioned table, and,
once approved, flattened back into training rows.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import finite, parse_user_number
from ..functions.text import blank_to_null
from ..roles import MODEL_FAMILY
from .keyed_table import KeyedTable
from .metrics import regression_metrics
from .profile import completeness
from .schema import quoted

# Statuses and columns of the submission table
STATUSES = ["pending", "approved", "rejected"]

SUBMISSION_SCHEMA = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("created_at", T.TimestampType(), False),
    T.StructField("status", T.StringType(), False),
    T.StructField("source", T.StringType(), False),
    T.StructField("submitter_name", T.StringType(), True),
    T.StructField("submitter_email", T.StringType(), True),
    T.StructField("organization", T.StringType(), True),
    T.StructField("source_reference", T.StringType(), True),
    T.StructField("notes", T.StringType(), True),
    T.StructField("tau_ms", T.DoubleType(), False),
    T.StructField("pred_tau_ms", T.DoubleType(), True),
    T.StructField("pred_log1p_tau_ms", T.DoubleType(), True),
    T.StructField("input_data", T.StringType(), False),
    T.StructField("input_completeness_filled", T.IntegerType(), True),
    T.StructField("input_completeness_total", T.IntegerType(), True),
    T.StructField("model_type", T.StringType(), True),
    T.StructField("review_comment", T.StringType(), True),
    T.StructField("reviewed_at", T.TimestampType(), True),
])

TEXT_FIELDS = ["submitter_name", "submitter_email", "organization", "source_reference", "notes"]


def validate_submissions(df: DataFrame, tau_raw: str = "tau_raw", confirmed: str = "confirmed",
                         status: str | None = None) -> DataFrame:
    """Adds ``tau_ms`` (parsed), ``reject_reason`` (first failed rule, NULL if none)
    and ``accepted``. Rules in order: invalid_number, tau_not_positive,
    not_confirmed, bad_status, not_pending (only pending rows may be inserted)."""
    value, invalid = parse_user_number(F.col(tau_raw))
    rules: list[tuple[Column, str]] = [
        (invalid, "invalid_number"),
        (value.isNull() | (value <= 0), "tau_not_positive"),
        (~F.coalesce(F.col(confirmed).cast("boolean"), F.lit(False)), "not_confirmed"),
    ]
    if status:
        st = F.coalesce(F.col(status), F.lit("pending"))
        rules += [(~st.isin(STATUSES), "bad_status"), (st != "pending", "not_pending")]
    reason = F.lit(None).cast("string")
    for cond, name in reversed(rules):
        reason = F.when(cond, F.lit(name)).otherwise(reason)
    return df.withColumns({"tau_ms": value, "reject_reason": reason}).withColumn(
        "accepted", F.col("reject_reason").isNull())


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantine) after ``validate_submissions``."""
    return df.filter(F.col("accepted")), df.filter(~F.col("accepted"))


def json_safe(col: Column, dtype: T.DataType) -> Column:
    """``col`` with non-finite numbers as NULL at every depth (arrays, maps, structs)."""
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return finite(col)
    if isinstance(dtype, T.ArrayType):
        return F.transform(col, lambda x: json_safe(x, dtype.elementType))
    if isinstance(dtype, T.MapType):
        return F.transform_values(col, lambda _, x: json_safe(x, dtype.valueType))
    if isinstance(dtype, T.StructType):
        return F.when(col.isNotNull(), F.struct(*[json_safe(col[f.name], f.dataType).alias(f.name) for f in dtype.fields]))
    return col


def inputs_json(df: DataFrame, input_cols: list[str]) -> Column:
    """JSON object of the raw inputs, nulls written out, non-finite numbers as null."""
    parts = [json_safe(F.col(quoted(c)), df.schema[c].dataType).alias(c) for c in input_cols]
    return F.to_json(F.struct(*parts), {"ignoreNullFields": "false"})


def assemble_payload(df: DataFrame, input_cols: list[str], id_col: str | None = None,
                     model_type: str = MODEL_FAMILY) -> DataFrame:
    """Submission-table rows (the table defaults filled in) from validated rows.

    Expects ``tau_ms`` and optional ``pred_tau_ms`` / ``pred_log1p_tau_ms`` and the
    text fields; missing ones become NULL. ``id`` is a random UUID unless ``id_col``.
    """
    filled = completeness(df, input_cols, "__filled", "__total")
    cols = {}
    for f in SUBMISSION_SCHEMA.fields:
        n = f.name
        if n == "id":
            cols[n] = F.col(id_col).cast("string") if id_col else F.expr("uuid()")
        elif n == "created_at":
            cols[n] = F.current_timestamp()
        elif n == "status":
            cols[n] = F.lit("pending")
        elif n == "source":
            cols[n] = F.lit("user_submission")
        elif n in TEXT_FIELDS:
            cols[n] = blank_to_null(F.col(n)) if n in df.columns else F.lit(None).cast("string")
        elif n == "input_data":
            cols[n] = inputs_json(df, input_cols)
        elif n == "input_completeness_filled":
            cols[n] = F.col("__filled")
        elif n == "input_completeness_total":
            cols[n] = F.col("__total")
        elif n == "model_type":
            cols[n] = F.lit(model_type)
        elif n in df.columns:
            cols[n] = F.col(n).cast(f.dataType)
        else:
            cols[n] = F.lit(None).cast(f.dataType)
    return filled.select(*[v.alias(k) for k, v in cols.items()])


def broken_rules(df: DataFrame) -> DataFrame:
    """Rows that the submission table's constraints refuse: a NULL in a required column,
    a label that is not > 0, or a status other than pending (the only one to insert)."""
    missing = F.lit(False)
    for f in SUBMISSION_SCHEMA.fields:
        if not f.nullable:
            missing = missing | F.col(f.name).isNull()
    return df.where(missing | ~F.coalesce(F.col("tau_ms") > 0, F.lit(False)) | ~F.coalesce(F.col("status") == "pending", F.lit(False)))


def submission_table(spark: SparkSession, path: str) -> KeyedTable:
    """The submission table at ``path``; ``id`` is its primary key."""
    return KeyedTable(spark, path, SUBMISSION_SCHEMA, "id")


def append_submissions(df: DataFrame, path: str) -> tuple[bool, str]:
    """Append to the submission table; (ok, message) like a form.

    The batch is refused whole if a row breaks the table's constraints. Ids that the table
    holds, and repeats within the batch, are not written again, so a repeated append
    changes nothing; writers may overlap.
    """
    bad = broken_rules(df.select(*[F.col(n) for n in SUBMISSION_SCHEMA.fieldNames()])).count()
    if bad:
        return False, f"Submission failed: {bad} row(s) break the table's constraints."
    submission_table(df.sparkSession, path).append(df)
    return True, "Submission stored as pending."


def flatten_submissions(df: DataFrame, input_schema: T.StructType, label: str = "Tau_ms",
                        training: DataFrame | None = None, key: str = "row_key") -> DataFrame:
    """Approved submissions -> training rows: ``key`` (``submission-<id>``), the JSON inputs
    expanded, the label. Optionally unioned by name with an existing training table whose
    own ``key`` is read as text; every row then has a key for the folds and the split."""
    ok = df.filter(F.col("status") == "approved")
    parsed = ok.select(F.concat(F.lit("submission-"), F.col("id")).alias(key), F.from_json("input_data", input_schema).alias("__in"),
                       F.col("tau_ms").alias(label))
    flat = parsed.select(key, "__in.*", label)
    if training is not None:
        return training.withColumn(key, F.col(key).cast("string")).unionByName(flat, allowMissingColumns=True)
    return flat


def _leaves(kind: T.DataType, path: str = "$", name: str = "") -> list[tuple[str, str, T.DataType]]:
    """(column name, path, type) of the scalar fields of an inferred object."""
    if not isinstance(kind, T.StructType):
        return [(name, path, kind)]
    out = []
    for f in kind.fields:
        step = f'["{f.name}"]'
        out += _leaves(f.dataType, path + step, f"{name}_{f.name}" if name else f.name)
    return out


def flatten_variants(df: DataFrame, label: str = "Tau_ms", key: str = "row_key") -> DataFrame:
    """Approved submissions -> training rows without a schema by hand.

    The inputs are parsed as VARIANT; one aggregation finds the fields that any approved
    submission holds and their common types. Nested objects give one column per leaf
    (``outer_inner``); numbers are doubles; a field whose type drifts between submissions,
    and lists, are text. A submission that lacks a field, or whose JSON is broken, has NULL.
    """
    ok = df.filter(F.col("status") == "approved")
    rows = ok.select(F.concat(F.lit("submission-"), F.col("id")).alias(key), F.try_parse_json("input_data").alias("__v"), F.col("tau_ms").alias(label))
    found = rows.agg(F.schema_of_variant_agg("__v")).first()[0]
    kind = T.DataType.fromDDL(found.replace("OBJECT<", "STRUCT<")) if found and found.startswith("OBJECT<") else T.StructType()
    leaves = _leaves(kind) if isinstance(kind, T.StructType) and kind.fields else []

    def read(path: str, type_: T.DataType) -> Column:
        if isinstance(type_, T.NumericType):
            return finite(F.try_variant_get("__v", path, "double"))
        return F.try_variant_get("__v", path, "boolean" if isinstance(type_, T.BooleanType) else "string")
    return rows.select(key, *[read(p, t).alias(n) for n, p, t in leaves], label)


def submission_errors(df: DataFrame, by=("model_type", "status")) -> DataFrame:
    """Prediction error of stored predictions against measured labels, in log1p space."""
    x = df.withColumn("__y", F.log1p(F.col("tau_ms")))
    return regression_metrics(x, "__y", "pred_log1p_tau_ms", by=list(by))
