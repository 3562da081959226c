"""Profile and metrics sinks: one JSON document per model, and the long tables it names."""
from __future__ import annotations

import json

from pyspark.sql import DataFrame

from ..operators.model import Bundle, bundle_summary


def profile_document(b: Bundle) -> dict:
    """Summary + numeric ranges as one JSON-safe dict (one entry per column).

    Vocabularies have no bound, so the document names the options table instead of
    holding the lists; every category column is listed, whatever its vocabulary.
    """
    doc = bundle_summary(b)
    doc["numeric_stats"] = {r["column"]: {k: r[k] for k in ("min", "max", "median", "mean")}
                            for r in b.profile_numeric.collect()}
    doc["input_categorical_cols"] = [c for c in b.roles.raw_inputs if c in b.categorical]
    doc["categorical_options"] = {c: {"table": "options", "column": c} for c in doc["input_categorical_cols"]}
    return doc


def sorted_options(options: DataFrame) -> DataFrame:
    """All (column, value) rows in published order over the whole table: range
    partitions, sorted inside."""
    return options.repartitionByRange("column", "value").sortWithinPartitions("column", "value")


def write_profile(b: Bundle, path: str) -> None:
    """Write the profile as one JSON document and the long tables as Parquet."""
    spark = b.te.maps.sparkSession
    text = json.dumps(profile_document(b), default=float, ensure_ascii=False)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/document")
    b.profile_numeric.write.mode("overwrite").parquet(f"{path}/numeric")
    sorted_options(b.profile_options).write.mode("overwrite").parquet(f"{path}/options")


def metrics_json(b: Bundle) -> str:
    """The hold-out metrics as one JSON line."""
    return json.dumps(b.metrics, default=float)
