"""Table scan with the format picked by file suffix (CSV, Parquet, JSON)."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import is_missing

FORMATS = {".csv": "csv", ".parquet": "parquet", ".json": "json", ".jsonl": "json"}


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
               normalise_missing: bool = True) -> DataFrame:
    """Read ``path`` by suffix; any other suffix is an error.

    CSV is read with every column as text (or the given schema), never inferred, so
    type decisions stay with the sanitiser. With ``normalise_missing`` the missing
    tokens of text columns become NULL at ingest.
    """
    p = path.rstrip("/").lower()
    fmt = next((f for suf, f in FORMATS.items() if p.endswith(suf)), None)
    if fmt is None:
        raise ValueError("supported formats: .csv, .parquet, .json")
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", "true").option("inferSchema", "false")
    df = reader.load(path)
    if normalise_missing:
        exprs = {f.name: F.when(~is_missing(F.col(f"`{f.name}`")), F.col(f"`{f.name}`"))
                 for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
        df = df.withColumns(exprs) if exprs else df
    return df
