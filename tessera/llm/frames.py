"""Small helpers shared by the operators: slim projections, keeping rows, Arrow buffers."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship_package, written


def text_of(column: str) -> Column:
    """The text column with null read as empty."""
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))


def slim(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """Only (doc_id, text) and ``more``, whatever else the table holds or how its columns are named.
    Operators begin here, so this also gives the workers their code."""
    ship_package(docs.sparkSession)
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_of(text_col).alias("text"), *more)


def raw_text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a null-free string column and the offsets of its values, no copy."""
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0]:offsets[-1]], (offsets - offsets[0]).astype(np.int64)


def slices(batch: pa.RecordBatch, column: int, most: int = 4 << 20):
    """Parts of an Arrow batch of about ``most`` bytes of text each (one row at least), so
    that what a kernel builds beside the text stays small."""
    _, ends = raw_text(batch.column(column))
    at = 0
    while at < len(batch):
        stop = max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1)
        yield batch.slice(at, stop - at)
        at = stop


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` written once with a number per row, and the name of that column: rows that
    lack an id or repeat one can so be told apart."""
    name, taken = "row_id", {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return written(docs.withColumn(name, F.monotonically_increasing_id()), "numbered", "zstd"), name


def first_of(rows: DataFrame, id_col: str, row_col: str) -> Column:
    """Order in which rows stay: the smallest id, null last; of one id the least xxhash64 of
    its cells, then the least number."""
    key = F.col(f"`{id_col}`")
    cells = F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in rows.columns if c != row_col])
    return F.struct(key.isNull().alias("none"), key.alias("id"), cells.alias("cells"), F.col(row_col).alias("row"))


def keep_rows(rows: DataFrame, row_col: str, numbers: DataFrame) -> DataFrame:
    """Rows of ``rows`` (from ``numbered``) whose number is in the one-column ``numbers``,
    without it: each row by its own decision."""
    return rows.join(numbers, rows[row_col] == numbers[numbers.columns[0]], "left_semi").drop(row_col)
