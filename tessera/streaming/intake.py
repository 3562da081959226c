"""Submission intake as a Structured Streaming query.

Landed submission files are read as a stream with a declared schema, scored, counted for
completeness and validated (stateless: the same batch functions), split into accepted and quarantined
rows, and appended to a status-partitioned table by ``foreachBatch``. Each
micro-batch writes into a folder named by its batch id with overwrite mode, so a
batch re-run after a failure replaces its own output instead of duplicating it;
the checkpoint folder records progress, so a restarted query resumes where it
stopped.

An id is taken once: the stream keeps the ids it has seen as keyed state that expires
``keep_ids`` after their time (``dropDuplicatesWithinWatermark``), so a batch costs the same
whatever the sink holds. The time is that of arrival, which is never late, or a column of
the rows; then a row older than the watermark is late and left out. For ids that must stay
unique beyond that, append the accepted rows to a ``KeyedTable``.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.profile import completeness
from ..operators.submissions import validate_submissions


def start_intake(spark: SparkSession, source: str, schema: T.StructType, sink: str, checkpoint: str,
                 prepare: Callable[[DataFrame], DataFrame], fmt: str = "parquet",
                 available_now: bool = True, file_filter: str | None = None,
                 scorer: Callable[[DataFrame], DataFrame] | None = None, input_cols: list[str] | None = None,
                 id_col: str | None = None, time_col: str | None = None, keep_ids: str = "7 days"):
    """Start the stream on the landing folder ``source`` (optionally only files whose
    name matches ``file_filter``); ``prepare`` maps landed rows to the validator's
    columns (``tau_raw``, ``confirmed`` and optional ``status``) and the inputs.

    ``scorer`` adds the stored prediction (any DataFrame -> DataFrame), ``input_cols`` the
    number of filled inputs. With ``id_col`` a row whose id has come before, within
    ``keep_ids`` by ``time_col`` (the time of arrival if not given), is left out.
    """
    reader = spark.readStream.schema(schema).format(fmt)
    if file_filter:
        reader = reader.option("pathGlobFilter", file_filter)
    stream = reader.load(source)
    if id_col:
        time = F.current_timestamp() if time_col is None else F.col(time_col).cast("timestamp")
        stream = stream.withColumn("__time", time).withWatermark("__time", keep_ids).dropDuplicatesWithinWatermark([id_col])

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        rows = prepare(batch.drop("__time"))
        if input_cols:
            rows = completeness(rows, input_cols, "input_completeness_filled", "input_completeness_total")
        if scorer:
            rows = scorer(rows)
        v = validate_submissions(rows, status="status" if "status" in rows.columns else None)
        out = v.withColumn("intake", F.when(F.col("accepted"), "accepted").otherwise("quarantine"))
        out.write.mode("overwrite").partitionBy("intake").parquet(f"{sink}/batch={batch_id}")

    writer = stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()


def run_intake(spark: SparkSession, source: str, schema: T.StructType, sink: str, checkpoint: str,
               prepare: Callable[[DataFrame], DataFrame], fmt: str = "parquet",
               file_filter: str | None = None, **options) -> DataFrame:
    """Process everything available now, then read the result table back."""
    q = start_intake(spark, source, schema, sink, checkpoint, prepare, fmt, available_now=True,
                     file_filter=file_filter, **options)
    q.awaitTermination()
    return spark.read.parquet(sink)
