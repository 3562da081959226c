"""Session helpers: one place for the settings every job in the package relies on."""
from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def build_session(master: str | None = None, app: str = "tessera",
                  shuffle_partitions: int | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    """Create or reuse a session with AQE on, the UI off and a checkpoint folder.

    On a cluster the master and ``spark.checkpoint.dir`` come from the launcher;
    they are only filled in here when absent (local runs and tests).
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # only takes effect when this call starts the JVM (local runs, tests)
        "spark.driver.memory": os.environ.get("TESSERA_DRIVER_MEMORY", "8g"),
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    tune_for_wide_plans(spark)
    return spark


def tune_for_wide_plans(spark: SparkSession) -> None:
    """Session settings for the package's wide projections.

    * constraint propagation off: the cleaning and feature projections define dozens
      of aliased expressions, and inferring constraints for a filter placed above
      them grows combinatorially in the optimizer. Filters are still pushed down.
    * huge-method limit 8000 bytes (Spark's documented setting for HotSpot): a
      whole-stage function larger than that is never JIT-compiled by the JVM and
      runs interpreted, about 5x slower; above the limit Spark compiles the
      projections separately instead.
    """
    spark.conf.set("spark.sql.constraintPropagation.enabled", "false")
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder, creating a local one only in local mode.

    A cluster names a folder that all executors share in ``spark.checkpoint.dir``; that
    setting is always honoured. Only ``local`` masters (tests, one machine) fall back to
    a temporary folder; any other master without the setting is an error, because other
    executors could not read part files from one machine's disk.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if sc.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    local = tempfile.mkdtemp(prefix="tessera-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir()


def shared_path(spark: SparkSession, what: str) -> str:
    """A fresh path below the shared checkpoint folder, for a table one job writes and
    later jobs read."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def spread(df: DataFrame) -> DataFrame:
    """The rows of ``df`` dealt out by a hash of the whole row, so that the steps after it
    run on all cores however few files or row groups the table was read from."""
    plain = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.NumericType, T.BooleanType, T.DateType, T.TimestampType))]
    return df.repartition(*[F.col(f"`{c}`") for c in plain]) if plain else df


_SCOPES: list[list[str]] = []


def written(df: DataFrame, what: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back: cuts the
    lineage, survives lost executors, and keeps generated row ids fixed. ``codec``: the
    compression, if not the session's."""
    spark = df.sparkSession
    path = shared_path(spark, what)
    df.write.parquet(path, compression=codec)
    if _SCOPES:
        _SCOPES[-1].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def _remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def discard(*tables: DataFrame) -> None:
    """Remove tables of ``written`` that no plan reads any more; removing one again does nothing."""
    for t in tables:
        _remove(t.sparkSession, t._written_to)


def written_alone(make: Callable[[], DataFrame], what: str, codec: str | None = None) -> DataFrame:
    """``written(make(), what)``; the tables written on the way to it are removed then."""
    _SCOPES.append([])
    try:
        out = written(make(), what, codec)
    finally:
        on_the_way = _SCOPES.pop()
    if _SCOPES:
        _SCOPES[-1].append(out._written_to)
    for path in on_the_way:
        if path != out._written_to:
            _remove(out.sparkSession, path)
    return out


def release(spark: SparkSession) -> None:
    """Let go of what finished jobs left on the driver: plans and arrays that nothing refers
    to any more, and with them the shuffle files and broadcasts that Spark keeps for them."""
    gc.collect()
    spark._jvm.java.lang.System.gc()


def ship_package(spark: SparkSession) -> None:
    """Give Python workers this package, once per application (as ``--py-files`` does), so
    that tasks can import it wherever the driver was started from."""
    sc = spark.sparkContext
    if getattr(sc, "_tessera_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    served = tempfile.mkdtemp(prefix="tessera-py-")  # the driver serves it until it ends
    atexit.register(shutil.rmtree, served, ignore_errors=True)
    archive = os.path.join(served, "tessera.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(here):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(here)))
    sc.addPyFile(archive)
    sc._tessera_shipped = True
