"""An append-only table with a primary key that several writers may append to.

Layout under ``path``: ``data/<commit>`` (rows), ``ids/<commit>/bucket=<n>`` (keys by hash
bucket) and ``_versions/<number>.json``, the list of commits that make up a version.

An append writes its rows and keys first and then creates the next version file, which
only one writer can do (create, never overwrite; as atomic as the store's create is). A
writer that finds the version taken checks its keys against the commits that came in
between, and no others, leaves out those already there, and tries again. What was written
without a version (a crash before the commit) is never read. The key check reads only the
key column of the buckets that the batch falls in.
"""
from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import discard, written


@dataclass
class Appended:
    version: int      # that holds the rows
    rows: int         # added
    known: int        # left out: their key was there


class KeyedTable:
    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: str = "id", buckets: int = 64):
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path.rstrip("/"), schema, key, buckets

    # ---- versions ----
    def _place(self, name: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return place, place.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """Number of the newest version; 0: the table is empty."""
        place, fs = self._place("_versions")
        names = [s.getPath().getName() for s in fs.listStatus(place)] if fs.exists(place) else []
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def commits(self, version: int | None = None) -> list[str]:
        """Commits of a version (the newest if not told), oldest first."""
        number = self.version() if version is None else version
        if not number:
            return []
        place, fs = self._place(f"_versions/{number:010d}.json")
        stream = fs.open(place)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, number: int, commits: list[str]) -> bool:
        """Create version ``number``; False if another writer has."""
        place, fs = self._place(f"_versions/{number:010d}.json")
        if fs.exists(place):
            return False
        # a reader must not meet half a file: written aside, then renamed to its place
        aside, _ = self._place(f"_versions/.{uuid.uuid4().hex}")
        out = fs.create(aside, False)
        out.write(bytearray(json.dumps(commits).encode()))
        out.close()
        if fs.exists(place) or not fs.rename(aside, place):
            fs.delete(aside, False)
            return False
        return True

    # ---- rows ----
    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version."""
        paths = [f"{self.path}/data/{c}" for c in self.commits(version)]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _unknown(self, rows: DataFrame, commits: list[str]) -> DataFrame:
        """Rows whose key is in none of ``commits``, written."""
        if not commits:
            return rows
        used = [r[0] for r in rows.select(self._bucket().alias("b")).distinct().collect()]  # `buckets` numbers at most
        schema = T.StructType([T.StructField("known_key", self.schema[self.key].dataType), T.StructField("bucket", T.IntegerType())])
        keys = None
        for c in commits:
            part = self.spark.read.schema(schema).parquet(f"{self.path}/ids/{c}").where(F.col("bucket").isin(used))
            keys = part if keys is None else keys.unionByName(part)
        return written(rows.join(keys, (rows[self.key] == keys["known_key"]) & (rows["__bucket"] == keys["bucket"]), "left_anti"), "fresh")

    def append(self, rows: DataFrame) -> Appended:
        """Add the rows whose key the table does not hold; of rows that share a key in the
        batch one is taken. Rows without a key are refused."""
        one = rows.select(*[F.col(n) for n in self.schema.fieldNames()]).dropDuplicates([self.key])
        batch = written(one.withColumn("__bucket", self._bucket()), "append")
        counts = batch.agg(F.count(F.lit(1)).alias("n"), F.count(self.key).alias("keyed")).first()
        if counts["n"] != counts["keyed"]:
            raise ValueError(f"{counts['n'] - counts['keyed']} row(s) have no {self.key}")
        at = self.version()
        held = self.commits(at)
        fresh = self._unknown(batch, held)
        while True:
            n = fresh.count()
            if not n:
                return Appended(at, 0, counts["n"])
            name = uuid.uuid4().hex
            fresh.drop("__bucket").write.parquet(f"{self.path}/data/{name}")
            fresh.select(F.col(self.key).alias("known_key"), F.col("__bucket").alias("bucket")).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/ids/{name}")
            if self._commit(at + 1, [*held, name]):
                return Appended(at + 1, n, counts["n"] - n)
            at = self.version()
            newer = [c for c in self.commits(at) if c not in held]
            held = [*held, *newer]
            fresh = self._unknown(fresh, newer)

    def compact(self) -> int:
        """Rewrite the newest version as one commit; the version number, or 0 if another
        writer was first (then nothing has changed)."""
        at = self.version()
        held = self.commits(at)
        if len(held) < 2:
            return at
        name = uuid.uuid4().hex
        rows = written(self.read(at), "compact")
        rows.write.parquet(f"{self.path}/data/{name}")
        rows.select(F.col(self.key).alias("known_key"), self._bucket().alias("bucket")).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/ids/{name}")
        discard(rows)
        return at + 1 if self._commit(at + 1, [name]) else 0
