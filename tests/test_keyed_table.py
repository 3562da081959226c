"""Keyed append: primary key, overlapping writers, crashes between write and commit."""
import tempfile

import pytest

from tessera.operators.keyed_table import KeyedTable

SCHEMA = "id string, v int"


def table(spark, path=None, kind=KeyedTable):
    return kind(spark, path or tempfile.mkdtemp(prefix="keyed-", dir="/tmp"), spark.createDataFrame([], SCHEMA).schema, buckets=4)


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), SCHEMA)


def held(t, version=None):
    return sorted((r["id"], r["v"]) for r in t.read(version).collect())


def test_a_key_is_added_once(spark):
    t = table(spark)
    assert held(t) == [] and t.version() == 0
    assert t.append(rows(spark, ("a", 1), ("b", 2), ("b", 2))).rows == 2
    got = t.append(rows(spark, ("b", 9), ("c", 3)))
    assert (got.version, got.rows, got.known) == (2, 1, 1)
    assert held(t) == [("a", 1), ("b", 2), ("c", 3)] and held(t, 1) == [("a", 1), ("b", 2)]
    again = t.append(rows(spark, ("a", 0)))
    assert again.rows == 0 and t.version() == 2
    with pytest.raises(ValueError):
        t.append(rows(spark, (None, 1)))


def test_two_overlapping_writers(spark):
    """The other writer commits after this one has checked its keys and written its rows."""
    path = tempfile.mkdtemp(prefix="keyed-", dir="/tmp")

    class Slow(KeyedTable):
        def _commit(self, number, commits):
            if not getattr(self, "met", False):
                self.met = True
                table(spark, path).append(rows(spark, ("x", 1), ("y", 1)))
            return super()._commit(number, commits)
    got = table(spark, path, Slow).append(rows(spark, ("y", 2), ("z", 2)))
    assert (got.version, got.rows, got.known) == (2, 1, 1)
    assert held(table(spark, path)) == [("x", 1), ("y", 1), ("z", 2)]


def test_a_crash_before_the_commit_leaves_nothing(spark):
    path = tempfile.mkdtemp(prefix="keyed-", dir="/tmp")

    class Crashes(KeyedTable):
        def _commit(self, number, commits):
            raise OSError("lost")
    with pytest.raises(OSError):
        table(spark, path, Crashes).append(rows(spark, ("a", 1)))
    t = table(spark, path)
    assert held(t) == [] and t.version() == 0
    assert t.append(rows(spark, ("a", 2))).rows == 1 and held(t) == [("a", 2)]


def test_compaction_keeps_rows_and_keys(spark):
    t = table(spark)
    for k in "abc":
        t.append(rows(spark, (k, 1)))
    assert t.compact() == 4 and len(t.commits()) == 1
    assert t.append(rows(spark, ("b", 5), ("d", 1))).rows == 1
    assert held(t) == [(k, 1) for k in "abcd"] and held(t, 2) == [("a", 1), ("b", 1)]
