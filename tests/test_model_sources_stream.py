"""Training chain, bundle round trip, suffix reads, stream intake = batch validation."""
import datetime
import os
import shutil
import tempfile

import pytest
from pyspark.sql import functions as F

from tessera.operators.explain import explain
from tessera.operators.extra_trees import TreeParams, fit_forest
from tessera.operators.features import DEFAULT_INPUTS, FEATURE_NAMES, INPUTS_OF, LOOSE, add_features
from tessera.operators.model import TrainParams, score, train
from tessera.operators.sensitivity import dependency_map, explain_trained
from tessera.plans import bindings as B
from tessera.sources.bundle_io import load_bundle, save_bundle
from tessera.operators.profile import profile_options
from tessera.roles import RAW_INPUTS
from tessera.sources.sinks import profile_document, sorted_options
from tessera.sources.tables import read_table
from tessera.streaming.intake import run_intake

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def bundle(spark):
    ex = B.experiments_from_orders(spark, SMALL)
    return train(ex, "o_orderkey", params=TrainParams(num_trees=5, max_depth=5))


def test_train_metrics_and_profile(bundle):
    m = bundle.metrics
    assert m["raw_rows"] >= m["used_rows_after_cleaning"] == m["train_rows"] + m["test_rows"]
    assert m["R2_log"] is not None and m["R2_log"] > 0.5
    doc = profile_document(bundle)
    assert "Concentration_mg_ml" in doc["numeric_stats"]
    assert doc["categorical_options"]["Channel"] == {"table": "options", "column": "Channel"}


def test_drivers_by_dependency_equal_full_scorings(spark, bundle):
    """Every variant scored whole, against replaced cells of one vector; rows with swapped
    and missing values included."""
    ex = B.experiments_from_orders(spark, SMALL).orderBy("o_orderkey").limit(120)
    odd = spark.createDataFrame([(-1, "PVDF", "0.5"), (-2, "0.25", None), (-3, None, "0.7"), (-4, None, None), (-5, "x y", "abc")], "o_orderkey bigint, wt string, polymer string")
    ex = ex.unionByName(odd.withColumn("Process", F.lit("Spin coat")).withColumn("Spin_RPM", F.lit("500")), allowMissingColumns=True)
    fields = [c for c in RAW_INPUTS if c in ex.columns]
    scorer = lambda d: score(d, bundle, keep=["__row", "__hidden", "__ord", "__value"])
    full = explain(ex, "o_orderkey", fields, scorer, prediction="pred_log1p_tau_ms", top_n=25)
    fast = explain_trained(ex, bundle, "o_orderkey", fields, top_n=25)
    assert fast.columns == full.columns
    key = lambda r: (r["o_orderkey"], r["feature"])
    a, b = ({key(r): r for r in d.collect()} for d in (full, fast))
    assert a.keys() == b.keys() and len(a) == 125 * len(fields)
    for k in a:
        assert a[k]["current_value"] == b[k]["current_value"]
        for c in ("pred_log_without_feature", "current_log", "delta_log"):
            assert abs(a[k][c] - b[k][c]) < 1e-9, (k, c)


def test_dependency_map_is_sparse_and_complete(spark, bundle):
    reach = dependency_map([c for c in RAW_INPUTS if c in bundle.feature_columns], bundle)
    per_row = sum(len(r.computed) for r in reach)
    assert len(FEATURE_NAMES) + per_row <= (len(reach) + 1) * len(FEATURE_NAMES) / 5
    blank = {r: "__none" for r in DEFAULT_INPUTS}
    one = spark.createDataFrame([(1.5, "spin")], "v double, p string").withColumn("__none", F.lit(None).cast("double"))
    whole = {r: "p" if r == "process" else "v" for r in DEFAULT_INPUTS}
    base = add_features(one, whole).first()
    for role in DEFAULT_INPUTS:  # which features change when an input goes missing
        gone = add_features(one.withColumn("__none", F.lit(None).cast("string")) if role == "process" else one, whole | {role: blank[role]}).first()
        assert {n for n in FEATURE_NAMES if gone[n] != base[n]} <= {n for n in FEATURE_NAMES if role in INPUTS_OF[n]}
        assert all(gone[n] is None for n in FEATURE_NAMES if role in INPUTS_OF[n] and n not in LOOSE)


def test_forest_of_the_published_size(spark):
    """1,500 full trees over all 445 rows of a table as wide as the assembled one."""
    rows = spark.range(445).select(F.array(*[F.pmod(F.xxhash64("id", F.lit(i)), F.lit(1000)) / 1000.0 for i in range(82)]).alias("x"))
    forest = fit_forest(rows.withColumn("y", F.get("x", F.lit(0)) + F.get("x", F.lit(1)) * F.get("x", F.lit(2))), TreeParams())
    assert forest.trees.count() == 1500
    assert forest.trees.agg(F.min(F.element_at("rows", 1)), F.max(F.element_at("rows", 1))).first() == (445, 445)
    got = forest.predict(rows.withColumn("y", F.get("x", F.lit(0)) + F.get("x", F.lit(1)) * F.get("x", F.lit(2))), "x", "p")
    assert got.agg(F.max(F.abs(F.col("p") - F.col("y")))).first()[0] < 1e-9  # leaves of one row


def test_options_have_no_cap(spark):
    wide = spark.range(20_000).select(F.format_string("v%05d", 19_999 - F.col("id")).alias("c")).repartition(5)
    path = tempfile.mkdtemp(prefix="options-", dir="/tmp")
    sorted_options(profile_options(wide, ["c"])).write.mode("overwrite").parquet(path)
    got = [r["value"] for r in spark.read.parquet(path).orderBy("column", "value").collect()]
    assert got == [f"v{k:05d}" for k in range(20_000)]


def test_score_keeps_every_row_and_round_trips(spark, bundle):
    ex = B.experiments_from_orders(spark, SMALL)
    blank = spark.createDataFrame([(-1,)], "o_orderkey bigint")
    scored = score(ex.unionByName(blank, allowMissingColumns=True), bundle)
    assert scored.count() == ex.count() + 1
    row = scored.filter("o_orderkey = -1").first()
    assert row["pred_log1p_tau_ms"] is not None
    path = tempfile.mkdtemp(prefix="bundle-", dir="/tmp")
    save_bundle(bundle, path)
    again = load_bundle(spark, path)
    a = {r["o_orderkey"]: r["pred_log1p_tau_ms"] for r in score(ex, bundle).collect()}
    b = {r["o_orderkey"]: r["pred_log1p_tau_ms"] for r in score(ex, again).collect()}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a)


def test_missing_bundle_is_a_clear_error(spark):
    with pytest.raises(FileNotFoundError):
        load_bundle(spark, "/tmp/definitely-not-a-bundle-here")


def test_read_table_by_suffix(spark):
    d = tempfile.mkdtemp(prefix="csv-", dir="/tmp")
    p = os.path.join(d, "x.csv")
    with open(p, "w") as f:
        f.write("a,b\n1,N/A\n2, x \n")
    df = read_table(spark, p)
    assert [tuple(r) for r in df.collect()] == [("1", None), ("2", " x ")]
    with pytest.raises(ValueError):
        read_table(spark, os.path.join(d, "x.xlsx"))


def test_stream_equals_batch(spark):
    import __spark_entry__ as E
    streamed = E.queries()["stream_submissions"](spark, SMALL)
    ev = spark.read.parquet(f"{SMALL}/events.parquet")
    assert streamed.count() == ev.select("event_id").distinct().count()
    acc = streamed.filter(F.col("intake") == "accepted").count()
    assert acc == streamed.filter(F.col("accepted")).count()


def _land(spark, folder, rows):
    spark.createDataFrame(rows, "id long, tau string, at timestamp").coalesce(1).write.mode("append").parquet(folder)


def _intake(spark, d, **more):
    prepare = lambda b: b.select("id", F.col("tau").alias("tau_raw"), F.lit(True).alias("confirmed"))
    schema = spark.createDataFrame([], "id long, tau string, at timestamp").schema
    return run_intake(spark, f"{d}/in", schema, f"{d}/out", f"{d}/checkpoint", prepare, id_col="id", **more)


def test_restarted_intake_takes_an_id_once(spark):
    d, t = tempfile.mkdtemp(prefix="intake-", dir="/tmp"), datetime.datetime(2024, 1, 1)
    _land(spark, f"{d}/in", [(1, "5", t), (2, "6", t), (2, "6", t)])
    assert sorted(r["id"] for r in _intake(spark, d).collect()) == [1, 2]
    _land(spark, f"{d}/in", [(2, "7", t), (3, "8", t)])  # a new query on the same checkpoint
    out = _intake(spark, d)
    assert sorted(r["id"] for r in out.collect()) == [1, 2, 3]
    plan = out.where("id = 3").select("batch").first()[0]
    assert plan > 0 and out.where("id = 2").select("batch").first()[0] == 0


def test_intake_by_event_time_forgets_ids_and_leaves_late_rows_out(spark):
    d, t = tempfile.mkdtemp(prefix="intake-", dir="/tmp"), datetime.datetime(2024, 1, 1)
    day = datetime.timedelta(days=1)
    more = {"time_col": "at", "keep_ids": "2 days"}
    _land(spark, f"{d}/in", [(1, "5", t)])
    _intake(spark, d, **more)
    _land(spark, f"{d}/in", [(1, "5", t + day), (2, "5", t + 20 * day)])  # 1 is known; 2 moves the watermark
    _intake(spark, d, **more)
    _land(spark, f"{d}/in", [(3, "5", t), (1, "9", t + 21 * day)])  # 3 is late, 1 has expired
    got = sorted((r["id"], r["tau_ms"]) for r in _intake(spark, d, **more).collect())
    assert got == [(1, 5.0), (1, 9.0), (2, 5.0)]


def test_a_batch_does_not_read_the_sink(spark):
    """What a batch reads is the landed files alone."""
    d, t = tempfile.mkdtemp(prefix="intake-", dir="/tmp"), datetime.datetime(2024, 1, 1)
    for k in range(3):
        _land(spark, f"{d}/in", [(k, "5", t)])
        _intake(spark, d)
    shutil.move(f"{d}/out", f"{d}/elsewhere")  # history out of reach
    _land(spark, f"{d}/in", [(1, "5", t), (9, "5", t)])
    assert [r["id"] for r in _intake(spark, d).collect()] == [9]
