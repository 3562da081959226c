"""Profiles and checks, explanations, submissions, numbers."""
import math

from pyspark.sql import functions as F

from tessera.functions.numeric import format_g, parse_user_number
from tessera.operators.explain import explain, linear_scorer
from tessera.operators.model import unit_breakdown
from tessera.operators.profile import completeness, profile_numeric, range_check
from tessera.operators.submissions import validate_submissions


def test_range_check(spark):
    prof = spark.createDataFrame([("v", 1.0, 125.0, 10.0, 20.0)], "column string, min double, max double, median double, mean double")
    df = spark.createDataFrame([(i, v) for i, v in enumerate([0.5, 126.0, 1.0, 125.0, None])], "k int, v double")
    got = sorted(r["k"] for r in range_check(df, "k", ["v"], prof).collect())
    assert got == [0, 1]
    w = range_check(df, "k", ["v"], prof, labels={"v": "Value"}).filter("k = 0").first()["warning"]
    assert w == "Value is outside the training range (1 ~ 125)."


def test_completeness(spark):
    df = spark.createDataFrame([("a", None, float("nan"), " ", 0)], "a string, b string, c double, d string, e int")
    r = completeness(df, ["a", "b", "c", "d", "e"]).first()
    assert (r["filled"], r["total"]) == (2, 5)


def test_parse_user_number(spark):
    df = spark.createDataFrame([(" 1,200 ",), ("",), ("12 ms",), (None,)], "s string")
    v, bad = parse_user_number(F.col("s"))
    got = [tuple(r) for r in df.select(v, bad).collect()]
    assert got == [(1200.0, False), (None, False), (None, True), (None, False)]


def test_unit_breakdown(spark):
    r = unit_breakdown(spark.createDataFrame([(5400000.0,)], "ms double"), "ms").first()
    assert (r["seconds"], r["minutes"], r["hours"], r["days"]) == (5400.0, 90.0, 1.5, 0.0625)


def test_format_g_like_python(spark):
    vals = [1234567.0, 0.0000123456, 1234.5, 43645.0, 857.71, 1e-5, 100.0, 9999.5, -3.14159, 0.1]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = [r[0] for r in df.select(format_g("x")).collect()]
    assert got == [format(v, ",.4g") for v in vals]


def test_profile_numeric(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None), (3.0, None), (10.0, None)], "a double, b double")
    rows = profile_numeric(df, ["a", "b"]).collect()
    assert len(rows) == 1 and rows[0]["median"] == 2.5 and rows[0]["mean"] == 4.0


def test_explain_linear_fixture(spark):
    df = spark.createDataFrame([(1, 3.0, 2.0, 1.0), (2, 1.0, 0.0, 0.0)], "k int, x double, y double, z double")
    scorer = linear_scorer({"x": 2.0, "y": 1.0, "z": -3.0}, {"x": 1.0, "y": 0.0, "z": 0.0})
    out = explain(df, "k", ["x", "y", "z"], scorer, top_n=2).orderBy("k", "rank").collect()
    r1 = [r for r in out if r["k"] == 1]
    assert [r["feature"] for r in r1] == ["x", "z"]
    assert r1[0]["current_log"] == 5.0 and r1[0]["delta_log"] == 4.0
    assert math.isclose(r1[0]["share_top_percent"], 57.142857142857146)
    assert math.isclose(r1[1]["share_top_percent"], 42.857142857142854)
    assert math.isclose(r1[0]["share_all_percent"], 44.44444444444444)
    assert math.isclose(r1[0]["coverage_percent"], 77.77777777777777)
    assert r1[1]["direction"] == "decreases"
    r2 = [r for r in out if r["k"] == 2]
    assert all(r["share_top_percent"] == 0.0 and r["coverage_percent"] == 0.0 for r in r2)


def test_explain_plan_has_one_exchange(spark):
    df = spark.range(100).select(F.col("id").alias("k"), (F.col("id") * 1.0).alias("x"), (F.col("id") * 2.0).alias("y"))
    out = explain(df, "k", ["x", "y"], linear_scorer({"x": 1.0, "y": 1.0}, {"x": 0.0, "y": 0.0}))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 1
    assert "SinglePartition" not in plan


def test_validate_submissions(spark):
    rows = [("12000", True, "pending"), ("abc", True, "pending"), ("-3", True, "pending"),
            ("5", False, "pending"), ("5", True, "approved"), ("5", True, "weird")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)],
                               "i int, tau_raw string, confirmed boolean, status string")
    got = [r["reject_reason"] for r in validate_submissions(df, status="status").orderBy("i").collect()]
    assert got == [None, "invalid_number", "tau_not_positive", "not_confirmed", "not_pending", "bad_status"]


def test_driver_captions(spark):
    from tessera.operators.explain import driver_captions
    df = spark.createDataFrame([(1, 3.0, 2.0, 1.0)], "k int, x double, y double, z double")
    scorer = linear_scorer({"x": 2.0, "y": 1.0, "z": -3.0}, {"x": 1.0, "y": 0.0, "z": 0.0})
    out = driver_captions(explain(df, "k", ["x", "y", "z"], scorer, top_n=3), {"x": "Field X"})
    r = {row["feature"]: row for row in out.collect()}
    assert r["x"]["label"] == "Field X" and r["x"]["value_text"] == "3" and r["x"]["moves"] == "higher"
    assert r["z"]["moves"] == "lower"
    assert r["x"]["caption"] == ("Compared with hiding this field: prediction moves higher by "
                                 "|Δ log1p(Tau)| = 4.000. Share among all measured input effects: 44.4%.")


def test_append_submissions(spark):
    import tempfile
    from tessera.operators.submissions import append_submissions, assemble_payload, submission_table
    rows = [(1, "12000", True, "x", 3.0), (2, "7", True, None, None)]
    df = spark.createDataFrame(rows, "i int, tau_raw string, confirmed boolean, a string, b double")
    v = validate_submissions(df).filter("accepted")
    pay = assemble_payload(v, ["a", "b"], id_col="i")
    path = tempfile.mkdtemp(prefix="subs-", dir="/tmp") + "/table"
    ok, msg = append_submissions(pay, path)
    assert ok, msg
    ok, _ = append_submissions(pay.union(pay), path)  # the same ids again: nothing changes
    back = submission_table(spark, path).read()
    assert ok and back.count() == 2 and back.filter("status = 'pending'").count() == 2
    for rule in ({"status": F.lit("approved")}, {"tau_ms": F.lit(-1.0)}, {"tau_ms": F.lit(None).cast("double")}, {"input_data": F.lit(None).cast("string")}):
        ok, msg = append_submissions(pay.withColumn("id", F.concat(F.lit("x"), "id")).withColumns(rule), path)
        assert not ok and "constraints" in msg
    assert submission_table(spark, path).read().count() == 2
    r = back.filter("id = '2'").first()
    assert r["input_completeness_filled"] == 0 and r["input_data"] == '{"a":null,"b":null}'


def test_explain_rows_that_share_a_key(spark):
    df = spark.createDataFrame([(1, 3.0, "N/A"), (1, 1.0, "b"), (1, 3.0, "N/A")], "k int, x double, t string")
    out = explain(df, "k", ["x", "t"], linear_scorer({"x": 2.0}, {"x": 0.0}), top_n=2).collect()
    assert sorted(r["current_log"] for r in out) == [2.0, 2.0, 6.0, 6.0, 6.0, 6.0]
    assert sorted(str(r["current_value"]) for r in out if r["feature"] == "t") == ["None", "None", "b"]


def test_range_check_skips_text_that_is_no_number(spark):
    prof = spark.createDataFrame([("v", 1.0, 5.0, 2.0, 2.0)], "column string, min double, max double, median double, mean double")
    df = spark.createDataFrame([(1, "12 ms"), (2, "9"), (3, "3"), (4, None)], "k int, v string")
    assert [r["k"] for r in range_check(df, "k", ["v"], prof).collect()] == [2]


def test_nested_numbers_are_json_safe(spark):
    from tessera.operators.submissions import inputs_json
    nan = float("nan")
    df = spark.createDataFrame([(nan, [1.0, nan], (nan, "x"), {"a": nan})], "a double, b array<double>, c struct<d:double,e:string>, f map<string,double>")
    assert df.select(inputs_json(df, ["a", "b", "c", "f"]).alias("j")).first()["j"] == '{"a":null,"b":[1.0,null],"c":{"d":null,"e":"x"},"f":{"a":null}}'


def test_tiny_values_keep_their_mean(spark):
    df = spark.createDataFrame([(k * 1e-13,) for k in range(1, 6)], "x double")
    assert math.isclose(profile_numeric(df, ["x"]).first()["mean"], 3e-13, rel_tol=1e-9)
