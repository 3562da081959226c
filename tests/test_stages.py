"""The chain as Spark ML stages: one PipelineModel, saved and loaded, gives equal scores."""
import tempfile

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from tessera import stages as S
from tessera.operators.features import FEATURE_NAMES
from tessera.operators.split import hash_fold
from tessera.plans import bindings as B

CATS = ["Channel", "Solvent", "Process"]
NUMS = ["Concentration_mg_ml", "Spin_RPM", "Gate_voltage_V", *FEATURE_NAMES]


def chain(trees=4):
    coded = [f"{c}_{k}" for c in CATS for k in ("te", "count", "freq")]
    return Pipeline(stages=[
        S.Clean(keyCols=["o_orderkey", "fold", "label"]), S.Derive(), S.QuantileLabel(labelCol="label", inputCol="label", outputCol="normalised"),
        S.EncodeCategories(inputCols=CATS), S.ImputeMedians(inputCols=[*NUMS, *coded], extraCols=[f"{c}_ord" for c in CATS]),
        S.ExtraTrees(numTrees=trees, maxDepth=6), S.QuantileLabel(labelCol="label", inputCol="prediction", outputCol="predicted", inverse=True)])


def test_pipeline_fit_save_load_score(spark):
    ex = B.experiments_from_orders(spark, "/root/testdata/sf0.001").limit(400)
    label = F.log1p(F.col("Tau_ms").try_cast("double"))
    train = hash_fold(ex.withColumn("label", label).where("label > 0").drop("Tau_ms").withColumn("Tau_ms", F.lit("5")), "o_orderkey")
    model = chain().fit(train)
    path = tempfile.mkdtemp(prefix="stages-", dir="/tmp") + "/model"
    model.write().overwrite().save(path)
    again = PipelineModel.load(path)
    new = ex.drop("Tau_ms", "On_off_ratio")  # no label, no fold, a column less
    a, b = ({r["o_orderkey"]: r["predicted"] for r in m.transform(new).collect()} for m in (model, again.copy()))
    assert a == b and len(a) == new.count() and all(v is not None for v in a.values())
    got = again.transform(train).select("label", "predicted")
    assert got.select(F.corr("label", "predicted")).first()[0] > 0.8
    assert [type(s).__name__ for s in again.stages] == [type(s).__name__ for s in model.stages]
    assert again.stages[5].getOrDefault("numTrees") == 4 and again.stages[0].uid == model.stages[0].uid


def test_unfitted_pipeline_round_trips_and_copies(spark):
    path = tempfile.mkdtemp(prefix="stages-", dir="/tmp") + "/pipeline"
    chain(7).write().overwrite().save(path)
    back = Pipeline.load(path)
    assert back.getStages()[5].getOrDefault("numTrees") == 7 and back.getStages()[3].getOrDefault("inputCols") == CATS
    trees = back.getStages()[5]
    assert trees.copy({trees.numTrees: 9}).getOrDefault("numTrees") == 9 and trees.getOrDefault("numTrees") == 7


def test_training_rows_are_encoded_out_of_fold(spark):
    rows = [(k, "ab"[k % 2], float(k), k % 3) for k in range(12)] + [(99, "c", 7.0, 0)]
    df = spark.createDataFrame(rows, "k int, cat string, y double, fold int")
    m = S.EncodeCategories(inputCols=["cat"], labelCol="y", smoothing=0.0).fit(df)
    inside = {r["k"]: r["cat_te"] for r in m.transform(df).collect()}
    outside = {r["k"]: r["cat_te"] for r in m.transform(df.drop("fold")).collect()}
    mean = sum(r[2] for r in rows) / len(rows)
    for k, cat, _, fold in rows:
        others = [r[2] for r in rows if r[1] == cat and r[3] != fold]
        assert abs(inside[k] - (sum(others) / len(others) if others else mean)) < 1e-12
        mine = [r[2] for r in rows if r[1] == cat]
        assert abs(outside[k] - sum(mine) / len(mine)) < 1e-12
