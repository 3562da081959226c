"""The training chain as Spark ML stages: estimators and models with params, ``copy``, and
one ``PipelineModel`` on disk.

    Pipeline(stages=[Clean(...), Derive(), QuantileLabel(...), EncodeCategories(...),
                     ImputeMedians(...), ExtraTrees(...), QuantileLabel(inverse=True, ...)])

Each stage is a thin binding of an operator of ``tessera.operators``; a fitted one holds a
JSON state and tables, saved beside each other. A category stage encodes rows that carry a
fold (``foldCol``) out of fold, so give the training frame one (``split.hash_fold``); rows
without it, as at scoring, are encoded from all training rows.
"""
from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators.encoders import ALL_ROWS, ImputerModel, MedianImputer, encode_categories, fit_category_maps
from .operators.extra_trees import Forest, TreeParams, fit_forest
from .operators.features import add_features
from .operators.model import with_vector
from .operators.quantile_target import QuantileModel, QuantileTarget
from .operators.sanitize import Sanitizer, fit_sanitizer
from .functions.hashing import fold_of
from .roles import DEFAULT_ROLES

_TEXT, _TEXTS, _INT, _FLOAT, _BOOL = (TypeConverters.toString, TypeConverters.toListString, TypeConverters.toInt, TypeConverters.toFloat, TypeConverters.toBoolean)


def _param(name: str, doc: str, kind) -> Param:
    return Param(Params._dummy(), name, doc, typeConverter=kind)


class _StateWriter(MLWriter):
    def __init__(self, model: "_Fitted"):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        for name, table in self.model.tables.items():
            table.write.parquet(f"{path}/{name}")
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession, {"state": self.model.state, "tables": list(self.model.tables)})


class _StateReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str):
        meta = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = self.cls(meta["state"], {name: self.sparkSession.read.parquet(f"{path}/{name}") for name in meta["tables"]})
        model._resetUid(meta["uid"])
        DefaultParamsReader.getAndSetParams(model, meta)
        return model


class _Fitted(Model, MLWritable, MLReadable):
    """A model of a JSON state and tables."""

    def __init__(self, state: dict | None = None, tables: dict[str, DataFrame] | None = None):
        super().__init__()
        self.state, self.tables = state or {}, tables or {}

    def write(self) -> MLWriter:
        return _StateWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _StateReader(cls)


class _Stage(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    def _fitted(self, model: _Fitted) -> _Fitted:
        return self._copyValues(model)


# ---- cleaning and features -------------------------------------------------------------------

class _CleanParams(Params):
    keyCols = _param("keyCols", "columns passed through untouched", _TEXTS)


class CleanModel(_Fitted, _CleanParams):
    def _transform(self, df: DataFrame) -> DataFrame:
        return Sanitizer(DEFAULT_ROLES, **self.state).transform(df)


class Clean(_Stage, _CleanParams):
    """Names, repairs, spellings and types of the experiment table (``fit_sanitizer``)."""

    @keyword_only
    def __init__(self, *, keyCols=()):
        super().__init__()
        self._set(**{k: list(v) for k, v in self._input_kwargs.items()})

    def _fit(self, df: DataFrame) -> CleanModel:
        keys = self.getOrDefault(self.keyCols)
        s = fit_sanitizer(df.drop(*keys))
        names = s.names | {k: k for k in keys}
        return self._fitted(CleanModel({"names": names, "dropped": s.dropped, "types": s.types, "columns": s.columns, "passthrough": keys, "rows": s.rows}))


class Derive(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """The derived features."""

    def _transform(self, df: DataFrame) -> DataFrame:
        return add_features(df)


# ---- label -----------------------------------------------------------------------------------

class _LabelParams(Params):
    labelCol = _param("labelCol", "column the quantile grid is fitted on", _TEXT)
    inputCol = _param("inputCol", "column to map", _TEXT)
    outputCol = _param("outputCol", "mapped column", _TEXT)
    quantiles = _param("quantiles", "points of the grid at most", _INT)
    inverse = _param("inverse", "map from the normal scale back to the label's", _BOOL)


class QuantileLabelModel(_Fitted, _LabelParams):
    def _transform(self, df: DataFrame) -> DataFrame:
        source = self.getOrDefault(self.inputCol)
        if source not in df.columns:  # no label at scoring
            return df
        grid = QuantileModel(**self.state)
        return df.withColumn(self.getOrDefault(self.outputCol), (grid.inverse if self.getOrDefault(self.inverse) else grid.forward)(source))


class QuantileLabel(_Stage, _LabelParams):
    """Quantile normaliser of the label, or its inverse on a prediction."""

    @keyword_only
    def __init__(self, *, labelCol="label", inputCol="label", outputCol="normalised", quantiles=200, inverse=False):
        super().__init__()
        self._setDefault(labelCol="label", inputCol="label", outputCol="normalised", quantiles=200, inverse=False)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> QuantileLabelModel:
        m = QuantileTarget(self.getOrDefault(self.quantiles), "normal").fit(df, self.getOrDefault(self.labelCol))
        return self._fitted(QuantileLabelModel({"quantiles": m.quantiles, "references": m.references, "normal": True}))


# ---- categories ------------------------------------------------------------------------------

class _CategoryParams(Params):
    inputCols = _param("inputCols", "category columns", _TEXTS)
    labelCol = _param("labelCol", "column whose mean is taken", _TEXT)
    foldCol = _param("foldCol", "fold of a training row", _TEXT)
    keyCols = _param("keyCols", "key that gives a fold if the frame has none", _TEXTS)
    smoothing = _param("smoothing", "rows that the overall mean counts for", _FLOAT)


class EncodeCategoriesModel(_Fitted, _CategoryParams):
    def _transform(self, df: DataFrame) -> DataFrame:
        fold = self.getOrDefault(self.foldCol)
        own = F.coalesce(F.col(fold), F.lit(ALL_ROWS)) if fold in df.columns else None
        return encode_categories(df, self.tables["maps"], self.getOrDefault(self.inputCols), self.state["mean"], fold=own)


class EncodeCategories(_Stage, _CategoryParams):
    """Smoothed target mean, count, frequency and ordinal of each category column."""

    @keyword_only
    def __init__(self, *, inputCols=(), labelCol="normalised", foldCol="fold", keyCols=(), smoothing=5.0):
        super().__init__()
        self._setDefault(inputCols=[], labelCol="normalised", foldCol="fold", keyCols=[], smoothing=5.0)
        self._set(**{k: list(v) if isinstance(v, tuple) else v for k, v in self._input_kwargs.items()})

    def _fit(self, df: DataFrame) -> EncodeCategoriesModel:
        fold = self.getOrDefault(self.foldCol)
        by = F.col(fold) if fold in df.columns else fold_of(self.getOrDefault(self.keyCols), 5)
        maps, mean = fit_category_maps(df, self.getOrDefault(self.inputCols), self.getOrDefault(self.labelCol), by, self.getOrDefault(self.smoothing))
        return self._fitted(EncodeCategoriesModel({"mean": mean}, {"maps": maps}))


# ---- vector ----------------------------------------------------------------------------------

class _ImputeParams(Params):
    inputCols = _param("inputCols", "numeric columns", _TEXTS)
    extraCols = _param("extraCols", "columns without missing values that join the vector", _TEXTS)
    outputCol = _param("outputCol", "array of doubles", _TEXT)


class ImputeMediansModel(_Fitted, _ImputeParams):
    def _transform(self, df: DataFrame) -> DataFrame:
        m = ImputerModel(**self.state)
        cells = [*m.medians, *[f"{m.prefix}{c}" for c in m.indicators], *self.getOrDefault(self.extraCols)]
        absent = [c for c in m.medians if c not in df.columns]
        whole = df.withColumns({c: F.lit(None).cast("double") for c in absent}) if absent else df
        return with_vector(whole, m, cells, self.getOrDefault(self.outputCol))


class ImputeMedians(_Stage, _ImputeParams):
    """Exact medians, missing indicators, and all of it as one array column."""

    @keyword_only
    def __init__(self, *, inputCols=(), extraCols=(), outputCol="features"):
        super().__init__()
        self._setDefault(inputCols=[], extraCols=[], outputCol="features")
        self._set(**{k: list(v) if isinstance(v, tuple) else v for k, v in self._input_kwargs.items()})

    def _fit(self, df: DataFrame) -> ImputeMediansModel:
        m = MedianImputer(self.getOrDefault(self.inputCols)).fit(df)
        return self._fitted(ImputeMediansModel({"medians": m.medians, "indicators": m.indicators, "dropped": m.dropped}))


# ---- trees -----------------------------------------------------------------------------------

class _TreeParams(Params):
    featuresCol = _param("featuresCol", "array of doubles", _TEXT)
    labelCol = _param("labelCol", "label", _TEXT)
    predictionCol = _param("predictionCol", "prediction", _TEXT)
    numTrees = _param("numTrees", "trees", _INT)
    featureFraction = _param("featureFraction", "share of the varying features drawn at a node", _FLOAT)
    minInstances = _param("minInstances", "rows of a leaf at least", _INT)
    maxDepth = _param("maxDepth", "depth of a tree at most; 0: no bound", _INT)
    seed = _param("seed", "seed", _INT)
    localRows = _param("localRows", "rows of a node that one task grows", _INT)


class ExtraTreesModel(_Fitted, _TreeParams):
    def _transform(self, df: DataFrame) -> DataFrame:
        forest = Forest(self.tables["trees"], self.state["trees"], self.state["width"])
        return forest.predict(df, self.getOrDefault(self.featuresCol), self.getOrDefault(self.predictionCol))


class ExtraTrees(_Stage, _TreeParams):
    """Extremely randomised trees."""

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="normalised", predictionCol="prediction", numTrees=1500, featureFraction=0.65,
                 minInstances=1, maxDepth=0, seed=100, localRows=20_000):
        super().__init__()
        self._setDefault(featuresCol="features", labelCol="normalised", predictionCol="prediction", numTrees=1500, featureFraction=0.65,
                         minInstances=1, maxDepth=0, seed=100, localRows=20_000)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> ExtraTreesModel:
        get = self.getOrDefault
        p = TreeParams(get(self.numTrees), get(self.featureFraction), get(self.minInstances), get(self.maxDepth) or None, get(self.seed), get(self.localRows))
        rows = df.select(F.col(get(self.featuresCol)).alias("x"), F.col(get(self.labelCol)).alias("y"))
        forest = fit_forest(rows, p)
        return self._fitted(ExtraTreesModel({"trees": forest.n_trees, "width": forest.width}, {"trees": forest.trees}))
