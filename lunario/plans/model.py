"""From features to a model: encode, assemble, fit, tune, score, explain, keep. All on Spark ML."""

from __future__ import annotations

import itertools
import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator, Evaluator, MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import OneHotEncoder, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lunario.types import need_columns, need_numeric, need_rows

MULTICLASS = {
    "f1", "accuracy", "weightedPrecision", "weightedRecall", "weightedTruePositiveRate", "weightedFalsePositiveRate", "weightedFMeasure", "truePositiveRateByLabel",
    "falsePositiveRateByLabel", "precisionByLabel", "recallByLabel", "fMeasureByLabel", "logLoss", "hammingLoss",
}
BINARY, REGRESSION = {"areaUnderROC", "areaUnderPR"}, {"rmse", "mse", "r2", "mae", "var"}
TYPES = ("binary_classification", "multiclass_classification", "regression")


def evaluator(metric: str, label: str = "label", prediction: str = "prediction", raw: str = "rawPrediction", probability: str = "probability") -> Evaluator:
    if metric in MULTICLASS:
        return MulticlassClassificationEvaluator(metricName=metric, labelCol=label, predictionCol=prediction, probabilityCol=probability)
    if metric in BINARY:
        return BinaryClassificationEvaluator(metricName=metric, labelCol=label, rawPredictionCol=raw)
    if metric in REGRESSION:
        return RegressionEvaluator(metricName=metric, labelCol=label, predictionCol=prediction)
    raise ValueError("Metric not supported")


def estimator(kind: str, features: str = "features", label: str = "label", params: dict | None = None, num_workers: int | None = None, objective: str | None = None) -> Estimator:
    """Boosted trees for two classes and for values, one against the rest or a forest (``forest=True``) for more classes.

    ``num_workers`` is taken for configs; the number of tasks is that of the table's partitions. ``objective`` is the
    loss of the boosted trees (regression: ``squared`` or ``absolute``; classes: ``logistic``).
    """
    params = dict(params or {}) | ({"lossType": objective} if objective else {})
    forest = params.pop("forest", False)
    if kind == "regression":
        return GBTRegressor(featuresCol=features, labelCol=label, **params)
    if kind == "binary_classification":
        return GBTClassifier(featuresCol=features, labelCol=label, **params)
    if kind == "multiclass_classification":
        if forest:
            return RandomForestClassifier(featuresCol=features, labelCol=label, **params)
        return OneVsRest(classifier=GBTClassifier(featuresCol=features, labelCol=label, **params), featuresCol=features, labelCol=label)
    raise ValueError(f"Type {kind} is not one of {TYPES}")


def label_encode(df: DataFrame, columns: Sequence[str], model: StringIndexerModel | None = None, order: str = "ascending") -> tuple[DataFrame, StringIndexerModel, dict[str, list[str]]]:
    """Categories as whole numbers by frequency; the names returned are in the order of the numbers."""
    need_columns(df, columns)
    temp = [f"{c}_encoded" for c in columns]
    if model is None:
        by = {"ascending": "frequencyAsc", "descending": "frequencyDesc"}[order]
        model = StringIndexer(inputCols=list(columns), outputCols=temp, stringOrderType=by, handleInvalid="keep").fit(df)
    out = model.transform(df).drop(*columns).withColumnsRenamed(dict(zip(temp, columns, strict=True)))
    return out, model, {c: list(a) for c, a in zip(columns, model.labelsArray, strict=True)}


def one_hot_encode(df: DataFrame, columns: Sequence[str], drop_last: bool = True, model: PipelineModel | None = None) -> tuple[DataFrame, PipelineModel, dict[str, list[str]]]:
    """Categories as vectors with one 1; names of their slots. With ``model`` a fitted encoding is applied, so that two tables share their slots."""
    need_columns(df, columns)
    index, temp = [f"{c}_index" for c in columns], [f"{c}_vector" for c in columns]
    stages = [StringIndexer(inputCols=list(columns), outputCols=index, handleInvalid="error"), OneHotEncoder(inputCols=index, outputCols=temp, dropLast=drop_last)]
    model = model or Pipeline(stages=stages).fit(df)
    names = {c: list(a)[: -1 if model.stages[1].getDropLast() else None] for c, a in zip(columns, model.stages[0].labelsArray, strict=True)}
    out = model.transform(df).drop(*columns, *index).withColumnsRenamed(dict(zip(temp, columns, strict=True)))
    return out, model, names


def slot_names(df: DataFrame, columns: Sequence[str], encoding: dict[str, list[str]] | None = None) -> list[str]:
    """A name for every slot of the assembled vector; the sizes of vector columns are read in one row."""
    vectors = [c for c in columns if df.schema[c].dataType.typeName() == "vectorudt"]
    row = df.select(*vectors).first() if vectors else None
    out = []
    for c in columns:
        if c not in vectors:
            out.append(c)
        else:
            n = len(row[c]) if row else 0
            given = (encoding or {}).get(c) or []
            out += [f"{c}_{given[k] if k < len(given) else k}" for k in range(n)]
    return out


def vector_assemble(df: DataFrame, columns: Sequence[str], output: str = "features", handle_invalid: str = "keep", encoding: dict[str, list[str]] | None = None) -> tuple[DataFrame, list[str]]:
    """The columns as one vector, and the names of its slots."""
    need_columns(df, columns)
    return VectorAssembler(inputCols=list(columns), outputCol=output, handleInvalid=handle_invalid).transform(df), slot_names(df, columns, encoding)


def features_columns(df: DataFrame, excluded: Sequence[str]) -> list[str]:
    return [c for c in df.columns if c not in set(excluded)]


def combinations(params: dict) -> list[dict]:
    """Every choice of one value from each list; single values stand in all."""
    lists = [v if isinstance(v, list | tuple) else [v] for v in params.values()]
    return [dict(zip(params, c, strict=True)) for c in itertools.product(*lists)]


def better(metric: str) -> str:
    return "max" if evaluator(metric).isLargerBetter() else "min"


def tune(train: DataFrame, validation: DataFrame, kind: str, params: dict, metric: str, mode: str | None = None, features: str = "features", label: str = "label", objective: str | None = None) -> tuple[dict, float, list]:
    """(best parameters, best score, all scores) of a grid on a held-out table. Every score can win, whatever its sign."""
    judge, sign = evaluator(metric, label), 1 if (mode or better(metric)) == "max" else -1
    scores = [(c, judge.evaluate(estimator(kind, features, label, c, objective=objective).fit(train).transform(validation))) for c in combinations(params)]
    best = max(scores, key=lambda x: sign * x[1])
    return best[0], best[1], scores


def tune_cv(df: DataFrame, base: Estimator, params: dict, judge: Evaluator, folds: int = 3, parallelism: int = 1, seed: int = 0) -> tuple[Model, list[float]]:
    """(best model, mean score of each combination) by cross-validation; lists are searched, single values are set."""
    grid = ParamGridBuilder()
    for name, value in params.items():
        p = base.getParam(name)
        grid = grid.addGrid(p, list(value)) if isinstance(value, list | tuple) else grid.baseOn({p: value})
    cv = CrossValidator(estimator=base, estimatorParamMaps=grid.build(), evaluator=judge, numFolds=folds, parallelism=parallelism, seed=seed).fit(df)
    return cv.bestModel, list(cv.avgMetrics)


def score_cv(df: DataFrame, base: Estimator, judge: Evaluator, folds: int = 3, parallelism: int = 1, seed: int = 0) -> float:
    """Mean score over folds of an estimator as it is."""
    return CrossValidator(estimator=base, estimatorParamMaps=[{}], evaluator=judge, numFolds=folds, parallelism=parallelism, seed=seed).fit(df).avgMetrics[0]


IMPORTANCES = ("weight", "gain", "cover", "total_gain", "total_cover")


def importances(model, names: Sequence[str], kind: str = "weight") -> dict[str, float]:
    """Of each feature: ``weight`` splits, ``gain`` and ``cover`` per split or in total; 0 for features that no tree uses."""
    if kind not in IMPORTANCES:
        raise ValueError(f"Importance type {kind} is not one of {IMPORTANCES}")
    splits, gain, cover = ([0.0] * len(names) for _ in range(3))
    trees = getattr(model, "trees", None) or [t for m in model.models for t in m.trees]
    for tree in trees:
        stack = [tree._java_obj.rootNode()]
        while stack:
            node = stack.pop()
            if node.subtreeDepth() == 0:
                continue
            k = node.split().featureIndex()
            splits[k] += 1
            gain[k] += node.gain()
            cover[k] += node.impurityStats().count()
            stack += [node.leftChild(), node.rightChild()]
    total = {"weight": splits, "total_gain": gain, "total_cover": cover}
    if kind in total:
        return dict(zip(names, total[kind], strict=True))
    values = gain if kind == "gain" else cover
    return {n: v / s if s else 0.0 for n, v, s in zip(names, values, splits, strict=True)}


@dataclass
class TrainingHelper:
    """One object from raw columns to predictions.

    Ordered categories become numbers, unordered ones vectors, in stages of their own; with the numeric features they
    are assembled into one vector. Categories not met when fitting are an error for vectors and a number of their own
    for ordered ones.
    """

    type: str
    features_cols_name: list[str]
    label_col_name: str
    ordered_categ_features_cols_name: list[str] = field(default_factory=list)
    unordered_categ_features_cols_name: list[str] = field(default_factory=list)
    num_workers: int | None = None

    def __post_init__(self) -> None:
        if self.type not in TYPES:
            raise ValueError(f"Type {self.type} is not one of {TYPES}")
        for c in [*self.ordered_categ_features_cols_name, *self.unordered_categ_features_cols_name]:
            if c not in self.features_cols_name:
                raise ValueError(f"Column {c} is not a feature")
        self.preparation: PipelineModel | None = None
        self.model: Model | None = None
        self.names: list[str] = []

    def _prepare(self, df: DataFrame, fit: bool) -> DataFrame:
        need_columns(df, self.features_cols_name)
        ordered, unordered = self.ordered_categ_features_cols_name, self.unordered_categ_features_cols_name
        plain = [c for c in self.features_cols_name if c not in {*ordered, *unordered}]
        need_numeric(df, plain)
        if fit:
            stages: list = []
            if ordered:
                stages.append(StringIndexer(inputCols=ordered, outputCols=[f"{c}__o" for c in ordered], stringOrderType="alphabetAsc", handleInvalid="keep"))
            if unordered:
                stages.append(StringIndexer(inputCols=unordered, outputCols=[f"{c}__i" for c in unordered]))
                stages.append(OneHotEncoder(inputCols=[f"{c}__i" for c in unordered], outputCols=[f"{c}__v" for c in unordered]))
            stages.append(VectorAssembler(inputCols=[*plain, *(f"{c}__o" for c in ordered), *(f"{c}__v" for c in unordered)], outputCol="features", handleInvalid="keep"))
            self.preparation = Pipeline(stages=stages).fit(df)
            labels = self.preparation.stages[1 if ordered else 0].labelsArray if unordered else []
            self.names = [*plain, *ordered, *(f"{c}_{v}" for c, a in zip(unordered, labels, strict=True) for v in list(a)[:-1])]
        if self.preparation is None:
            raise ValueError("Fit first")
        made = [*(f"{c}__o" for c in ordered), *(f"{c}__i" for c in unordered), *(f"{c}__v" for c in unordered)]
        return self.preparation.transform(df).drop(*made)

    def fit(self, df: DataFrame, objective: str | None = None, params: dict | None = None) -> TrainingHelper:
        """Fit with single-valued parameters; ``objective`` is a loss of the estimator (regression: squared or absolute)."""
        if any(isinstance(v, list | tuple) for v in (params or {}).values()):
            raise ValueError("Parameters of fit have single values; use tune for lists")
        need_rows(df)
        self.model = estimator(self.type, "features", self.label_col_name, params, objective=objective).fit(self._prepare(df, True))
        return self

    def _metric(self, metric: str | None) -> str:
        return metric or ("rmse" if self.type == "regression" else "f1")

    def tune(self, train: DataFrame, validation: DataFrame, params: dict, metric: str | None = None, mode: str | None = None, objective: str | None = None) -> tuple[dict, float, list]:
        """Search a grid on a held-out table, then keep the model of the best parameters."""
        prepared = self._prepare(train, True)
        best, value, scores = tune(prepared, self._prepare(validation, False), self.type, params, self._metric(metric), mode, "features", self.label_col_name, objective)
        self.model = estimator(self.type, "features", self.label_col_name, best, objective=objective).fit(prepared)
        return best, value, scores

    def tune_cv(self, df: DataFrame, params: dict, metric: str | None = None, folds: int = 5, objective: str | None = None) -> list[float]:
        base = estimator(self.type, "features", self.label_col_name, objective=objective)
        self.model, means = tune_cv(self._prepare(df, True), base, params, evaluator(self._metric(metric), self.label_col_name), folds)
        return means

    def predict(self, df: DataFrame) -> DataFrame:
        if self.model is None:
            raise ValueError("Fit first")
        return self.model.transform(self._prepare(df, False))

    def score(self, predicted: DataFrame, metric: str | None = None) -> float:
        need_columns(predicted, ["prediction", self.label_col_name])
        return evaluator(self._metric(metric), self.label_col_name).evaluate(predicted)

    def parameters(self, with_none: bool = False, with_doc: bool = False) -> dict[str, object]:
        """The model's parameters; with ``with_doc`` each as (value, what it means)."""
        params = {p.name: (v, p.doc) if with_doc else v for p, v in self.model.extractParamMap().items() if with_none or v is not None}
        return params

    def feature_importance(self, spark: SparkSession, kind: str = "weight") -> DataFrame:
        rows = list(importances(self.model, self.names, kind).items())
        return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")

    def save(self, spark: SparkSession, path: str) -> None:
        """Model, preparation and settings below a folder of any file system that Spark reaches."""
        self.model.write().overwrite().save(f"{path}/model")
        self.preparation.write().overwrite().save(f"{path}/preparation")
        settings = json.dumps({"settings": asdict(self), "names": self.names, "class": f"{type(self.model).__module__}.{type(self.model).__name__}"})
        spark.createDataFrame([(settings,)], "json string").coalesce(1).write.mode("overwrite").text(f"{path}/settings")

    @staticmethod
    def load(spark: SparkSession, path: str) -> TrainingHelper:
        import importlib

        where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/settings")
        if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
            raise FileNotFoundError(f"{path}/settings")
        kept = json.loads(spark.read.text(f"{path}/settings").first()[0])
        helper = TrainingHelper(**kept["settings"])
        module, _, name = kept["class"].rpartition(".")
        if not module.startswith("pyspark.ml."):
            raise ValueError(f"{kept['class']} is not a model of Spark")
        helper.model = getattr(importlib.import_module(module), name).load(f"{path}/model")
        helper.preparation, helper.names = PipelineModel.load(f"{path}/preparation"), kept["names"]
        return helper
