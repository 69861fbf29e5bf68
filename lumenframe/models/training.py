"""Train, score, save, reload and compare models on one table.

Missing numbers are filled with the training mean inside the pipeline, so every row is scored; a row whose
array of features is missing cannot be, and its prediction is null. A test row of a class that training
never saw counts as wrong; a row without a target takes no part in training or scores.

Encoding and scaling are stages of the fitted pipeline, so test rows and later rows get exactly the
preparation that the training rows got.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Imputer, StandardScaler, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenframe.functions.stats import number, string_columns
from lumenframe.metrics import classification, clustering, regression
from lumenframe.models import boost, forest, histogram, importance, kernel
from lumenframe.models.neighbors import DensityModel, NeighborModel, fit_neighbors
from lumenframe.models.estimators import estimator
from lumenframe.operators.splits import holdout, k_folds, stratified_folds
from lumenframe.session import cut_lineage


@dataclass(frozen=True)
class TrainingConfig:
    """What to train: task, algorithm, parameters, columns and split."""

    task: str
    algorithm: str
    key: str
    target: str | None = None
    features: tuple[str, ...] = ()
    params: dict = field(default_factory=dict)
    test_fraction: float = 0.2
    seed: int = 42
    scale: bool = True


@dataclass
class TrainingResult:
    """A fitted model with its scored test rows and metric rows."""

    model: object
    prepare: PipelineModel
    test: DataFrame
    metrics: dict[str, float]
    features: list[str]
    train_rows: int


#: Boosting on histograms; the first two keep missing values, whose side is learned.
LEARN_GAPS = ("XGBoost", "LightGBM")


def _on_histograms(config: TrainingConfig) -> bool:
    return config.algorithm in (*LEARN_GAPS, "Gradient Boosting Classifier")


# Columns that the steps of this module add to a table.
HELPERS = ("label", "target_text", "is_test", "fold")


def _candidates(df: DataFrame, config: TrainingConfig) -> list[str]:
    """Every column of the source table that may serve as a feature."""
    vectors = {f"{f.name}_vec" for f in df.schema if isinstance(f.dataType, T.ArrayType)}
    return [c for c in df.columns if c not in (config.key, config.target, *HELPERS) and c not in vectors]


def _preparation(df: DataFrame, config: TrainingConfig) -> tuple[list, list[str]]:
    """Stages that turn a table into ``features`` and ``label``."""
    features = list(config.features or _candidates(df, config))
    texts = [c for c in features if c in string_columns(df)]
    stages = []
    if texts:
        stages.append(
            StringIndexer(
                inputCols=texts, outputCols=[f"{c}_code" for c in texts], stringOrderType="alphabetAsc", handleInvalid="keep"
            )
        )
    arrays = [c for c in features if isinstance(df.schema[c].dataType, T.ArrayType)]
    plain = [c for c in features if c not in texts and c not in arrays]
    if plain:
        # A column without any value has no mean and says nothing.
        held = df.agg(*[F.count(number(c)).alias(c) for c in plain]).first()
        features = [c for c in features if c not in plain or held[c]]
        plain = [c for c in plain if held[c]]
    gaps = config.algorithm in LEARN_GAPS
    if plain and not gaps:
        stages.append(Imputer(inputCols=plain, outputCols=[f"{c}_full" for c in plain], strategy="mean"))
    inputs = [f"{c}_code" if c in texts else f"{c}_vec" if c in arrays else c if gaps else f"{c}_full" for c in features]
    scale = config.scale and not gaps  # a tree asks for the order of values only, and a gap has no mean to subtract
    raw = "raw_features" if scale else "features"
    stages.append(VectorAssembler(inputCols=inputs, outputCol=raw, handleInvalid="keep" if gaps and not arrays else "skip"))
    if scale:
        stages.append(StandardScaler(inputCol=raw, outputCol="features", withMean=True, withStd=True))
    if config.task == "classification":
        # Labels are indexed as text, so every kind of target works the same way.
        stages.append(
            StringIndexer(inputCol="target_text", outputCol="label", stringOrderType="alphabetAsc", handleInvalid="skip")
        )
    return stages, features


def shaped(df: DataFrame, config: TrainingConfig) -> DataFrame:
    """Cast columns the way the stages expect them."""
    out = df
    for f in df.schema:
        if isinstance(f.dataType, T.ArrayType):
            out = out.withColumn(f"{f.name}_vec", array_to_vector(F.col(f.name).cast("array<double>")))
    for c in config.features or _candidates(df, config):
        if isinstance(df.schema[c].dataType, (T.NumericType, T.BooleanType)):
            out = out.withColumn(c, F.col(c).cast("double"))
    if config.task == "classification" and config.target in df.columns:
        out = out.withColumn("target_text", F.col(config.target).cast("string"))
    elif config.task == "regression" and config.target in df.columns:
        out = out.withColumn("label", F.col(config.target).cast("double"))
    return out


def fit(train: DataFrame, config: TrainingConfig) -> tuple[PipelineModel, object, list[str]]:
    """Fit the preparation and the model on training rows only."""
    stages, features = _preparation(train, config)
    prepare = Pipeline(stages=stages).fit(train)
    ready = prepare.transform(train)
    classes = 0
    if config.task == "classification":
        classes = len(prepare.stages[-1].labels)
        prepare.stages[-1].setHandleInvalid("keep")  # from here on, an unseen class is a label of its own
    if config.algorithm == "AdaBoost Classifier":
        rounds = int(config.params.get("n_estimators") or 50)
        return prepare, boost.fit_classifier(ready, classes, rounds=rounds), features
    if config.algorithm == "AdaBoost Regressor":
        rounds = int(config.params.get("n_estimators") or 50)
        return prepare, boost.fit_regressor(ready, rounds=rounds), features
    if _on_histograms(config):
        return prepare, histogram.fit(ready, classes, histogram.settings(config.algorithm, config.params)), features
    if config.algorithm.startswith(("Decision Tree", "Random Forest")):
        first = ready.select("features").first()
        s = forest.settings(config.algorithm, config.params, len(first[0]) if first else 1)
        return prepare, forest.fit(ready, classes, s), features
    if config.algorithm.startswith("Support Vector"):
        return prepare, kernel.fit(ready, classes, kernel.settings(config.params)), features
    if config.algorithm in ("KNN Classifier", "KNN Regressor"):
        votes = config.algorithm == "KNN Classifier"
        return prepare, fit_neighbors(ready, config.key, int(config.params.get("n_neighbors") or 5), votes), features
    if config.algorithm in ("DBSCAN", "DBSCAN Clustering"):
        width = len(ready.select("features").first()[0])
        need = int(config.params.get("min_samples") or 5)
        return prepare, DensityModel(config.key, float(config.params.get("eps") or 0.5), need, width), features
    rows = ready.count()
    stage = estimator(config.task, config.algorithm, config.params, rows=rows)
    return prepare, stage.fit(ready), features


def score(df: DataFrame, task: str, *, auc: bool = True) -> dict[str, float]:
    """Metrics of rows that hold ``label`` (or ``features``) and ``prediction``."""
    if task == "classification":
        out = classification.weighted(df, "label", "prediction").first().asDict()
        if auc and "probability" in df.columns:
            spread = df.withColumn("_p", vector_to_array("probability"))
            size = spread.select(F.max(F.size("_p"))).first()[0]
            cols = {float(i): f"_p{i}" for i in range(size or 0)}
            spread = spread.withColumns({c: F.col("_p")[int(i)] for i, c in cols.items()})
            if len(cols) > 1:
                out["roc_auc"] = classification.auc_one_vs_rest(spread, "label", cols).first()[0]
        return out
    if task == "regression":
        return regression.all_metrics(df, "label", "prediction").first().asDict()
    if df.select("prediction").distinct().limit(2).count() < 2:
        # One cluster has no separation to measure.
        return {"silhouette_squared": None, "davies_bouldin": None, "calinski_harabasz": None}
    arrays = df.withColumn("_x", vector_to_array("features"))
    return {
        "silhouette_squared": clustering.silhouette_squared(arrays, "prediction", "_x"),
        "davies_bouldin": clustering.davies_bouldin(arrays, "prediction", "_x").first()[0],
        "calinski_harabasz": clustering.calinski_harabasz(arrays, "prediction", "_x").first()[0],
    }


def train(df: DataFrame, config: TrainingConfig) -> TrainingResult:
    """Split, fit on the training part, score the test part."""
    data = shaped(df, config)
    marked = None
    if config.task == "clustering":
        parts, test_part = data, data
    else:
        data = data.where(F.col(config.target).isNotNull())
        by = config.target if config.task == "classification" else None
        marked = holdout(data, config.key, config.test_fraction, config.seed, by=by).persist()
        parts, test_part = marked.where(~F.col("is_test")), marked.where("is_test")
    prepare, model, features = fit(parts, config)
    test = model.transform(prepare.transform(test_part))
    # Test rows go through the model once; every metric reads what was written.
    read = ("label", "prediction", "probability", "features" if config.task == "clustering" else "prediction")
    scored = cut_lineage(test.select(*[c for c in dict.fromkeys(read) if c in test.columns]))
    result = TrainingResult(model, prepare, test, score(scored, config.task), features, parts.count())
    if marked is not None:
        marked.unpersist()
    return result


def metric_rows(spark, run_id: str, metrics: dict[str, float]) -> DataFrame:
    """Metrics as ``(run_id, metric, value)``."""
    rows = [(run_id, m, None if v is None else float(v)) for m, v in metrics.items()]
    return spark.createDataFrame(rows, "run_id string, metric string, value double")


def fit_many(df: DataFrame, configs: dict[str, TrainingConfig]) -> DataFrame:
    """Train several configurations; a failure becomes a row and does not stop the others."""
    rows = []
    data = df.persist()
    for run_id, config in configs.items():
        try:
            result = train(data, config)
            rows.append((run_id, config.algorithm, True, None, {k: float(v) for k, v in result.metrics.items() if v is not None}))
        except Exception as problem:
            rows.append((run_id, config.algorithm, False, str(problem) or type(problem).__name__, {}))
    data.unpersist()
    return df.sparkSession.createDataFrame(
        rows, "run_id string, algorithm string, success boolean, error string, metrics map<string,double>"
    )


def cross_validate(df: DataFrame, config: TrainingConfig, folds: int = 5) -> DataFrame:
    """``(metric, mean, std)`` of the test scores over the folds, population deviation."""
    data = shaped(df, config).where(F.col(config.target).isNotNull())
    if config.task == "classification":
        data = stratified_folds(data, config.key, config.target, folds, config.seed)
    else:
        data = k_folds(data, config.key, folds, config.seed)
    data = data.persist()
    rows = []
    for fold in range(folds):
        prepare, model, _ = fit(data.where(F.col("fold") != fold), config)
        test = model.transform(prepare.transform(data.where(F.col("fold") == fold)))
        rows += [(m, float(v)) for m, v in score(test, config.task).items() if v is not None]
    data.unpersist()
    table = df.sparkSession.createDataFrame(rows, "metric string, value double")
    return table.groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def save(prepare: PipelineModel, model, path: str) -> None:
    """Preparation and model: one pipeline, or side by side for models that are not Spark's own."""
    if hasattr(model, "uid"):
        PipelineModel(stages=[*prepare.stages, model]).write().overwrite().save(path)
        return
    if not hasattr(model, "save"):
        raise ValueError(f"{type(model).__name__} is bound to the rows it was given and cannot be saved")
    spark = SparkSession.active()
    prepare.write().overwrite().save(f"{path}/prepare")
    model.save(spark, f"{path}/model")
    spark.createDataFrame([(model.kind,)], "kind string").coalesce(1).write.mode("overwrite").parquet(f"{path}/kind")


def load(path: str) -> tuple[list, object | None]:
    """Stages of a saved pipeline, and the model that stands beside them if it is not Spark's own."""
    spark = SparkSession.active()
    try:
        kind = spark.read.schema("kind string").parquet(f"{path}/kind").first()["kind"]
    except AnalysisException:
        return PipelineModel.load(path).stages, None
    kinds = {m.kind: m for m in (boost.BoostedClassifier, boost.BoostedRegressor, histogram.BoostedTrees, forest.Forest, kernel.KernelMachine, NeighborModel)}
    return PipelineModel.load(f"{path}/prepare").stages, kinds[kind].load(spark, f"{path}/model")


def predict_batch(df: DataFrame, path: str, config: TrainingConfig) -> DataFrame:
    """Score every row with a saved pipeline; ``predicted_class`` is the class as the target spelled it.

    Rows need no target: the label stage only gives the names back.
    """
    stages, other = load(path)
    names = [s for s in stages if isinstance(s, StringIndexerModel) and s.isSet("outputCol") and s.getOutputCol() == "label"]
    data = shaped(df, config)
    arrays = [c for c in config.features or _candidates(df, config) if isinstance(df.schema[c].dataType, T.ArrayType)]
    whole = F.lit(True)
    for c in arrays:
        whole = whole & F.col(c).isNotNull()
    scored = PipelineModel(stages=[s for s in stages if s not in names]).transform(data.where(whole))
    if other is not None:
        scored = other.transform(scored)
    if names:
        labels = F.array(*map(F.lit, names[0].labels))
        scored = scored.withColumn("predicted_class", F.try_element_at(labels, F.col("prediction").cast("int") + 1))
    return scored.unionByName(data.where(~whole), allowMissingColumns=True) if arrays else scored


def with_confidence(scored: DataFrame) -> DataFrame:
    """Add the highest class probability."""
    return scored.withColumn("confidence", F.array_max(vector_to_array("probability")))


def feature_importance(result: TrainingResult) -> DataFrame:
    return importance.of_model(result.test.sparkSession, result.model, result.features)


def gaussian_parameters(df: DataFrame, label: str, cols: Sequence[str]) -> DataFrame:
    """Prior, mean and variance per class and column, as Gaussian naive Bayes uses them."""
    aggs = [F.count("*").alias("n")]
    for i, c in enumerate(cols):
        aggs += [F.avg(number(c)).alias(f"m{i}"), F.var_pop(number(c)).alias(f"v{i}")]
    rows = df.groupBy(label).agg(*aggs)
    cells = [
        F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("mean"), F.col(f"v{i}").alias("var"))
        for i, c in enumerate(cols)
    ]
    return rows.select(label, "n", F.inline(F.array(*cells)))
