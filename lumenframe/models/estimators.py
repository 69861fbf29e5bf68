"""Spark ML estimators by algorithm name, with the objective scaled as the named models define it."""

from __future__ import annotations

from pyspark.ml import Estimator
from pyspark.ml.classification import LogisticRegression, NaiveBayes
from pyspark.ml.clustering import KMeans
from pyspark.ml.regression import GBTRegressor, LinearRegression

SEED = 42


def _boost(params: dict) -> dict:
    out = {"maxDepth": int(params.get("max_depth") or 3), "seed": SEED, "maxIter": int(params.get("n_estimators") or 100)}
    if params.get("min_samples_leaf"):
        out["minInstancesPerNode"] = int(params["min_samples_leaf"])
    return {**out, "stepSize": float(params.get("learning_rate") or 0.1)}


def _classifier(name: str, params: dict, rows: int) -> Estimator:
    if name == "Logistic Regression":
        penalty = 1.0 / (float(params.get("C") or 1.0) * max(rows, 1))
        return LogisticRegression(maxIter=int(params.get("max_iter") or 100), regParam=penalty, standardization=False)
    if name == "Gaussian Naive Bayes":
        return NaiveBayes(modelType="gaussian")
    raise ValueError(f"unknown classification algorithm: {name}")


def _regressor(name: str, params: dict, rows: int) -> Estimator:
    alpha = float(params.get("alpha", 1.0))
    if name == "Linear Regression":
        return LinearRegression(regParam=0.0, solver="normal")
    if name in ("Ridge", "Ridge Regression"):
        return LinearRegression(elasticNetParam=0.0, regParam=alpha / max(rows, 1), standardization=False)
    if name in ("Lasso", "Lasso Regression"):
        return LinearRegression(elasticNetParam=1.0, regParam=alpha, standardization=False)
    if name == "ElasticNet":
        mix = float(params.get("l1_ratio", 0.5))
        return LinearRegression(elasticNetParam=mix, regParam=alpha, standardization=False)
    if name == "Gradient Boosting Regressor":
        return GBTRegressor(**_boost(params))
    raise ValueError(f"unknown regression algorithm: {name}")


def estimator(task: str, name: str, params: dict | None = None, *, rows: int = 1) -> Estimator:
    """An estimator that reads ``features`` and ``label``."""
    params = {k: v for k, v in (params or {}).items() if v is not None}
    if task == "classification":
        return _classifier(name, params, rows)
    if task == "regression":
        return _regressor(name, params, rows)
    if task == "clustering":
        if name in ("KMeans Clustering", "KMeans"):
            return KMeans(k=int(params.get("n_clusters") or 3), seed=SEED, initMode="k-means||")
        raise ValueError(f"unknown clustering algorithm: {name}")
    raise ValueError(f"unknown task: {task}")
