"""Models that are trained, kept with versions, and used again."""

from __future__ import annotations

import json
from datetime import UTC, datetime

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator, MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import INTERNAL, NOT_FOUND, EngineError
from .base import Operator, columns_of, dealt, number, require

ALGORITHMS = ("kmeans", "random_forest", "gbt", "random_forest_regression")


class ModelRegistry:
    """Model versions in a folder that the cluster shares; every training of a name makes a new version."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _versions(self, name: str) -> list[int]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        return sorted(int(x.getPath().getName()) for x in fs.listStatus(path) if x.getPath().getName().isdigit())

    def save(self, name: str, model: PipelineModel, about: dict) -> int:
        version = max(self._versions(name), default=0) + 1
        model.write().save(f"{self.folder}/{name}/{version}/model")
        self.spark.createDataFrame([(json.dumps(about | {"version": version, "trained": datetime.now(UTC).isoformat()}),)], "value string").coalesce(1).write.text(f"{self.folder}/{name}/{version}/about")
        return version

    def load(self, name: str, version: int | None = None) -> tuple[PipelineModel, dict]:
        found = self._versions(name)
        version = version or max(found, default=0)
        if version not in found:
            raise EngineError(f"model not found: {name}", NOT_FOUND)
        about = json.loads(self.spark.read.text(f"{self.folder}/{name}/{version}/about").first()[0])
        return PipelineModel.load(f"{self.folder}/{name}/{version}/model"), about

    def list(self, name: str) -> list[dict]:
        return [self.load(name, v)[1] for v in self._versions(name)]


def operators(registry: ModelRegistry) -> list[Operator]:
    """model.train, model.predict and model.evaluate on a registry."""

    def train(frames: list[DataFrame], params: dict[str, str]) -> DataFrame:
        """Trains `algorithm` on `columns` (and `label`) and keeps it as `name`; returns name, version, algorithm, rows."""
        df, kind = frames[0], params.get("algorithm", "kmeans")
        if kind not in ALGORITHMS:
            raise EngineError(f"unknown algorithm: {kind}; known: {', '.join(ALGORITHMS)}", INTERNAL)
        label = None if kind == "kmeans" else require(df, params.get("label") or params.get("target") or "label")
        names = [c for c in columns_of(df, params) if c != label]
        data = df.dropna(subset=[*names, *([label] if label else [])])
        prepared, after, kept = [VectorAssembler(inputCols=names, outputCol="_features")], [], ["_features"]
        seed, trees = int(number(params, "seed", 1)), int(number(params, "trees", 20))
        if kind == "kmeans":
            made = KMeans(featuresCol="_features", predictionCol="prediction", k=int(number(params, "k", 2)), seed=seed)
        elif kind == "random_forest_regression":
            made = RandomForestRegressor(featuresCol="_features", labelCol=label, predictionCol="prediction", numTrees=trees, seed=seed)
            kept.append(f"`{label}`")
        else:
            index = StringIndexer(inputCol=label, outputCol="_label", handleInvalid="skip").fit(data)
            made = RandomForestClassifier(featuresCol="_features", labelCol="_label", predictionCol="_prediction", numTrees=trees, seed=seed) if kind == "random_forest" else GBTClassifier(featuresCol="_features", labelCol="_label", predictionCol="_prediction", maxIter=trees, seed=seed)
            prepared.append(index)
            after.append(IndexToString(inputCol="_prediction", outputCol="prediction", labels=index.labels))
            kept.append("_label")
        name, rows = params.get("name", kind), data.count()
        fitted = made.fit(dealt(PipelineModel(prepared).transform(data).select(*kept), rows, len(names)))
        version = registry.save(name, PipelineModel([*prepared, fitted, *after]), {"name": name, "algorithm": kind, "columns": names, "label": label})
        return df.sparkSession.createDataFrame([(name, version, kind, rows)], "name string, version int, algorithm string, rows bigint")

    def _apply(df: DataFrame, params: dict[str, str]) -> tuple[DataFrame, dict]:
        model, about = registry.load(params.get("name", ""), int(number(params, "version", 0)) or None)
        # A label that isn't there stays out: its indexer is for training only.
        stages = [s for s in model.stages if not (s.hasParam("inputCol") and s.isDefined("inputCol") and s.getInputCol() == about["label"] and about["label"] not in df.columns)]
        for s in stages:
            df = s.transform(df)
        return df, about

    def predict(frames: list[DataFrame], params: dict[str, str]) -> DataFrame:
        """The rows with a column prediction, by the newest version of `name` or by `version`."""
        scored, _ = _apply(frames[0], params)
        return scored.select(*(f"`{c}`" for c in frames[0].columns), "prediction")

    def evaluate(frames: list[DataFrame], params: dict[str, str]) -> DataFrame:
        """metric and value on rows that have the label."""
        scored, about = _apply(frames[0], params)
        if about["algorithm"] == "kmeans":
            found = [("silhouette", ClusteringEvaluator(featuresCol="_features", predictionCol="prediction").evaluate(scored))]
        elif about["algorithm"] == "random_forest_regression":
            found = [(m, RegressionEvaluator(labelCol=about["label"], predictionCol="prediction", metricName=m).evaluate(scored)) for m in ("rmse", "r2")]
        else:
            found = [(m, MulticlassClassificationEvaluator(labelCol="_label", predictionCol="_prediction", metricName=m).evaluate(scored.withColumn("_prediction", F.col("_prediction").cast("double")))) for m in ("accuracy", "f1")]
        return frames[0].sparkSession.createDataFrame(found, "metric string, value double")

    return [Operator("model", f.__name__, f, (f.__doc__ or "").strip()) for f in (train, predict, evaluate)]
