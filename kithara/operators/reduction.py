"""Standardizing and projecting embeddings; a transform may be fitted to one frame and applied to another."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def moments(points: DataFrame, vector: str = "embedding") -> tuple[list[float], list[float]]:
    """Means and population standard deviations by dimension; a deviation of 0 counts as 1."""
    v = array_to_vector(F.col(vector).cast("array<double>"))
    row = points.select(v.alias("v")).agg(Summarizer.metrics("mean", "std", "count").summary(F.col("v")).alias("s")).first()["s"]
    n = row["count"]
    std = np.asarray(row["std"].toArray()) * np.sqrt((n - 1) / n) if n > 1 else np.zeros(len(row["mean"]))
    return [float(x) for x in row["mean"].toArray()], [float(x) if x > 1e-12 else 1.0 for x in std]


def standardized(points: DataFrame, vector: str = "embedding", fit_on: DataFrame | None = None) -> DataFrame:
    """The points with `vector` centred and scaled by dimension."""
    mean, std = moments(fit_on if fit_on is not None else points, vector)
    m, s = F.array(*map(F.lit, mean)), F.array(*map(F.lit, std))
    x = F.zip_with(F.zip_with(F.col(vector).cast("array<double>"), m, lambda a, b: a - b), s, lambda a, b: a / b)
    return points.withColumn(vector, x)


def reduced(points: DataFrame, k: int = 50, vector: str = "embedding") -> DataFrame:
    """The points with `vector` standardized and projected to its first k principal components."""
    return BackgroundTransform.fit(points, k, vector).transform(points)


@dataclass
class BackgroundTransform:
    """A scaler and a projection, fitted to the background alone."""

    model: PipelineModel
    vector: str

    @classmethod
    def fit(cls, points: DataFrame, k: int = 50, vector: str = "embedding") -> BackgroundTransform:
        v = points.select(array_to_vector(F.col(vector).cast("array<double>")).alias("_v"))
        first = v.first()
        k = min(k, len(first["_v"])) if first else k
        # Scaling by sample instead of population deviation differs by one factor for all dimensions.
        steps = [StandardScaler(withMean=True, withStd=True, inputCol="_v", outputCol="_s"), PCA(k=k, inputCol="_s", outputCol="_p")]
        return cls(Pipeline(stages=steps).fit(v), vector)

    def transform(self, points: DataFrame) -> DataFrame:
        own = points.withColumn("_v", array_to_vector(F.col(self.vector).cast("array<double>")))
        out = self.model.transform(own)
        return out.withColumn(self.vector, vector_to_array("_p")).drop("_v", "_s", "_p")

    def metadata(self) -> dict:
        scaler, pca = self.model.stages
        return {"n_features": len(scaler.mean), "n_components": pca.getK(), "explained_variance_ratio": [float(x) for x in pca.explainedVariance.toArray()]}

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(path)

    @classmethod
    def load(cls, path: str, vector: str = "embedding") -> BackgroundTransform:
        return cls(PipelineModel.load(path), vector)
