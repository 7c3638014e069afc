"""Model persistence through MLlib's writer/reader, under the shared folder."""

from __future__ import annotations

from pyspark.ml.util import MLReadable, MLWritable
from pyspark.sql import SparkSession

from ..session import shared_path


def save_model(spark: SparkSession, model: MLWritable, path: str | None = None) -> str:
    path = path or shared_path(spark, type(model).__name__.lower())
    model.write().overwrite().save(path)
    return path


def load_model(model_cls: type[MLReadable], path: str):
    return model_cls.load(path)
