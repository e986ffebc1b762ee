"""Fitted models kept in a shared folder, so that a model is fitted once and used by many queries."""

from __future__ import annotations

import pickle
from collections.abc import Callable

from pyspark.sql import SparkSession

#: Setting that names the folder; without it every query fits its own model.
SETTING = "spark.tessera.models"


def kept(spark: SparkSession, name: str, fit: Callable[[], object]) -> object:
    """The model ``name`` of the folder that SETTING names, fitted and written there if it is missing; just fitted without the setting.

    The folder is trusted: models are Python objects. A model stays until it is removed, whatever tables it was fitted on.
    """
    folder = spark.conf.get(SETTING, None)
    if not folder:
        return fit()
    path = f"{folder}/{name}"
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    if done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        return pickle.loads(spark.read.parquet(path).first()["model"])
    model = fit()
    spark.createDataFrame([(pickle.dumps(model),)], "model binary").coalesce(1).write.mode("overwrite").parquet(path)
    return model
