"""Inference in batches: any callable on arrays, loaded once in each worker."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def predict(df: DataFrame, make: Callable[[], Callable[[np.ndarray], np.ndarray]], value: str, *, name: str = "prediction", batch_size: int = 256, shape: list[int] | None = None, kind: T.DataType | None = None, pre: Callable[[np.ndarray], np.ndarray] | None = None, output_key: str | None = None) -> DataFrame:
    """``name``: what the model gives for ``value`` (a number, or an array, of ``shape`` if stated). The model gets batches of at most ``batch_size`` rows.

    ``make`` runs once a worker and returns the model, ``pre`` prepares a batch, ``output_key`` takes one of several named outputs. A
    model that gives an array a row gives an array column unless ``kind`` says otherwise.
    """

    def load():
        model = make()

        def run(batch: np.ndarray):
            out = model(pre(batch) if pre else batch)
            return np.asarray(out[output_key] if output_key is not None else out)

        return run

    udf = predict_batch_udf(load, return_type=kind or T.ArrayType(T.DoubleType()), batch_size=batch_size, input_tensor_shapes=[shape] if shape else None)
    return df.withColumn(name, udf(value))
