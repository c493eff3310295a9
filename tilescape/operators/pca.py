"""Principal components from one distributed Gram matrix."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tilescape.operators.stats import gram, matrix


def fit(features: DataFrame, n_components: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """mean, components (rows) and explained variance ratios. The entry of largest size in a component is positive."""
    n, total, product = gram(features)
    if n == 0:
        raise ValueError("no rows to fit")
    mean = total / n
    covariance = product / n - np.outer(mean, mean)
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    order = np.argsort(-values, kind="stable")
    values, components = np.maximum(values[order], 0), vectors[:, order].T
    sign = np.sign(components[np.arange(len(components)), np.abs(components).argmax(1)])
    components = components * np.where(sign == 0, 1, sign)[:, None]
    spread = values.sum()
    ratios = values / spread if spread > 0 else np.zeros_like(values)
    k = len(values) if n_components is None else n_components
    return mean, components[:k], ratios[:k]


def n_for_variance(ratios: np.ndarray, threshold: float = 0.95) -> int:
    """Leading components that reach the threshold; all if it is never reached."""
    reached = np.flatnonzero(np.cumsum(ratios) >= threshold)
    return int(reached[0]) + 1 if len(reached) else len(ratios)


def transform(features: DataFrame, mean: np.ndarray, components: np.ndarray, out: str = "values") -> DataFrame:
    """All columns but features, and the scores as an array."""
    names = [c for c in features.columns if c != "features"]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            scores = (matrix(batch.column("features")) - mean) @ components.T if batch.num_rows else np.zeros((0, len(components)))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + [pa.array(list(scores), pa.list_(pa.float64()))], names=[*names, out])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in features.schema if f.name != "features"), f"{out} array<double>"])
    return features.mapInArrow(run, schema)
