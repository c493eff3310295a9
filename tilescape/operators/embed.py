"""Tile features from pixels, and slide vectors from tile features, with pluggable models."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilescape.config import TILE_PRESETS

#: A model takes normalised pixels [N, 3, H, W] and returns features [N, D], or those and token vectors [N, L, D].
Model = Callable[[np.ndarray], np.ndarray | tuple[np.ndarray, np.ndarray]]
#: Channel means and deviations.
Norm = tuple[tuple[float, float, float], tuple[float, float, float]]


def projection_model(dim: int, seed: int = 42) -> Model:
    """A fixed random projection of channel means and deviations over a 4 x 4 grid: deterministic, without weights to load."""

    def run(x: np.ndarray) -> np.ndarray:
        n, c, h, w = x.shape
        grid = x[:, :, : h // 4 * 4, : w // 4 * 4].reshape(n, c, 4, max(1, h // 4), 4, max(1, w // 4))
        base = np.concatenate([grid.mean((3, 5)).reshape(n, -1), grid.std((3, 5)).reshape(n, -1)], axis=1)
        matrix = np.random.default_rng(seed).normal(size=(base.shape[1], dim)) / np.sqrt(base.shape[1])
        return base @ matrix

    return run


def extract(tiles: DataFrame, preset: str, factory: Callable[[], Model] | None = None, *, norm: Norm | None = None, latent: bool = False, batch_size: int = 64) -> DataFrame:
    """All columns but rgb, the features and, if ``latent``, the model's token vectors. ``factory`` loads the model, once in each
    task of a Python worker; a preset of one's own needs a factory and the norm of its pixels."""
    if preset not in TILE_PRESETS and (factory is None or norm is None):
        raise ValueError(f"unknown preset {preset!r}; one of {sorted(TILE_PRESETS)}, or give a factory and a norm")
    dim, *known = TILE_PRESETS.get(preset, (0,))
    mean, std = norm or known
    names = [c for c in tiles.columns if c != "rgb"]
    make = factory or (lambda: projection_model(dim))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()
        for batch in it:
            out, more = [], []
            for at in range(0, batch.num_rows, batch_size):
                part = batch.slice(at, batch_size)
                shapes = list(zip(*(part.column(c).to_pylist() for c in ("height", "width", "channels")), strict=True))
                x = np.stack([np.frombuffer(b, np.uint8).reshape(s)[:, :, :3] for b, s in zip(part.column("rgb").to_pylist(), shapes, strict=True)])
                z = (x / 255.0 - np.array(mean)) / np.array(std)
                found = model(z.transpose(0, 3, 1, 2))
                features, token_vectors = found if isinstance(found, tuple) else (found, None)
                out += list(np.asarray(features, np.float32))
                if latent:
                    if token_vectors is None:
                        raise ValueError(f"the model of {preset!r} gives no token vectors")
                    more += [list(v) for v in np.asarray(token_vectors, np.float32)]
            columns = [batch.column(c) for c in names] + [pa.array(out, pa.list_(pa.float32()))] + ([pa.array(more, pa.list_(pa.list_(pa.float32())))] if latent else [])
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "features", *(["tokens"] if latent else [])])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in tiles.schema if f.name != "rgb"), "features array<float>", *(["tokens array<array<float>>"] if latent else [])])
    return tiles.mapInArrow(run, schema)


def mean_pool(features: DataFrame) -> DataFrame:
    """slide_id, feature, n: the mean of each dimension, from partial sums; no slide is ever gathered in one task."""
    each = features.select("slide_id", F.posexplode("features").alias("dim", "v")).groupBy("slide_id", "dim").agg(F.avg("v").alias("m"), F.count("*").alias("n"))
    return each.groupBy("slide_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "m"))), lambda x: x["m"]).alias("feature"), F.max("n").alias("n"))


def aggregate(features: DataFrame, model: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """slide_id, feature by a set model (features [N, D], coordinates [N, 2]) -> [D]; a slide is one group, as the model needs it whole."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("tile_id")
        return pd.DataFrame({"slide_id": rows["slide_id"].iloc[:1], "feature": [np.asarray(model(np.stack(rows["features"]), rows[["x", "y"]].to_numpy()), float)]})

    return features.select("slide_id", "tile_id", "x", "y", "features").groupBy("slide_id").applyInPandas(run, "slide_id long, feature array<double>")


def tokens(latent: DataFrame, n_prefix: int) -> DataFrame:
    """Class token and grid tokens of an array of token vectors."""
    return latent.withColumn("cls", F.element_at("tokens", 1)).withColumn("grid", F.slice("tokens", F.lit(n_prefix + 1), F.size("tokens") - n_prefix))
