"""Low-dimensional layout of a fuzzy neighbour graph, seeded."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def curve(min_dist: float = 0.1, spread: float = 1.0) -> tuple[float, float]:
    """a, b of 1 / (1 + a d^2b), fitted to the wanted fall-off by a coarse-to-fine grid search."""
    x = np.linspace(0, 3 * spread, 300)
    y = np.where(x < min_dist, 1.0, np.exp(-(x - min_dist) / spread))
    a, b, width = 1.5, 1.0, 1.0
    for _ in range(12):
        grid = [(a * np.exp(width * p), b * np.exp(width * q / 2)) for p in np.linspace(-1, 1, 11) for q in np.linspace(-1, 1, 11)]
        a, b = min(grid, key=lambda g: ((1 / (1 + g[0] * np.maximum(x, 1e-9) ** (2 * g[1])) - y) ** 2).sum())
        width *= 0.6
    return float(a), float(b)


def layout(n: int, src: np.ndarray, dst: np.ndarray, weight: np.ndarray, n_components: int = 2, min_dist: float = 0.1, epochs: int = 200, negatives: int = 5, seed: int = 42) -> np.ndarray:
    """Positions of n nodes: attraction along edges by weight, repulsion from random nodes, whole epochs at a time."""
    rng = np.random.default_rng(seed)
    a, b = curve(min_dist)
    pos = rng.uniform(-10, 10, (n, n_components))
    if not len(src):
        return pos
    probability = weight / weight.max()
    for epoch in range(epochs):
        rate = 1.0 - epoch / epochs
        on = rng.random(len(src)) < probability
        s, d = src[on], dst[on]
        diff = pos[s] - pos[d]
        d2 = (diff**2).sum(1)
        pull = (-2 * a * b * np.power(np.maximum(d2, 1e-12), b - 1) / (1 + a * np.power(d2, b)))[:, None] * diff
        step = np.zeros_like(pos)
        pull = np.clip(pull, -4, 4)
        np.add.at(step, s, pull)
        np.add.at(step, d, -pull)
        for _ in range(negatives):
            other = rng.integers(0, n, len(s))
            diff = pos[s] - pos[other]
            d2 = (diff**2).sum(1)
            push = (2 * b / ((0.001 + d2) * (1 + a * np.power(d2, b))))[:, None] * diff
            np.add.at(step, s, np.clip(push, -4, 4) * (s != other)[:, None])
        count = np.maximum(1, np.bincount(np.concatenate([s, d]), minlength=n) / 4)[:, None]
        pos += rate * step / count
    return pos - pos.mean(0)


def embed(graph: DataFrame, nodes: DataFrame, **options) -> DataFrame:
    """(scope, node, values) of fuzzy graphs (scope, src, dst, weight) and nodes (scope, node); one task a scope."""

    def run(key, e: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        ids = np.sort(v["node"].to_numpy())
        e = e.sort_values(["src", "dst"])
        pos = layout(len(ids), np.searchsorted(ids, e["src"].to_numpy()), np.searchsorted(ids, e["dst"].to_numpy()), e["weight"].to_numpy(), **options)
        return pd.DataFrame({"scope": key[0], "node": ids, "values": list(pos)})

    return graph.groupBy("scope").cogroup(nodes.groupBy("scope")).applyInPandas(run, "scope long, node long, values array<double>")


def edge_weight(d2: str = "d2"):
    """Weight of a neighbour edge in an embedding: exp of minus the distance."""
    return F.exp(-F.sqrt(F.col(d2)))
