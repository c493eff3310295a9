"""Exact nearest neighbours: every band of rows meets all rows in one pass that keeps the best so far."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilescape.operators.stats import matrix

#: Rows of a band, and candidates, whose products are made at once; pairs whose differences are; neighbours a band keeps.
TILE, CHUNK, PAIRS, KEPT = 512, 4096, 1 << 16, 1 << 23
#: Blocks of rows in a band at most, and bands that there are at least if there are as many blocks.
WIDE, BANDS = 4, 16


class _Band:
    """The k nearest so far of a band's rows. Candidates come in the order of their ids, so that of equally near ones
    the earlier stays."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int) -> None:
        self.ids, self.x, self.k = ids, x, k
        self.norms = (x * x).sum(1)
        self.d2, self.at = np.empty((len(x), 0)), np.empty((len(x), 0), np.int32)
        self.seen: list[np.ndarray] = []
        self.n = 0

    def meet(self, ids: np.ndarray, y: np.ndarray) -> None:
        norms = (y * y).sum(1)
        slack = 16 * (y.shape[1] + 4) * np.finfo(float).eps * (norms.max() + self.norms)
        doubled = -2 * y.T
        width = min(self.k, self.n + len(y))
        d2, at = (np.empty((len(self.x), width)), np.empty((len(self.x), width), np.int32)) if width > self.d2.shape[1] else (self.d2, self.at)
        for first in range(0, len(self.x), TILE):
            rows = slice(first, first + TILE)
            d2[rows], at[rows] = self._best(rows, self.x[rows] @ doubled + norms, slack[rows], y, width)
        self.d2, self.at = d2, at
        self.seen.append(ids)
        self.n += len(y)

    def _best(self, rows: slice, rough: np.ndarray, slack: np.ndarray, y: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Products tell which candidates may be among the nearest, differences decide."""
        x, d2, at = self.x[rows], self.d2[rows], self.at[rows]
        full = d2.shape[1] == self.k
        worst = d2[:, -1] if full else np.full(len(x), np.inf)
        if full:
            limit = worst - self.norms[rows]
        else:
            limit = np.partition(rough, self.k - 1, axis=1)[:, self.k - 1] if len(y) > self.k else worst
        r, c = np.nonzero(~(rough > (limit + slack)[:, None]))
        exact = np.empty(len(r))
        for i in range(0, len(r), PAIRS):
            exact[i : i + PAIRS] = ((x[r[i : i + PAIRS]] - y[c[i : i + PAIRS]]) ** 2).sum(1)
        if full:
            nearer = ~(exact >= worst[r])
            r, c, exact = r[nearer], c[nearer], exact[nearer]
        if not len(r):
            return d2, at
        # new ones stand right of the kept ones in a matrix, filled up with NaN, which a stable sort leaves last
        counts = np.bincount(r, minlength=len(x))
        column = d2.shape[1] + np.arange(len(r)) - np.repeat(np.cumsum(counts) - counts, counts)
        all_d2 = np.full((len(x), d2.shape[1] + counts.max()), np.nan)
        all_at = np.zeros(all_d2.shape, np.int32)
        all_d2[:, : d2.shape[1]], all_at[:, : d2.shape[1]] = d2, at
        all_d2[r, column], all_at[r, column] = exact, c + self.n
        order = np.argsort(all_d2, axis=1, kind="stable")[:, :width]
        return np.take_along_axis(all_d2, order, 1), np.take_along_axis(all_at, order, 1)

    def lists(self, positions: bool) -> Iterator[pa.RecordBatch]:
        seen = np.concatenate(self.seen)
        for first in range(0, len(self.ids), TILE):
            ids, at = self.ids[first : first + TILE], self.at[first : first + TILE]
            ends = pa.array(np.arange(len(ids) + 1, dtype=np.int32) * at.shape[1])
            lists = lambda v: pa.ListArray.from_arrays(ends, pa.array(v.ravel()))  # noqa: E731, B023
            if positions:
                yield pa.RecordBatch.from_arrays([pa.array(np.searchsorted(seen, ids).astype(np.int32)), pa.array(ids), lists(at)], names=["at", "i", "near"])
            else:
                yield pa.RecordBatch.from_arrays([pa.array(ids), lists(seen[at]), lists(self.d2[first : first + TILE])], names=["i", "j", "d2"])


def _runs(values: np.ndarray) -> Iterator[tuple[int, int]]:
    """Bounds of runs of equal values."""
    cuts = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
    return zip(cuts[:-1], cuts[1:], strict=True)


def _met(batches: Iterator[pa.RecordBatch], k: int, positions: bool) -> Iterator[pa.RecordBatch]:
    """Rows ordered by band, side and id: a band's own rows (side 0), then all rows (side 1)."""
    number, own, band = None, [], None
    for batch in batches:
        numbers, sides, ids = (batch.column(c).to_numpy() for c in ("band", "side", "id"))
        for lo, hi in _runs(numbers * 2 + sides) if batch.num_rows else ():
            if numbers[lo] != number:
                if band is not None:
                    yield from band.lists(positions)
                number, own, band = numbers[lo], [], None
            x = matrix(batch.column("features").slice(lo, hi - lo))
            if not sides[lo]:
                own.append((ids[lo:hi].copy(), x))
            elif own or band is not None:
                if band is None:
                    band, own = _Band(*(np.concatenate(v) for v in zip(*own, strict=True)), k), []
                for at in range(0, hi - lo, CHUNK):
                    band.meet(ids[lo + at : min(lo + at + CHUNK, hi)].copy(), x[at : at + CHUNK])
    if band is not None:
        yield from band.lists(positions)


def _lists(rows: DataFrame, k: int, block_rows: int, n: int | None, positions: bool) -> DataFrame:
    n = rows.count() if n is None else n
    blocks = max(1, math.ceil(n / block_rows))
    wide = max(1, min(WIDE, KEPT // (k * block_rows)))
    bands = max(min(blocks, BANDS), math.ceil(blocks / wide))
    rows = rows.select(F.col("id").cast("long").alias("id"), F.col("features").cast("array<double>").alias("features"))
    band = F.pmod(F.xxhash64("id"), F.lit(bands)).cast("int")  # by hash, so that their size follows the rows and not the ids
    # a row goes to every band as a candidate, and to its own band once more, ahead of them
    met = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.struct(b.alias("band"), F.lit(1).alias("side")))
    met = rows.withColumn("to", F.explode(F.concat(met, F.array(F.struct(band.alias("band"), F.lit(0).alias("side")))))).select("to.band", "to.side", "id", "features")
    dealt = met.repartition(8 * bands, "band").sortWithinPartitions("band", "side", "id")  # so many that few bands share a task
    return dealt.mapInArrow(lambda it: _met(it, k, positions), "at int, i long, near array<int>" if positions else "i long, j array<long>, d2 array<double>")


def knn(rows: DataFrame, k: int, *, block_rows: int = 4096, n: int | None = None) -> DataFrame:
    """(i, rank from 1, j, d2) of rows (id, features): the k nearest by Euclidean distance, the row itself included,
    ties to the smaller id. What is shuffled are rows, once a band; neighbours leave their band's task as they are."""
    near = _lists(rows, k, block_rows, n, False).select("i", F.posexplode(F.arrays_zip("j", "d2")).alias("rank", "near"))
    return near.select("i", (F.col("rank") + 1).alias("rank"), "near.j", "near.d2")


def neighbour_lists(rows: DataFrame, k: int, *, block_rows: int = 4096, n: int | None = None) -> DataFrame:
    """(at, i, near) of the same: a row's position in the order of ids, its id, and the positions of its neighbours."""
    return _lists(rows, k, block_rows, n, True)


def default_k(n: int) -> int:
    """Neighbours of the similarity graph, the row itself included."""
    return max(1, math.isqrt(n))


def directed_edges(neighbours: DataFrame) -> DataFrame:
    return neighbours.where("i != j").select(F.col("i").alias("src"), F.col("j").alias("dst"), "d2")


def undirected(edges: DataFrame) -> DataFrame:
    """Each pair once, src < dst."""
    return edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def fuzzy_weights(neighbours: DataFrame, k: int) -> DataFrame:
    """(i, j, rho, sigma, w): smoothed nearest-neighbour weights; sigma by bisection so that they sum to log2 k."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            out = {c: [] for c in ("i", "j", "rho", "sigma", "w")}
            for i, near in zip(batch.column("i").to_pylist(), batch.column("near").to_pylist(), strict=True):
                d = np.sqrt([x["d2"] for x in near])
                j = [x["j"] for x in near]
                positive = d[(d > 0)]
                rho = positive.min() if len(positive) else 0.0
                low, high, sigma = 0.0, np.inf, 1.0
                for _ in range(64):
                    total = np.exp(-np.maximum(d - rho, 0) / sigma)[np.array(j) != i].sum()
                    if abs(total - np.log2(k)) < 1e-5:
                        break
                    if total > np.log2(k):
                        high = sigma
                        sigma = (low + high) / 2
                    else:
                        low = sigma
                        sigma = sigma * 2 if np.isinf(high) else (low + high) / 2
                sigma = max(sigma, 1e-3 * float(d.mean()) if d.mean() > 0 else 1e-3)
                for jj, dd in zip(j, d, strict=True):
                    if jj != i:
                        for c, v in zip(out, (i, jj, rho, sigma, float(np.exp(-max(dd - rho, 0) / sigma))), strict=True):
                            out[c].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[c], pa.int64() if c in ("i", "j") else pa.float64()) for c in out], names=list(out))

    near = neighbours.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("d2", "j"))).alias("near"))
    return near.mapInArrow(run, "i long, j long, rho double, sigma double, w double")


def fuzzy_graph(weights: DataFrame) -> DataFrame:
    """Fuzzy union of the directed weights: a + b - ab, each pair once."""
    each = weights.select(F.least("i", "j").alias("src"), F.greatest("i", "j").alias("dst"), "w")
    return each.groupBy("src", "dst").agg((F.sum("w") - F.when(F.count("*") == 2, F.product("w")).otherwise(F.lit(0.0))).alias("weight"))
