"""Column statistics over feature arrays. One scan, partial aggregates, and only D rows leave it."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def long_form(features: DataFrame, keys: Sequence[str] = ("slide_id", "tile_id")) -> DataFrame:
    return features.select(*keys, F.posexplode("features").alias("dim", "value"))


def feature_stats(features: DataFrame) -> DataFrame:
    """dim, n, mean and population deviation, jointly over all rows."""
    moments = features.select("features").mapInArrow(_moments, "dim int, n long, mean double, m2 double")
    n, mean = F.sum("n"), F.sum(F.col("n") * F.col("mean")) / F.sum("n")
    spread = F.greatest(F.sum(F.col("m2") + F.col("n") * F.col("mean") * F.col("mean")) / n - mean * mean, F.lit(0.0))
    # a dimension whose partitions all have one and the same value has no spread, whatever rounding says
    constant = (F.max("m2") == 0) & (F.min("mean") == F.max("mean"))
    return moments.groupBy("dim").agg(n.alias("n"), mean.alias("mean"), F.when(constant, F.lit(0.0)).otherwise(F.sqrt(spread)).alias("std"))


def _moments(it):
    """One row a dimension: the moments of a partition's rows."""
    n, mean, m2 = 0, None, None
    for batch in it:
        if batch.num_rows:
            x = matrix(batch.column("features"))
            m = x.mean(0)
            s = ((x - m) ** 2).sum(0)
            if mean is None:
                n, mean, m2 = len(x), m, s
            else:
                off = m - mean
                m2 += s + off**2 * (n * len(x) / (n + len(x)))
                mean += off * (len(x) / (n + len(x)))
                n += len(x)
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(mean), dtype=np.int32)), pa.array(np.full(len(mean), n, np.int64)), pa.array(mean), pa.array(m2)], names=["dim", "n", "mean", "m2"])


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equally long rows as a matrix; missing numbers become NaN."""
    flat = column.flatten()
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1)


def standardised(features: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """Features as z-scores with joint statistics; a dimension without spread has deviation 1.

    The statistics, one row of D numbers, are broadcast: their size is that of one feature vector.
    """
    stats = feature_stats(features) if stats is None else stats
    spread = F.when(F.col("std") > 0, F.col("std")).otherwise(F.lit(1.0))
    packed = stats.agg(F.array_sort(F.collect_list(F.struct("dim", "mean", spread.alias("std")))).alias("s"))
    scaled = F.transform("features", lambda v, i: (v - F.get(F.col("s"), i)["mean"]) / F.get(F.col("s"), i)["std"])
    return features.crossJoin(F.broadcast(packed)).withColumn("features", scaled).drop("s")


def min_max(scores: DataFrame, value: str = "value") -> DataFrame:
    """Scaled to 0 .. 1; 0 where all are equal."""
    ends = scores.agg(F.min(value).alias("low"), F.max(value).alias("high"))
    return scores.crossJoin(F.broadcast(ends)).withColumn("scaled", F.when(F.col("high") > F.col("low"), (F.col(value) - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(F.lit(0.0))).drop("low", "high")


def std_sigmoid(scores: DataFrame, value: str = "value") -> DataFrame:
    """Standardised, then squashed into 0 .. 1."""
    stats = scores.agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    z = (F.col(value) - F.col("mean")) / F.when(F.col("std") > 0, F.col("std")).otherwise(F.lit(1.0))
    return scores.crossJoin(F.broadcast(stats)).withColumn("scaled", 1.0 / (1.0 + F.exp(-z))).drop("mean", "std")


def gram_table(features: DataFrame) -> DataFrame:
    """(r, c, n, v): row 0 the sums of all dimensions, row i + 1 those of their products with dimension i.

    One D x D partial a partition, added up by Spark: the shuffle has D * (D + 1) rows a partition, whatever the rows.
    """

    def partial(it):
        total, n = None, 0
        for batch in it:
            if batch.num_rows:
                x = matrix(batch.column("features"))
                part = np.vstack([x.sum(0), x.T @ x])
                total = part if total is None else total + part
                n += len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(np.full(len(total), n, np.int64)), pa.array(list(total), pa.list_(pa.float64()))], names=["r", "n", "v"])

    parts = features.select("features").mapInArrow(partial, "r int, n long, v array<double>")
    return parts.select("r", "n", F.posexplode("v").alias("c", "v")).groupBy("r", "c").agg(F.sum("n").alias("n"), F.sum("v").alias("v"))


def covariance_pairs(features: DataFrame) -> DataFrame:
    """(i, j, covariance) of the population, upper triangle."""
    g = gram_table(features)
    sums = g.where("r = 0")
    left, right = sums.select(F.col("c").alias("i"), (F.col("v") / F.col("n")).alias("mi")), sums.select(F.col("c").alias("j"), (F.col("v") / F.col("n")).alias("mj"))
    products = g.where("r > 0").select((F.col("r") - 1).alias("i"), F.col("c").alias("j"), (F.col("v") / F.col("n")).alias("p")).where("i <= j")
    return products.join(left, "i").join(right, "j").select("i", "j", (F.col("p") - F.col("mi") * F.col("mj")).alias("covariance"))


def gram(features: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Row count, sums and X'X of all features, on the driver: D * (D + 1) numbers."""
    table = gram_table(features).toArrow()
    if not table.num_rows:
        return 0, np.zeros(0), np.zeros((0, 0))
    r, c, v = (table.column(x).to_numpy() for x in ("r", "c", "v"))
    d = int(c.max()) + 1
    full = np.zeros((d + 1, d))
    full[r, c] = v
    return int(table.column("n")[0].as_py()), full[0], full[1:]


def cluster_means(rows: DataFrame, value: str = "value") -> DataFrame:
    return rows.where("cluster >= 0").groupBy("cluster").agg(F.avg(value).alias("mean"))


def reorder_clusters(rows: DataFrame, value: str = "value") -> DataFrame:
    """Clusters renumbered by their mean value, reversed if the median of the means is above their midpoint.

    Negative clusters stay, and so does a single one. The windows see one row per cluster.
    """
    means = cluster_means(rows, value)
    all_ = Window.partitionBy(F.lit(0))
    order = all_.orderBy("mean", "cluster")
    ranked = means.withColumn("rank", F.row_number().over(order) - 1).withColumn("n", F.count("*").over(all_)).withColumn("flip", F.percentile("mean", F.lit(0.5)).over(all_) > (F.min("mean").over(all_) + F.max("mean").over(all_)) / 2)
    new = F.when(F.col("n") <= 1, F.col("cluster")).when(F.col("flip"), F.col("n") - 1 - F.col("rank")).otherwise(F.col("rank"))
    mapping = ranked.select(F.col("cluster").alias("old"), new.cast("int").alias("new"))
    # the mapping has one row per cluster, bounded by the resolution of the clustering; AQE broadcasts it if small
    return rows.join(mapping, F.col("cluster") == F.col("old"), "left").withColumn("cluster", F.coalesce("new", "cluster")).drop("old", "new")


def centroids(points: DataFrame) -> DataFrame:
    return points.where("cluster >= 0").groupBy("cluster").agg(F.avg("px").alias("px"), F.avg("py").alias("py"), F.count("*").alias("n"))


def violin(rows: DataFrame, value: str = "value") -> DataFrame:
    """Quartiles of all rows (group 'All', outsiders included) and of every cluster from 0 on."""
    quartiles = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    both = rows.select(F.explode(F.array(F.lit("All"), F.when(F.col("cluster") >= 0, F.col("cluster").cast("string")))).alias("group"), value).where("group is not null")
    out = both.groupBy("group").agg(F.count("*").alias("n"), F.min(value).alias("low"), quartiles.alias("q"), F.max(value).alias("high"))
    return out.select("group", "n", "low", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "high")


def cumulative_cutoff(ratios: DataFrame, threshold: float = 0.95) -> DataFrame:
    """Number of leading components (component from 1, ratio) that reach the threshold; all if none does."""
    running = ratios.withColumn("cumulative", F.sum("ratio").over(Window.partitionBy(F.lit(0)).orderBy("component")))
    return running.agg(F.coalesce(F.min(F.when(F.col("cumulative") >= threshold, F.col("component"))), F.max("component")).alias("n_components"))


def has_nan(array: Column) -> Column:
    return F.exists(array, lambda v: v.isNull() | F.isnan(v))
