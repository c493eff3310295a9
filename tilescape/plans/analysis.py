"""Analyses as pipelines: clustering, principal component scores and layouts over scopes of one or many slides."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tilescape.config import EngineConfig
from tilescape.operators import graph, knn, pca, scope, stats, umap
from tilescape.operators.catalog import check_namespace
from tilescape.sources import tables


@dataclass(frozen=True)
class Scope:
    """What an analysis looks at: features (slide_id, tile_id, features) and, for a drill-down, the chosen parent clusters."""

    features: DataFrame
    assignments: DataFrame | None = None
    parent: str = ""
    ids: tuple[int, ...] = ()

    def rows(self) -> DataFrame:
        if not self.ids:
            return self.features
        if self.assignments is None:
            raise ValueError("a drill-down needs the parent's assignments")
        return scope.scoped(self.features, scope.members(self.assignments, self.parent, list(self.ids)))

    @property
    def filter_path(self) -> str:
        own = "+".join(map(str, sorted(self.ids)))
        return "/".join(x for x in (self.parent, own) if x)


def _checked(rows: DataFrame) -> DataFrame:
    bad = rows.agg(F.max(stats.has_nan(F.col("features"))).alias("nan"), F.max(F.size("features") != 0).alias("some")).first()
    if bad["nan"]:
        raise ValueError("features with missing values cannot be analysed")
    return rows


def with_ids(rows: DataFrame) -> DataFrame:
    """A long id from the keys: slide in the high bits. Slide ids from 0 to 2**23 - 1 and tile ids from 0 to 2**40 - 1;
    others raise."""
    slide, tile = F.col("slide_id").cast("long"), F.col("tile_id").cast("long")
    fits = slide.between(0, (1 << 23) - 1) & tile.between(0, (1 << 40) - 1)
    wrong = F.raise_error(F.concat(F.lit("no room for the keys "), F.coalesce(slide.cast("string"), F.lit("null")), F.lit(", "), F.coalesce(tile.cast("string"), F.lit("null"))))
    return rows.withColumn("id", F.when(F.coalesce(fits, F.lit(False)), F.shiftleft(slide, 40) + tile).otherwise(wrong.cast("long")))


def cluster(spark: SparkSession, what: Scope, config: EngineConfig = EngineConfig(), sort_clusters: bool = True, distributed: bool = False) -> DataFrame:
    """slide_id, tile_id, cluster: joint z-scores, components for 95 % of the variance, neighbour graph, communities,
    renumbered by their mean first component. Communities are found by one task, or, if ``distributed``, coarser ones by
    rounds of label votes over the whole cluster."""
    rows = with_ids(stats.standardised(_checked(what.rows()).select("slide_id", "tile_id", F.col("features").cast("array<double>").alias("features"))))
    rows = tables.staged(rows, "scaled")
    n = rows.count()
    empty = spark.createDataFrame([], "slide_id long, tile_id long, cluster int")
    if n == 0:
        return empty
    mean, components, ratios = pca.fit(rows)
    kept = pca.n_for_variance(ratios, config.variance)
    scores = pca.transform(rows, mean, components[:kept]).select("slide_id", "tile_id", "id", "values")
    points = scores.select("id", F.col("values").alias("features"))
    if distributed:
        edges = knn.undirected(knn.directed_edges(knn.knn(points, knn.default_k(n), block_rows=config.block_rows, n=n))).withColumn("weight", F.lit(1.0))
        voted = label_rounds(edges, scores.select(F.col("id").alias("node")))
        numbers = voted.select("community").distinct().withColumn("n", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("community")) - 1)  # one row a community
        found = voted.join(numbers, "community").select("node", F.col("n").alias("community"))
    else:
        near = knn.neighbour_lists(points, knn.default_k(n), block_rows=config.block_rows, n=n)
        found = graph.list_communities(near.select(F.lit(0).cast("long").alias("scope"), "at", F.col("i").alias("node"), "near"), config.resolution, config.seed)
        found = tables.staged(found, "communities")  # one row a tile; read twice, found once
    out = scores.join(found.select(F.col("node").alias("id"), F.col("community").alias("cluster")), "id").select("slide_id", "tile_id", "cluster", F.col("values")[0].alias("value"))
    return (stats.reorder_clusters(out) if sort_clusters else out).select("slide_id", "tile_id", F.col("cluster").cast("int").alias("cluster"))


def component_scores(what: Scope, n_components: int = 2, scaler: str = "minmax") -> DataFrame:
    """slide_id, tile_id, values: scaled scores of 1 to 3 components of joint z-scores."""
    if n_components not in (1, 2, 3):
        raise ValueError("one to three components")
    if scaler not in ("minmax", "std"):
        raise ValueError("scaler is minmax or std")
    rows = stats.standardised(_checked(what.rows()).select("slide_id", "tile_id", F.col("features").cast("array<double>").alias("features")))
    mean, components, _ = pca.fit(rows, n_components)
    scores = pca.transform(rows, mean, components)
    each = [F.col("values")[i] for i in range(n_components)]
    if scaler == "minmax":
        ends = scores.agg(*[f(e).alias(f"{k}{i}") for i, e in enumerate(each) for k, f in (("low", F.min), ("high", F.max))])
        scaled = [F.when(F.col(f"high{i}") > F.col(f"low{i}"), (e - F.col(f"low{i}")) / (F.col(f"high{i}") - F.col(f"low{i}"))).otherwise(F.lit(0.0)) for i, e in enumerate(each)]
    else:
        ends = scores.agg(*[f(e).alias(f"{k}{i}") for i, e in enumerate(each) for k, f in (("low", F.avg), ("high", F.stddev_pop))])
        scaled = [1.0 / (1.0 + F.exp(-(e - F.col(f"low{i}")) / F.when(F.col(f"high{i}") > 0, F.col(f"high{i}")).otherwise(F.lit(1.0)))) for i, e in enumerate(each)]
    return scores.crossJoin(F.broadcast(ends)).select("slide_id", "tile_id", F.array(*scaled).alias("values"))  # one row


def layout(what: Scope, config: EngineConfig = EngineConfig(), n_components: int = 2) -> DataFrame:
    """slide_id, tile_id, values: a seeded layout of the fuzzy neighbour graph of joint z-scores."""
    rows = with_ids(stats.standardised(_checked(what.rows()).select("slide_id", "tile_id", F.col("features").cast("array<double>").alias("features"))))
    rows = tables.staged(rows, "scaled")
    near = knn.knn(rows.select("id", "features"), config.n_neighbors, block_rows=config.block_rows)
    fuzzy = knn.fuzzy_graph(knn.fuzzy_weights(near, config.n_neighbors)).withColumn("scope", F.lit(0).cast("long"))
    placed = umap.embed(fuzzy, rows.select(F.lit(0).cast("long").alias("scope"), F.col("id").alias("node")), n_components=n_components, min_dist=config.min_dist, seed=config.seed)
    return placed.select(F.shiftright("node", 40).cast("long").alias("slide_id"), F.col("node").bitwiseAND(F.lit((1 << 40) - 1)).alias("tile_id"), "values")


def latent_rgb(latent: DataFrame) -> DataFrame:
    """slide_id, tile_id, token, r, g, b: three components over all tokens, min-max scaled to bytes, truncated."""
    count = F.size("tokens")
    odd = latent.where(F.pow(F.floor(F.sqrt(count.cast("double")) + 0.5), 2) != count).limit(1)
    if not odd.isEmpty():
        raise ValueError("the number of tokens must be a square")
    rows = latent.select("slide_id", "tile_id", F.posexplode("tokens").alias("token", "features"))
    mean, components, _ = pca.fit(rows, 3)
    scores = pca.transform(rows, mean, components)
    ends = scores.agg(*[f(F.col("values")[i]).alias(f"{k}{i}") for i in range(3) for k, f in (("low", F.min), ("high", F.max))])
    byte = lambda i: F.floor(F.when(F.col(f"high{i}") > F.col(f"low{i}"), (F.col("values")[i] - F.col(f"low{i}")) / (F.col(f"high{i}") - F.col(f"low{i}"))).otherwise(F.lit(0.0)) * 255).cast("int")
    return scores.crossJoin(F.broadcast(ends)).select("slide_id", "tile_id", "token", *[byte(i).alias(c) for i, c in enumerate("rgb")])


def label_rounds(edges: DataFrame, nodes: DataFrame, rounds: int = 5) -> DataFrame:
    """Distributed coarse communities (node, community) for graphs beyond one task: every round each node takes the
    community most of its edge weight leads to, ties to the smaller; every round's labels are a table in the shared folder."""
    both = edges.select("src", "dst", "weight").union(edges.select(F.col("dst"), F.col("src"), "weight"))
    labels = nodes.select("node", F.col("node").alias("community"))
    for _ in range(rounds):
        votes = both.join(labels.withColumnRenamed("node", "dst"), "dst").groupBy("src", "community").agg(F.sum("weight").alias("w"))
        best = votes.groupBy("src").agg(F.max_by("community", F.struct("w", -F.col("community"))).alias("best"))
        labels = labels.join(best.withColumnRenamed("src", "node"), "node", "left").select("node", F.coalesce(F.least("best", "community"), "community").alias("community"))
        labels = tables.staged(labels, "labels")
    return labels


def run_namespace(paths: list[str], namespace: str | None) -> str:
    """The namespace of an analysis: checked if given, default for one slide, else the sorted names."""
    if namespace is not None:
        return check_namespace(namespace, user=True)
    if len(paths) == 1:
        return "default"
    names = sorted(p.rsplit("/", 1)[-1].rsplit(".", 1)[0].replace("+", "_") for p in paths)
    return "+".join(names)


def sample_blobs(n: int = 60, dim: int = 8, seed: int = 42) -> list[tuple]:
    """Three separated groups over two slides, for tests and demonstrations: (slide_id, tile_id, features)."""
    rng = np.random.default_rng(seed)
    centres = np.eye(3, dim) * 12
    return [(int(i % 2), int(i), [float(v) for v in centres[i // n] + rng.normal(size=dim)]) for i in range(3 * n)]
