"""Statistics, neighbour graphs, communities, components and layouts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilescape.config import EngineConfig
from tilescape.operators import embed, graph, knn, pca, stats, umap
from tilescape.plans import analysis as plan
from tilescape.queries.adapters import SCORES, TILES, Registry, scores, tiles
from tilescape.sources.tables import read

query = Registry()
QUERIES, ORACLE_SQL = query.queries, query.sql
K = 8

STATS = TILES + ", longf AS (SELECT slide_id, tile_id, generate_subscripts(features, 1) - 1 AS dim, unnest(features) AS v FROM tiles), st AS (SELECT dim, count(*) AS n, avg(v) AS mean, stddev_pop(v) AS std FROM longf GROUP BY dim)"


@query(f"WITH {STATS} SELECT dim::BIGINT AS dim, n, round(mean, 6) AS mean, round(std, 6) AS std FROM st")
def feature_stats(spark, d):
    return stats.feature_stats(tiles(spark, d)).select(F.col("dim").cast("long").alias("dim"), "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query(f"WITH {STATS} SELECT slide_id, tile_id, dim::BIGINT AS dim, round((v - mean) / CASE WHEN std > 0 THEN std ELSE 1 END, 6) AS z FROM longf JOIN st USING (dim)")
def standardize(spark, d):
    z = stats.long_form(stats.standardised(tiles(spark, d)))
    return z.select("slide_id", "tile_id", F.col("dim").cast("long").alias("dim"), F.round("value", 6).alias("z"))


@query(f"WITH {SCORES}, e AS (SELECT min(value) AS low, max(value) AS high FROM scores) SELECT tile_id, round((value - low) / (high - low), 6) AS scaled FROM scores, e")
def minmax_scale(spark, d):
    return stats.min_max(scores(spark, d)).select("tile_id", F.round("scaled", 6).alias("scaled"))


@query(f"WITH {SCORES}, e AS (SELECT avg(value) AS m, stddev_pop(value) AS s FROM scores) SELECT tile_id, round(1 / (1 + exp(-(value - m) / s)), 6) AS scaled FROM scores, e")
def std_sigmoid(spark, d):
    return stats.std_sigmoid(scores(spark, d)).select("tile_id", F.round("scaled", 6).alias("scaled"))


@query(f"WITH {TILES}, ix AS (SELECT i, j FROM (SELECT unnest(generate_series(0, 63)) AS i), (SELECT unnest(generate_series(0, 63)) AS j) WHERE i <= j) SELECT i, j, round(avg(features[i+1] * features[j+1]) - avg(features[i+1]) * avg(features[j+1]), 6) + 0.0 AS covariance FROM tiles, ix GROUP BY i, j")
def covariance_pairs(spark, d):
    c = stats.covariance_pairs(tiles(spark, d))
    return c.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), (F.round("covariance", 6) + 0.0).alias("covariance"))


@query(f"WITH {SCORES} SELECT cluster, round(avg(value), 6) AS mean FROM scores WHERE cluster >= 0 GROUP BY cluster")
def cluster_means(spark, d):
    return stats.cluster_means(scores(spark, d)).select("cluster", F.round("mean", 6).alias("mean"))


REORDERED = SCORES + """, m AS (SELECT cluster, avg(value) AS mean FROM scores WHERE cluster >= 0 GROUP BY cluster), q AS (SELECT *, row_number() OVER (ORDER BY mean, cluster) - 1 AS r, count(*) OVER () AS n FROM m),
f AS (SELECT quantile_cont(mean, 0.5) > (min(mean) + max(mean)) / 2 AS flip FROM m), map AS (SELECT cluster AS old, CASE WHEN n <= 1 THEN cluster WHEN flip THEN n - 1 - r ELSE r END AS new FROM q, f)"""


@query(f"WITH {REORDERED} SELECT slide_id, tile_id, coalesce(new, cluster)::BIGINT AS cluster FROM scores LEFT JOIN map ON cluster = old")
def reorder_clusters(spark, d):
    return stats.reorder_clusters(scores(spark, d)).select("slide_id", "tile_id", "cluster")


@query(f"WITH {TILES} SELECT slide_id, count(DISTINCT cluster) FILTER (cluster >= 0) AS clusters FROM tiles GROUP BY slide_id")
def cluster_counts(spark, d):
    return tiles(spark, d).groupBy("slide_id").agg(F.countDistinct(F.when(F.col("cluster") >= 0, F.col("cluster"))).alias("clusters"))


@query(f"WITH {TILES} SELECT slide_id, count(*) FILTER (cluster >= 0) AS valid, count(*) AS n FROM tiles GROUP BY slide_id")
def valid_counts(spark, d):
    return tiles(spark, d).groupBy("slide_id").agg(F.count_if(F.col("cluster") >= 0).alias("valid"), F.count("*").alias("n"))


@query(f"WITH {TILES} SELECT cluster, round(avg(features[1]), 6) AS px, round(avg(features[2]), 6) AS py, count(*) AS n FROM tiles WHERE cluster >= 0 GROUP BY cluster")
def cluster_centroids(spark, d):
    points = tiles(spark, d).select("cluster", F.col("features")[0].alias("px"), F.col("features")[1].alias("py"))
    return stats.centroids(points).select("cluster", F.round("px", 6).alias("px"), F.round("py", 6).alias("py"), "n")


VIOLIN = "count(*) AS n, round(min(value), 6) AS low, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.75), 6) AS q3, round(max(value), 6) AS high"


@query(f"""WITH {SCORES} SELECT 'All' AS "group", {VIOLIN} FROM scores UNION ALL SELECT cluster::VARCHAR, {VIOLIN} FROM scores WHERE cluster >= 0 GROUP BY cluster""")
def violin_summary(spark, d):
    return stats.violin(scores(spark, d)).select("group", "n", *[F.round(c, 6).alias(c) for c in ("low", "q1", "median", "q3", "high")])


@query(f"WITH {STATS}, r AS (SELECT dim + 1 AS component, std * std / (sum(std * std) OVER ()) AS ratio FROM st), c AS (SELECT component, sum(ratio) OVER (ORDER BY component) AS cum FROM r) SELECT coalesce(min(component) FILTER (cum >= 0.8), max(component))::BIGINT AS n_components FROM c")
def cumulative_cutoff(spark, d):
    from pyspark.sql import Window

    s = stats.feature_stats(tiles(spark, d))
    ratios = s.select((F.col("dim") + 1).cast("long").alias("component"), (F.col("std") * F.col("std") / F.sum(F.col("std") * F.col("std")).over(Window.partitionBy(F.lit(0)))).alias("ratio"))
    return stats.cumulative_cutoff(ratios, 0.8)


KNN = TILES + f""", pairs AS (SELECT a.tile_id AS i, b.tile_id AS j, list_sum(list_transform(list_zip(a.features, b.features), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d2 FROM tiles a, tiles b),
nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d2, j) AS rank FROM pairs) WHERE rank <= {K})"""


def _knn(spark, d, k=K):
    return knn.knn(tiles(spark, d).select(F.col("tile_id").alias("id"), "features"), k)


@query(f"WITH {KNN} SELECT i, rank, j, round(d2, 6) AS d2 FROM nn")
def knn_topk(spark, d):
    return _knn(spark, d).select("i", F.col("rank").cast("long").alias("rank"), "j", F.round("d2", 6).alias("d2"))


@query(f"WITH {KNN} SELECT i AS src, j AS dst, 1.0::DOUBLE AS weight FROM nn WHERE i != j")
def knn_edges(spark, d):
    return knn.directed_edges(_knn(spark, d)).select("src", "dst", F.lit(1.0).alias("weight"))


@query(f"WITH {KNN} SELECT i AS src, j AS dst, round(exp(-sqrt(d2)), 6) AS weight FROM nn WHERE i != j")
def edge_weight_umap(spark, d):
    return knn.directed_edges(_knn(spark, d)).select("src", "dst", F.round(umap.edge_weight(), 6).alias("weight"))


UNDIRECTED = KNN + ", und AS (SELECT DISTINCT least(i, j) AS src, greatest(i, j) AS dst FROM nn WHERE i != j)"


@query(f"WITH {UNDIRECTED} SELECT src, dst FROM und")
def undirected_edges(spark, d):
    return knn.undirected(knn.directed_edges(_knn(spark, d)))


@query(
    f"""WITH {UNDIRECTED}, lab AS (SELECT tile_id AS node, label AS community FROM tiles), ins AS (SELECT sum((a.community = b.community)::INT) AS inside, count(*) AS m FROM und JOIN lab a ON src = a.node JOIN lab b ON dst = b.node),
deg AS (SELECT node, count(*) AS k FROM (SELECT src AS node FROM und UNION ALL SELECT dst FROM und) GROUP BY node), tot AS (SELECT sum(k) AS k FROM deg JOIN lab USING (node) GROUP BY community)
SELECT round(2 * inside - (SELECT sum(k * k) FROM tot) / (2 * m), 6) AS quality, round((2 * inside - (SELECT sum(k * k) FROM tot) / (2 * m)) / (2 * m), 6) AS modularity FROM ins"""
)
def modularity_score(spark, d):
    edges = knn.undirected(knn.directed_edges(_knn(spark, d))).withColumn("weight", F.lit(1.0))
    out = graph.modularity(edges, tiles(spark, d).select(F.col("tile_id").alias("node"), F.col("label").alias("community")))
    return out.select(F.round("quality", 6).alias("quality"), F.round("modularity", 6).alias("modularity"))


@query(f"WITH {TILES} SELECT a.tile_id AS i, b.tile_id AS j, round(sqrt(list_sum(list_transform(list_zip(a.features, b.features), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), 6) AS distance FROM tiles a JOIN tiles b ON b.tile_id = a.tile_id + 1")
def pairwise_distance(spark, d):
    t = tiles(spark, d)
    other = t.select((F.col("tile_id") - 1).alias("tile_id"), F.col("tile_id").alias("j"), F.col("features").alias("g"))
    square = F.aggregate(F.zip_with("features", "g", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda acc, v: acc + v)
    return t.join(other, "tile_id").select(F.col("tile_id").alias("i"), "j", F.round(F.sqrt(square), 6).alias("distance"))


@query()
def pca_scores(spark, d):
    return plan.component_scores(plan.Scope(tiles(spark, d)), 2)


@query()
def pca_component_count(spark, d):
    _, _, ratios = pca.fit(stats.standardised(tiles(spark, d)))
    return spark.createDataFrame([(pca.n_for_variance(ratios),)], "n_components long")


@query()
def leiden_clusters(spark, d):
    return plan.cluster(spark, plan.Scope(tiles(spark, d)))


@query()
def umap_fuzzy_graph(spark, d):
    return knn.fuzzy_graph(knn.fuzzy_weights(_knn(spark, d, 15), 15))


@query()
def umap_layout(spark, d):
    return plan.layout(plan.Scope(tiles(spark, d)), EngineConfig(n_neighbors=15))


@query()
def latent_pca_rgb(spark, d):
    """Every tile's features as 16 tokens of 4 numbers."""
    latent = tiles(spark, d).select("slide_id", "tile_id", F.transform(F.sequence(F.lit(0), F.lit(15)), lambda t: F.slice("features", t * 4 + 1, 4)).alias("tokens"))
    return plan.latent_rgb(latent)


@query(f"WITH {STATS} SELECT slide_id, dim::BIGINT AS dim, round(avg(v), 6) + 0.0 AS v FROM longf GROUP BY slide_id, dim")
def slide_mean_pool(spark, d):
    pooled = embed.mean_pool(tiles(spark, d)).select("slide_id", F.posexplode("feature").alias("dim", "v"))
    return pooled.select("slide_id", F.col("dim").cast("long").alias("dim"), (F.round("v", 6) + 0.0).alias("v"))


@query("SELECT l_returnflag AS file, l_linestatus AS engine, count(*) AS runs, round(avg(l_quantity), 6) AS tiles_per_sec FROM lineitem GROUP BY ALL")
def benchmark_summary(spark, d):
    t = read(spark, d, "lineitem")
    return t.groupBy(F.col("l_returnflag").alias("file"), F.col("l_linestatus").alias("engine")).agg(F.count("*").alias("runs"), F.round(F.avg("l_quantity"), 6).alias("tiles_per_sec")).orderBy("file", "engine")


@query("SELECT l_suppkey AS run, count(*) AS batches, round(coalesce(avg(l_discount), 0), 6) AS mean, round(coalesce(stddev_pop(l_discount), 0), 6) AS std FROM lineitem GROUP BY l_suppkey")
def batch_timing(spark, d):
    t = read(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("run"))
    return t.agg(F.count("*").alias("batches"), F.round(F.coalesce(F.avg("l_discount"), F.lit(0.0)), 6).alias("mean"), F.round(F.coalesce(F.stddev_pop("l_discount"), F.lit(0.0)), 6).alias("std"))
