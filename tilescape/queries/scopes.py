"""Joins, scopes, set operations and catalog-free analysis plumbing."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilescape.operators import scope as S
from tilescape.operators.stats import has_nan
from tilescape.queries.adapters import SCORES, TILES, Registry, assignments, scores, tiles

query = Registry()
QUERIES, ORACLE_SQL = query.queries, query.sql


@query(f"WITH {TILES} SELECT f.slide_id, f.tile_id, x, y, cluster, round(features[1], 6) AS score FROM tiles f")
def positional_join(spark, d):
    t = tiles(spark, d)
    return t.select("slide_id", "tile_id", "features").join(t.select(*S.KEYS, "x", "y"), S.KEYS).join(t.select(*S.KEYS, "cluster"), S.KEYS).select(*S.KEYS, "x", "y", "cluster", F.round(F.col("features")[0], 6).alias("score"))


@query(f"WITH {TILES} SELECT slide_id, tile_id FROM tiles WHERE cluster IN (1, 2, 3)")
def subcluster_filter(spark, d):
    return S.members(assignments(spark, d), "", [1, 2, 3])


@query(f"WITH {TILES} SELECT slide_id, tile_id, round(features[1], 6) AS f0 FROM tiles WHERE cluster IN (0, 4)")
def subcluster_semi_join(spark, d):
    return S.scoped(tiles(spark, d), S.members(assignments(spark, d), "", [0, 4])).select(*S.KEYS, F.round(F.col("features")[0], 6).alias("f0"))


@query(f"WITH {TILES} SELECT slide_id, tile_id, CASE WHEN cluster IN (1, 2, 3) THEN cluster ELSE -1 END AS cluster FROM tiles")
def dense_scatter_clusters(spark, d):
    part = assignments(spark, d).where(F.col("cluster").isin(1, 2, 3))
    return S.dense(tiles(spark, d).select(*S.KEYS), part, "cluster", -1).select(*S.KEYS, F.col("cluster").cast("long").alias("cluster"))


@query(f"WITH {SCORES} SELECT slide_id, tile_id, round(CASE WHEN cluster IN (1, 2) THEN value ELSE 'NaN'::DOUBLE END, 6) AS value FROM scores")
def dense_scatter_scores(spark, d):
    s = scores(spark, d)
    return S.dense(s.select(*S.KEYS), s.where(F.col("cluster").isin(1, 2)), "value", float("nan")).withColumn("value", F.round("value", 6))


@query(f"WITH {TILES} SELECT slide_id, tile_id FROM tiles WHERE cluster < 0")
def unassigned_tiles(spark, d):
    return S.unassigned(tiles(spark, d), assignments(spark, d)).select(*S.KEYS)


@query(f"WITH {TILES} SELECT tile_id, tile_id + 1 AS right_id FROM tiles WHERE col < 24 AND tile_id + 1 IN (SELECT tile_id FROM tiles)")
def coord_lookup(spark, d):
    t = tiles(spark, d).select("tile_id", "x", "y")
    wanted = t.select("tile_id", (F.col("x") + 256).alias("x"), "y")
    return wanted.join(t.withColumnRenamed("tile_id", "right_id"), ["x", "y"]).select("tile_id", "right_id")


@query(f"WITH {TILES}, c AS (SELECT slide_id, count(*) AS n FROM tiles GROUP BY slide_id) SELECT slide_id, n, coalesce(sum(n) OVER (ORDER BY slide_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start, (sum(n) OVER (ORDER BY slide_id))::BIGINT AS stop FROM c")
def file_slices(spark, d):
    return S.file_slices(tiles(spark, d))


@query(f"WITH {TILES} SELECT count(*) FILTER (cluster < 0) AS missing_right, 0::BIGINT AS missing_left FROM tiles")
def alignment_check(spark, d):
    return S.aligned(tiles(spark, d), assignments(spark, d))


@query(f"WITH {SCORES} SELECT slide_id, tile_id, round(value, 6) AS value FROM (SELECT *, CASE WHEN cluster < 0 THEN 'NaN'::DOUBLE ELSE value END AS v FROM scores) WHERE NOT isnan(v)")
def valid_projection_rows(spark, d):
    v = F.when(F.col("cluster") < 0, F.lit(float("nan"))).otherwise(F.col("value"))
    return scores(spark, d).withColumn("v", v).where(F.col("v").isNotNull() & ~F.isnan("v")).select(*S.KEYS, F.round("value", 6).alias("value"))


@query(f"WITH {TILES} SELECT slide_id, bool_or(label = 9) AS rejected FROM tiles GROUP BY slide_id")
def nan_guard(spark, d):
    t = tiles(spark, d).withColumn("features", F.when(F.col("label") == 9, F.array(F.lit(float("nan")))).otherwise(F.col("features")))
    return t.groupBy("slide_id").agg(F.max(has_nan(F.col("features"))).alias("rejected"))


@query(f"WITH {TILES} SELECT slide_id, tile_id, round(features[1], 6) AS f0 FROM tiles")
def multi_slide_union(spark, d):
    one = lambda s: tiles(spark, d).where(F.col("slide_id") == s).select(*S.KEYS, F.round(F.col("features")[0], 6).alias("f0"))
    return one(0).unionByName(one(1)).unionByName(one(2))


@query(f"WITH {TILES}, ns AS (SELECT DISTINCT slide_id, 'ns' || (label % 4) AS namespace FROM tiles WHERE NOT (slide_id = 1 AND label % 4 = 2)) SELECT namespace FROM ns WHERE namespace != 'ns0' GROUP BY namespace HAVING count(*) = (SELECT count(DISTINCT slide_id) FROM ns)")
def common_namespaces(spark, d):
    ns = tiles(spark, d).where(~((F.col("slide_id") == 1) & (F.col("label") % 4 == 2))).select("slide_id", F.concat(F.lit("ns"), F.col("label") % 4).alias("namespace")).distinct()
    n = ns.agg(F.countDistinct("slide_id").alias("slides"))
    return ns.where("namespace != 'ns0'").groupBy("namespace").agg(F.count("*").alias("n")).join(F.broadcast(n), F.col("n") == F.col("slides")).select("namespace")


@query(f"WITH {TILES} SELECT DISTINCT slide_id, cluster FROM tiles")
def distinct_clusters(spark, d):
    return tiles(spark, d).select("slide_id", "cluster").distinct()


@query(f"WITH {TILES}, f AS (SELECT cluster, cluster % 3 AS target, min(tile_id) AS first FROM tiles WHERE cluster >= 0 GROUP BY ALL) SELECT cluster, target, (row_number() OVER (ORDER BY first) - 1)::BIGINT AS position FROM f")
def subcluster_targets(spark, d):
    t = tiles(spark, d).where("cluster >= 0").select("cluster", (F.col("cluster") % 3).alias("target"), "tile_id")
    return S.in_first_order(t, ["cluster", "target"], "tile_id")


@query(f"WITH {SCORES} SELECT slide_id, tile_id, round(1 - value, 6) AS value FROM scores")
def score_invert(spark, d):
    return scores(spark, d).select(*S.KEYS, F.round(1 - F.col("value"), 6).alias("value"))


@query(f"WITH {TILES} SELECT tile_id, i - 5 AS token, round(features[i], 6) AS value FROM tiles, (SELECT unnest(generate_series(5, 64)) AS i)")
def token_slice(spark, d):
    from tilescape.operators.embed import tokens

    t = tokens(tiles(spark, d).select("tile_id", F.col("features").alias("tokens")), 4)
    return t.select("tile_id", F.posexplode("grid").alias("token", "value")).select("tile_id", F.col("token").cast("long").alias("token"), F.round("value", 6).alias("value"))
