"""Catalog, listing, upsert, migration and status queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilescape.functions import paths
from tilescape.operators import catalog as C
from tilescape.queries.adapters import CATALOG, SLIDES, TILES, Registry, catalog_rows, slides, tiles
from tilescape.queries.values import EXT, FILES, files

query = Registry()
QUERIES, ORACLE_SQL = query.queries, query.sql


@query(f"WITH {CATALOG} SELECT DISTINCT model, namespace FROM catalog_rows WHERE filter_path = ''")
def list_namespaces(spark, d):
    return C.namespaces(catalog_rows(spark, d))


@query(f"WITH {CATALOG} SELECT DISTINCT filter_path, len(string_split(filter_path, '/'))::BIGINT AS depth FROM catalog_rows WHERE model = 'uni' AND namespace = 'default' AND filter_path != ''")
def list_filters(spark, d):
    return C.filters(catalog_rows(spark, d), "uni", "default").withColumn("depth", F.col("depth").cast("long"))


@query(f"WITH {CATALOG} SELECT model, namespace, filter_path, count(*) AS n, count(DISTINCT cluster) FILTER (cluster >= 0) AS clusters FROM catalog_rows GROUP BY ALL")
def show_summary(spark, d):
    return catalog_rows(spark, d).groupBy("model", "namespace", "filter_path").agg(F.count("*").alias("n"), F.countDistinct(F.when(F.col("cluster") >= 0, F.col("cluster"))).alias("clusters"))


@query(f"WITH {CATALOG}, u AS (SELECT DISTINCT model, namespace, cluster FROM catalog_rows), r AS (SELECT *, row_number() OVER (PARTITION BY model, namespace ORDER BY cluster) AS rn FROM u) SELECT model, namespace, string_agg(cluster::VARCHAR, ',' ORDER BY cluster) AS ids FROM r WHERE rn <= 10 GROUP BY ALL")
def show_verbose_ids(spark, d):
    ids = F.slice(F.array_sort(F.collect_set("cluster")), 1, 10)
    return catalog_rows(spark, d).groupBy("model", "namespace").agg(F.array_join(F.transform(ids, lambda x: x.cast("string")), ",").alias("ids"))


@query(f"WITH {CATALOG}, kept AS (SELECT slide_id, count(*) AS patch_count FROM tiles GROUP BY slide_id), f AS (SELECT slide_id, count(*) AS n FROM tiles WHERE NOT (slide_id = 1 AND label = 3) GROUP BY slide_id), c AS (SELECT slide_id, string_agg(DISTINCT namespace, ',' ORDER BY namespace) AS namespaces, count(DISTINCT cluster) AS ids FROM catalog_rows GROUP BY slide_id) SELECT slide_id, patch_count, n = patch_count AS has_features, namespaces, ids FROM kept JOIN f USING (slide_id) JOIN c USING (slide_id)")
def store_detail(spark, d):
    """One slide lacks some features: rows are compared with the count that caching recorded."""
    t = tiles(spark, d)
    kept = t.groupBy("slide_id").agg(F.count("*").alias("patch_count"))
    return C.store_detail(kept, t.where("not (slide_id = 1 and label = 3)"), catalog_rows(spark, d))


@query(f"WITH {CATALOG} SELECT model, CASE WHEN model = 'uni' AND namespace = 'batch' THEN 'renamed' ELSE namespace END AS namespace, filter_path, count(*) AS n FROM catalog_rows GROUP BY ALL")
def rename_namespace(spark, d):
    out = C.renamed(catalog_rows(spark, d), "batch", "renamed", "uni")
    return out.groupBy("model", "namespace", "filter_path").agg(F.count("*").alias("n"))


@query(f"WITH {CATALOG} SELECT model, namespace, filter_path, count(*) AS n FROM catalog_rows WHERE namespace != '001+002' GROUP BY ALL")
def remove_namespace(spark, d):
    return C.removed(catalog_rows(spark, d), "001+002").groupBy("model", "namespace", "filter_path").agg(F.count("*").alias("n"))


@query(f"WITH {SLIDES} SELECT slide_id, CASE WHEN slide_id % 2 = 0 THEN width ELSE width + 1 END AS width, slide_id % 2 = 0 AS stored FROM slides")
def root_metadata_upsert(spark, d):
    s = slides(spark, d)
    existing = s.where("slide_id % 2 = 0").select("slide_id", "width", F.lit(True).alias("stored"))
    incoming = s.select("slide_id", (F.col("width") + 1).alias("width"), F.lit(False).alias("stored"))
    return C.upserted(existing, incoming, "slide_id")


@query(f"WITH {SLIDES}, o AS (SELECT slide_id, 256::BIGINT AS patch_size, CASE WHEN slide_id % 3 > 0 THEN 0.25::DOUBLE END AS mpp, CASE WHEN slide_id % 4 > 0 THEN slide_id % 4 END AS image_level, width // 256 AS cols, height // 256 AS rows FROM slides) SELECT slide_id, patch_size, mpp, coalesce(mpp, 0.5)::DOUBLE AS target_mpp, coalesce(image_level, 0)::BIGINT AS level_used, cols, rows, cols * rows AS patch_count FROM o")
def migrate_metadata(spark, d):
    cols, rows = F.floor(F.col("width") / 256).cast("long"), F.floor(F.col("height") / 256).cast("long")
    old = slides(spark, d).select(
        "slide_id", F.lit(256).cast("long").alias("patch_size"), F.when(F.col("slide_id") % 3 > 0, F.lit(0.25)).alias("mpp"), F.when(F.col("slide_id") % 4 > 0, F.col("slide_id") % 4).alias("image_level"), cols.alias("cols"), rows.alias("rows"), (cols * rows).alias("patch_count")
    )
    return C.migrated(old).withColumn("level_used", F.col("level_used").cast("long"))


@query(f"WITH {SLIDES} SELECT slide_id, 0.25 * (1 + slide_id % 3) AS mpp, abs(0.25 * (1 + slide_id % 3) - 0.5) / 0.5 > 0.1 AS mismatch FROM slides".replace("0.25 *", "0.25::DOUBLE *"))
def mpp_compat_check(spark, d):
    mpp = 0.25 * (1 + F.col("slide_id") % 3)
    return slides(spark, d).select("slide_id", mpp.alias("mpp"), (F.abs(mpp - 0.5) / 0.5 > 0.1).alias("mismatch"))


@query(f"WITH {FILES}, p AS (SELECT directory, (id % 40)::VARCHAR AS stem, path, CASE {EXT} WHEN '.ndpi' THEN 0 WHEN '.svs' THEN 6 WHEN '.tif' THEN 8 END AS priority FROM files), r AS (SELECT *, row_number() OVER (PARTITION BY directory, stem ORDER BY priority, path) AS rn FROM p WHERE priority IS NOT NULL) SELECT directory, stem, priority::BIGINT AS priority FROM r WHERE rn = 1")
def sibling_lookup(spark, d):
    f = files(spark, d).select("directory", (F.col("id") % 40).cast("string").alias("stem"), "path", paths.sibling_priority(F.col("path")).alias("priority"))
    best = C.siblings(f, f.select("directory", "stem").distinct())
    return best.select("directory", "stem", paths.sibling_priority(F.col("path")).cast("long").alias("priority"))


@query(f"WITH {FILES} SELECT directory, path, is_dir, (row_number() OVER (PARTITION BY directory ORDER BY is_dir DESC, path))::BIGINT AS position FROM files")
def listing_sort(spark, d):
    from pyspark.sql import Window

    order = Window.partitionBy("directory").orderBy(F.desc("is_dir"), "path")
    return files(spark, d).select("directory", "path", "is_dir", F.row_number().over(order).cast("long").alias("position"))


@query(f"WITH {FILES}, t AS (SELECT directory, CASE WHEN is_dir THEN 'directory' WHEN {EXT} IN ('.ndpi', '.svs') THEN 'wsi' WHEN {EXT} = '.h5' THEN 'hdf5' WHEN {EXT} IN ('.bmp', '.gif', '.icns', '.ico', '.jpg', '.jpeg', '.png', '.tif', '.tiff') THEN 'image' ELSE 'other' END AS type, id % 16 AS selection FROM files) SELECT directory, selection, CASE WHEN count(DISTINCT type) > 1 THEN 'mix' ELSE any_value(type) END AS kind FROM t GROUP BY directory, selection")
def selection_type(spark, d):
    t = files(spark, d).select("directory", (F.col("id") % 16).alias("selection"), paths.file_type(F.col("path"), F.col("is_dir")).alias("type"))
    return t.groupBy("directory", "selection").agg(F.when(F.countDistinct("type") > 1, "mix").otherwise(F.min("type")).alias("kind"))


@query(f"WITH {TILES} SELECT slide_id, count(DISTINCT label % 2) > 1 AS mixed, min(label % 2) AS first FROM tiles WHERE NOT (slide_id = 2 AND label % 2 = 1) GROUP BY slide_id")
def status_check(spark, d):
    t = tiles(spark, d).where("not (slide_id = 2 and label % 2 = 1)")
    return t.groupBy("slide_id").agg((F.countDistinct(F.col("label") % 2) > 1).alias("mixed"), F.min(F.col("label") % 2).alias("first"))
