"""Test tables as the engine's tables, the same mapping as DataFrames and as SQL.

embeddings give tiles (slide = vec_id % 3, a grid 25 columns wide, cluster = label with 9 as an outsider) and
pixels; supplier gives slides and pyramid levels; events give requests; lineitem gives timings.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilescape.sources.tables import read


class Registry:
    """Queries and their SQL by name."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, sql: str | None = None):
        def keep(f):
            self.queries[f.__name__] = f
            if sql is not None:
                self.sql[f.__name__] = sql
            return f

        return keep


def tiles(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "embeddings")
    row = F.floor(F.col("vec_id") / 25).cast("long")
    return e.select(
        (F.col("vec_id") % 3).alias("slide_id"), F.col("vec_id").alias("tile_id"), F.col("embedding").cast("array<double>").alias("features"), (F.col("vec_id") % 25).alias("col"), row.alias("row"),
        (F.col("vec_id") % 25 * 256).alias("x"), (row * 256).alias("y"), F.col("label").cast("long").alias("label"), F.when(F.col("label") == 9, F.lit(-1)).otherwise(F.col("label")).cast("long").alias("cluster"),
    )


TILES = """tiles AS (SELECT vec_id % 3 AS slide_id, vec_id AS tile_id, embedding::DOUBLE[] AS features, vec_id % 25 AS col, vec_id // 25 AS row, (vec_id % 25) * 256 AS x, (vec_id // 25) * 256 AS y,
  label::BIGINT AS label, (CASE WHEN label = 9 THEN -1 ELSE label END)::BIGINT AS cluster FROM embeddings)"""


def scores(spark: SparkSession, d: str) -> DataFrame:
    """First feature as a score."""
    t = tiles(spark, d)
    return t.select("slide_id", "tile_id", "cluster", F.col("features")[0].alias("value"))


SCORES = TILES + ", scores AS (SELECT slide_id, tile_id, cluster, features[1] AS value FROM tiles)"


def assignments(spark: SparkSession, d: str) -> DataFrame:
    """Member rows only, under the top-level filter path of model 'uni'."""
    return tiles(spark, d).where("cluster >= 0").select(F.lit("uni").alias("model"), F.lit("default").alias("namespace"), F.lit("").alias("filter_path"), "slide_id", "tile_id", "cluster")


def pixels(spark: SparkSession, d: str) -> DataFrame:
    """21 pixels a tile from its features: channel c of pixel p is 255 - floor(|feature[3p + c]| * 100)."""
    level = lambda i: (F.lit(255) - F.floor(F.abs(F.get("features", i)) * 100)).cast("int")
    px = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda p: F.struct(level(p * 3).alias("r"), level(p * 3 + 1).alias("g"), level(p * 3 + 2).alias("b")))
    return tiles(spark, d).withColumn("pixels", px)


PIXELS = TILES + """, px AS (SELECT slide_id, tile_id, p, (255 - floor(abs(features[3*p+1]) * 100))::BIGINT AS r, (255 - floor(abs(features[3*p+2]) * 100))::BIGINT AS g, (255 - floor(abs(features[3*p+3]) * 100))::BIGINT AS b
  FROM tiles, (SELECT unnest(generate_series(0, 20)) AS p))"""


def slides(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "supplier").select(F.col("s_suppkey").alias("slide_id"), (20000 + 137 * F.col("s_suppkey")).alias("width"), (15000 + 91 * F.col("s_suppkey")).alias("height"))


SLIDES = "slides AS (SELECT s_suppkey AS slide_id, 20000 + 137 * s_suppkey AS width, 15000 + 91 * s_suppkey AS height FROM supplier)"


def levels(spark: SparkSession, d: str) -> DataFrame:
    """Native levels with downsamples 1, 4, 16 and 64."""
    s = slides(spark, d).select("*", F.posexplode(F.array(*[F.lit(x) for x in (1.0, 4.0, 16.0, 64.0)])).alias("ordinal", "downsample"))
    return s.select("slide_id", F.col("ordinal").cast("long").alias("ordinal"), F.floor(F.col("width") / F.col("downsample")).cast("long").alias("width"), F.floor(F.col("height") / F.col("downsample")).cast("long").alias("height"), "downsample")


LEVELS = SLIDES + """, levels AS (SELECT slide_id, ordinal, floor(width / downsample)::BIGINT AS width, floor(height / downsample)::BIGINT AS height, downsample
  FROM slides, (VALUES (0::BIGINT, 1.0::DOUBLE), (1, 4.0), (2, 16.0), (3, 64.0)) l(ordinal, downsample))"""


def pages(spark: SparkSession, d: str) -> DataFrame:
    """TIFF pages: a base, a thumbnail, a grey page, levels, and for some slides a jump or another aspect."""
    s = slides(spark, d)
    k = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(f).alias("f"), F.lit(c).alias("c")) for i, f, c in ((0, 1.0, 3), (1, 300.0, 3), (2, 2.0, 1), (3, 2.0, 3), (4, 4.0, 3), (5, 16.0, 3), (6, 32.0, 3))])
    s = s.select("*", F.explode(k).alias("k"))
    odd = (F.col("slide_id") % 5 == 0) & (F.col("k.i") == 4)
    return s.select("slide_id", F.col("k.i").cast("long").alias("page_index"), F.floor(F.col("width") / F.col("k.f")).cast("long").alias("width"), F.when(odd, F.floor(F.col("height") / 8)).otherwise(F.floor(F.col("height") / F.col("k.f"))).cast("long").alias("height"), F.col("k.c").cast("long").alias("channels"))


PAGES = SLIDES + """, pages_ AS (SELECT slide_id, i AS page_index, floor(width / f)::BIGINT AS width, (CASE WHEN slide_id % 5 = 0 AND i = 4 THEN floor(height / 8) ELSE floor(height / f) END)::BIGINT AS height, c AS channels
  FROM slides, (VALUES (0::BIGINT, 1.0::DOUBLE, 3::BIGINT), (1, 300.0, 3), (2, 2.0, 1), (3, 2.0, 3), (4, 4.0, 3), (5, 16.0, 3), (6, 32.0, 3)) k(i, f, c))"""


def requests(spark: SparkSession, d: str) -> DataFrame:
    """Request lines and statuses: folder = user, the line by the type of the event."""
    e = read(spark, d, "events")
    line = F.when(F.col("event_type") == "view", "uni2, rotate").when(F.col("event_type") == "click", " gigapath ").when(F.col("event_type") == "purchase", "DONE").when(F.col("event_type") == "signup", "").otherwise("ERROR: no slide")
    return e.select("event_id", F.col("user_id").cast("string").alias("folder"), line.alias("line"), F.col("ts").cast("timestamp").alias("ts"), "event_type")


REQUESTS = """requests AS (SELECT event_id, user_id::VARCHAR AS folder, CASE event_type WHEN 'view' THEN 'uni2, rotate' WHEN 'click' THEN ' gigapath ' WHEN 'purchase' THEN 'DONE' WHEN 'signup' THEN '' ELSE 'ERROR: no slide' END AS line, ts, event_type FROM events)"""


def catalog_rows(spark: SparkSession, d: str) -> DataFrame:
    """Results under many keys: model by label, namespace by slide, filter path by column."""
    t = tiles(spark, d)
    model = F.when(F.col("label") < 4, "uni").when(F.col("label") < 7, "gigapath").otherwise("virchow2")
    namespace = F.when(F.col("slide_id") == 0, "default").when(F.col("slide_id") == 1, "001+002").otherwise("batch")
    path = F.when(F.col("col") < 15, "").when(F.col("col") < 20, "1+2+3").otherwise("1+2+3/0+1")
    return t.select(model.alias("model"), namespace.alias("namespace"), path.alias("filter_path"), "slide_id", "tile_id", "cluster")


CATALOG = TILES + """, catalog_rows AS (SELECT CASE WHEN label < 4 THEN 'uni' WHEN label < 7 THEN 'gigapath' ELSE 'virchow2' END AS model, CASE slide_id WHEN 0 THEN 'default' WHEN 1 THEN '001+002' ELSE 'batch' END AS namespace,
  CASE WHEN col < 15 THEN '' WHEN col < 20 THEN '1+2+3' ELSE '1+2+3/0+1' END AS filter_path, slide_id, tile_id, cluster FROM tiles)"""
