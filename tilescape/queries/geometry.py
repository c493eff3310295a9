"""Pyramid, grid, deep-zoom, thumbnail and blank-tile queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilescape.functions import blank, values
from tilescape.operators import geometry as G
from tilescape.queries.adapters import LEVELS, PAGES, PIXELS, SLIDES, TILES, Registry, levels, pages, pixels, slides, tiles

query = Registry()
QUERIES, ORACLE_SQL = query.queries, query.sql
#: Tile size of the deep-zoom queries; the SQL has it too.
DZI_SIZE = 1024

DISCOVERED = PAGES + """, fit AS (SELECT *, first_value(width) OVER w AS bw, first_value(height) OVER w AS bh FROM pages_ WHERE width >= 100 AND height >= 100 AND channels = 3 WINDOW w AS (PARTITION BY slide_id ORDER BY page_index)),
ds AS (SELECT *, bw / width AS downsample FROM fit), flagged AS (SELECT *, coalesce(abs(width / height - bw / bh) > 0.1 OR downsample / lag(downsample) OVER (PARTITION BY slide_id ORDER BY page_index) > 3.0, abs(width / height - bw / bh) > 0.1) AS bad FROM ds),
cut AS (SELECT *, max(bad::INT) OVER (PARTITION BY slide_id ORDER BY page_index ROWS UNBOUNDED PRECEDING) AS ended FROM flagged)"""


@query(f"WITH {DISCOVERED} SELECT slide_id, (row_number() OVER (PARTITION BY slide_id ORDER BY page_index) - 1)::BIGINT AS ordinal, page_index, width, height, round(downsample, 6) AS downsample FROM cut WHERE ended = 0")
def level_discovery(spark, d):
    return G.discover_levels(pages(spark, d)).withColumn("ordinal", F.col("ordinal").cast("long")).withColumn("downsample", F.round("downsample", 6))


@query(f"WITH {PAGES} SELECT slide_id, count(*) FILTER (width >= 100 AND height >= 100) > 1 AS pyramidal FROM pages_ GROUP BY slide_id")
def is_pyramidal(spark, d):
    return G.is_pyramidal(pages(spark, d))


@query(f"WITH {SLIDES} SELECT slide_id, round(CASE slide_id % 3 WHEN 0 THEN 25400.0 / (width / 7) WHEN 1 THEN 10000.0 / (width / 7) ELSE 1.0 / (width / 7) END, 6) AS mpp FROM slides")
def mpp_decode(spark, d):
    unit = F.when(F.col("slide_id") % 3 == 0, 2).when(F.col("slide_id") % 3 == 1, 3).otherwise(1)
    return slides(spark, d).select("slide_id", F.round(values.mpp(F.col("width"), F.lit(7), unit), 6).alias("mpp"))


NEAREST = "(SELECT *, row_number() OVER (PARTITION BY slide_id ORDER BY abs({value} - {target}), ordinal) AS rn FROM levels)"


@query(f"WITH {LEVELS} SELECT slide_id, ordinal, width, height, downsample FROM {NEAREST.format(value='0.25 * downsample', target='0.5')} WHERE rn = 1")
def best_level_mpp(spark, d):
    return G.nearest_level(levels(spark, d), 0.25 * F.col("downsample"), F.lit(0.5))


@query(f"WITH {LEVELS} SELECT slide_id, ordinal, width, height, downsample FROM {NEAREST.format(value='downsample', target='(slide_id % 40)')} WHERE rn = 1")
def best_level_downsample(spark, d):
    lv = levels(spark, d)
    return G.nearest_level(lv, F.col("downsample"), F.col("slide_id") % 40)


GRID = SLIDES + """, dims AS (SELECT *, width // 1024 AS cols, height // 1024 AS rows FROM slides),
grid AS (SELECT slide_id, row * cols + col AS tile_id, col, row, col * 1024 AS x, row * 1024 AS y, cols, rows FROM (SELECT *, unnest(generate_series(0, cols - 1)) AS col FROM (SELECT *, unnest(generate_series(0, rows - 1)) AS row FROM dims)))"""


@query(f"WITH {GRID} SELECT slide_id, tile_id, col, row, x, y FROM grid")
def tile_grid(spark, d):
    return G.tile_grid(slides(spark, d), 1024).select("slide_id", "tile_id", "col", "row", "x", "y")


@query(f"WITH {GRID} SELECT slide_id, tile_id, (row_number() OVER (PARTITION BY slide_id ORDER BY row, col) - 1)::BIGINT AS tile_number FROM grid WHERE (col * 7 + row * 13) % 5 != 0")
def tile_numbering(spark, d):
    return G.numbered_grid(slides(spark, d), 1024, lambda col, row: (col * 7 + row * 13) % 5 != 0)


@query(f"WITH {GRID} SELECT slide_id, tile_id, x, y FROM grid WHERE x < 3000 + 5000 AND x + 1024 > 3000 AND y < 2000 + 4000 AND y + 1024 > 2000")
def region_tiles(spark, d):
    return G.tile_grid(slides(spark, d), 1024).where(G.in_region(3000, 2000, 5000, 4000, 1024)).select("slide_id", "tile_id", "x", "y")


@query(f"WITH {SLIDES} SELECT slide_id, width // 256 AS cols, height // 256 AS rows, ((height // 256 + greatest(1, 512 // (width // 256)) - 1) // greatest(1, 512 // (width // 256)))::BIGINT AS batches FROM slides")
def batch_plan(spark, d):
    cols, rows = F.floor(F.col("width") / 256).cast("long"), F.floor(F.col("height") / 256).cast("long")
    return slides(spark, d).select("slide_id", cols.alias("cols"), rows.alias("rows"), G.batch_count(cols, rows, 512).alias("batches"))


@query(f"WITH {TILES} SELECT tile_id, (row_number() OVER (ORDER BY tile_id) - 1)::BIGINT // 64 AS batch FROM tiles")
def batch_assignment(spark, d):
    from pyspark.sql import Window

    # numbers run within a slide's row band first, so that no window spans the whole table
    t = tiles(spark, d).withColumn("band", F.floor(F.col("tile_id") / 4096))
    per = t.groupBy("band").agg(F.count("*").alias("n"))
    before = Window.partitionBy(F.lit(0)).orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(F.col("band").alias("b"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    t = t.withColumn("r", F.row_number().over(Window.partitionBy("band").orderBy("tile_id")) - 1).join(per, F.col("band") == F.col("b"))
    return t.select("tile_id", F.floor((F.col("before") + F.col("r")) / 64).cast("long").alias("batch"))


DZI = SLIDES + """, tops AS (SELECT *, ceil(log2(greatest(width, height)))::BIGINT AS max_level FROM slides), lv AS (SELECT *, unnest(generate_series(0, max_level)) AS level FROM tops),
dz AS (SELECT *, (1::BIGINT << (max_level - level)::INT) AS scale FROM lv), dzl AS (SELECT *, (width + scale - 1) // scale AS level_width, (height + scale - 1) // scale AS level_height FROM dz),
dzi AS (SELECT *, (level_width + 1023) // 1024 AS cols, (level_height + 1023) // 1024 AS rows FROM dzl)"""


@query(f"WITH {DZI} SELECT slide_id, max_level FROM tops")
def dzi_max_level(spark, d):
    return slides(spark, d).select("slide_id", G.dzi_max_level(F.col("width"), F.col("height")).cast("long").alias("max_level"))


@query(f"WITH {DZI} SELECT slide_id, level, scale, level_width, level_height, cols, rows FROM dzi")
def dzi_level_info(spark, d):
    out = G.dzi_levels(slides(spark, d), DZI_SIZE)
    return out.select("slide_id", F.col("level").cast("long").alias("level"), "scale", "level_width", "level_height", "cols", "rows")


DZI_TILES = DZI + ", dt AS (SELECT *, unnest(generate_series(0, cols - 1)) AS col FROM (SELECT *, unnest(generate_series(0, rows - 1)) AS row FROM dzi))"


def _dzi_tiles(spark, d):
    return G.dzi_tiles(G.dzi_levels(slides(spark, d), DZI_SIZE))


@query(f"WITH {DZI_TILES} SELECT slide_id, level, col, row FROM dt")
def dzi_tile_plan(spark, d):
    return _dzi_tiles(spark, d).select("slide_id", F.col("level").cast("long").alias("level"), "col", "row")


@query(
    f"""WITH {DZI_TILES}, native AS (SELECT slide_id AS s, ordinal, downsample FROM levels_), levels_ AS (SELECT slide_id, o AS ordinal, ds AS downsample FROM slides, (VALUES (0::BIGINT, 1.0::DOUBLE), (1, 4.0), (2, 16.0), (3, 64.0)) l(o, ds)),
pick AS (SELECT t.*, ordinal, downsample, row_number() OVER (PARTITION BY t.slide_id, level, col, row ORDER BY abs(downsample - scale), ordinal) AS rn FROM dt t JOIN native ON s = t.slide_id),
r AS (SELECT *, CASE WHEN col > 0 THEN 1 ELSE 0 END AS ml, CASE WHEN row > 0 THEN 1 ELSE 0 END AS mt FROM pick WHERE rn = 1),
q AS (SELECT *, least(col * 1024 + 1025, level_width) - col * 1024 + ml AS tw, least(row * 1024 + 1025, level_height) - row * 1024 + mt AS th FROM r)
SELECT slide_id, level, col, row, ordinal AS native_level, floor((col * 1024 * scale - ml * scale) / downsample)::BIGINT AS read_x, floor((row * 1024 * scale - mt * scale) / downsample)::BIGINT AS read_y,
floor(tw * scale / downsample)::BIGINT AS read_width, floor(th * scale / downsample)::BIGINT AS read_height, tw::BIGINT AS tile_width, th::BIGINT AS tile_height, abs(downsample - scale) > 0.01 AS resize FROM q""".replace(
        "native AS (SELECT slide_id AS s, ordinal, downsample FROM levels_), levels_ AS", "levels_ AS"
    ).replace("pick AS", "native AS (SELECT slide_id AS s, ordinal, downsample FROM levels_), pick AS")
)
def dzi_tile_rects(spark, d):
    out = G.dzi_rects(G.dzi_levels(slides(spark, d), DZI_SIZE), levels(spark, d), DZI_SIZE, overlap=1)
    return out.withColumn("level", F.col("level").cast("long"))


@query(f"WITH {DZI} SELECT slide_id, sum(cols * rows)::BIGINT AS tiles FROM dzi GROUP BY slide_id")
def dzi_tile_totals(spark, d):
    return G.dzi_levels(slides(spark, d), DZI_SIZE).groupBy("slide_id").agg(F.sum(F.col("cols") * F.col("rows")).alias("tiles"))


@query(
    f"""WITH {SLIDES} SELECT slide_id, '<?xml version="1.0" encoding="utf-8"?>' || chr(10) || '<Image xmlns="http://schemas.microsoft.com/deepzoom/2008"' || chr(10) || '       Format="jpeg"' || chr(10) || '       Overlap="0"' || chr(10) || '       TileSize="256">' || chr(10) || '  <Size Width="' || width || '" Height="' || height || '"/>' || chr(10) || '</Image>' AS xml FROM slides"""
)
def dzi_xml(spark, d):
    return slides(spark, d).select("slide_id", values.dzi_xml(F.lit(256), F.lit(0), F.lit("jpeg"), F.col("width"), F.col("height")).alias("xml"))


CROP = SLIDES + """, th AS (SELECT *, 400::BIGINT AS tw, 300::BIGINT AS tt, width / height AS sa, 400 / 300 AS ta FROM slides),
cw AS (SELECT *, (CASE WHEN abs(sa - ta) < 0.01 THEN width WHEN sa > ta THEN floor(height * ta) ELSE width END)::BIGINT AS crop_width, (CASE WHEN abs(sa - ta) < 0.01 THEN height WHEN sa > ta THEN height ELSE floor(width / ta) END)::BIGINT AS crop_height FROM th),
crop AS (SELECT *, (width - crop_width) // 2 AS crop_x, (height - crop_height) // 2 AS crop_y FROM cw)"""


@query(f"WITH {CROP} SELECT slide_id, tw AS target_width, tt AS target_height, crop_x, crop_y, crop_width, crop_height FROM crop")
def thumbnail_crop(spark, d):
    return G.thumbnail(slides(spark, d), 400, 300).select("slide_id", "target_width", "target_height", "crop_x", "crop_y", "crop_width", "crop_height")


@query(
    f"""WITH {CROP}, l AS (SELECT c.*, o, ds, row_number() OVER (PARTITION BY slide_id ORDER BY abs(ds - greatest(crop_width / tw, crop_height / tt)), o) AS rn FROM crop c, (VALUES (0::BIGINT, 1.0::DOUBLE), (1, 4.0), (2, 16.0), (3, 64.0)) v(o, ds))
SELECT slide_id, o AS native_level, floor(crop_x / ds)::BIGINT AS level_x, floor(crop_y / ds)::BIGINT AS level_y, floor(crop_width / ds)::BIGINT AS level_width, floor(crop_height / ds)::BIGINT AS level_height FROM l WHERE rn = 1"""
)
def thumbnail_level(spark, d):
    return G.thumbnail_level(G.thumbnail(slides(spark, d), 400, 300), levels(spark, d))


@query(f"WITH {TILES} SELECT tile_id, x // 256 * 64 AS canvas_x, y // 256 * 64 AS canvas_y, (25 - 1) * 64 - x // 256 * 64 AS rotated_x, (80 - 1) * 64 - y // 256 * 64 AS rotated_y FROM tiles")
def canvas_placement(spark, d):
    t = tiles(spark, d).withColumn("cols", F.lit(25).cast("long")).withColumn("rows", F.lit(80).cast("long"))
    plain = G.placement(t, 256, 64)
    turned = G.placement(plain.withColumnsRenamed({"canvas_x": "px", "canvas_y": "py"}), 256, 64, rotate=True)
    return turned.select("tile_id", F.col("px").alias("canvas_x"), F.col("py").alias("canvas_y"), F.col("canvas_x").alias("rotated_x"), F.col("canvas_y").alias("rotated_y"))


@query(f"WITH {PIXELS} SELECT tile_id, avg((greatest(r, g, b) - least(r, g, b) < 20)::INT) > 0.9 AS blank FROM px GROUP BY tile_id")
def white_ptp(spark, d):
    return pixels(spark, d).select("tile_id", blank.detector("ptp")(F.col("pixels")).alias("blank"))


@query(f"WITH {PIXELS} SELECT tile_id, avg(((r*r + g*g + b*b) / 3.0::DOUBLE - ((r + g + b) / 3.0::DOUBLE) * ((r + g + b) / 3.0::DOUBLE) < 49.0)::INT) > 0.75 AS blank FROM px GROUP BY tile_id")
def white_std(spark, d):
    return pixels(spark, d).select("tile_id", blank.detector("std")(F.col("pixels")).alias("blank"))


@query(f"WITH {PIXELS} SELECT tile_id, sum(g) / 21 / 255.0::DOUBLE > 0.96 AS blank FROM px GROUP BY tile_id")
def white_green(spark, d):
    return pixels(spark, d).select("tile_id", blank.detector("green", 0.96)(F.col("pixels")).alias("blank"))


@query(
    f"""WITH {PIXELS}, gr AS (SELECT tile_id, floor(0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b + 0.5)::BIGINT AS v FROM px), tot AS (SELECT tile_id, sum(v)::BIGINT AS s, count(*) AS n FROM gr GROUP BY tile_id),
h AS (SELECT tile_id, v, count(*) AS c FROM gr GROUP BY tile_id, v), cum AS (SELECT h.tile_id, v, sum(c) OVER w AS w, sum(c * v) OVER w AS sw, s, n FROM h JOIN tot USING (tile_id) WINDOW w AS (PARTITION BY h.tile_id ORDER BY v)),
b AS (SELECT *, CASE WHEN w < n THEN (sw * n - s * w)::DOUBLE * (sw * n - s * w)::DOUBLE / (w::DOUBLE * (n - w)) ELSE 0.0::DOUBLE END AS between_ FROM cum), best AS (SELECT *, row_number() OVER (PARTITION BY tile_id ORDER BY between_ DESC, v) AS rn FROM b)
SELECT gr.tile_id, any_value(best.v) AS threshold, avg((gr.v > best.v)::INT) > 0.8 AS blank FROM gr JOIN best ON gr.tile_id = best.tile_id AND rn = 1 GROUP BY gr.tile_id"""
)
def white_otsu(spark, d):
    return pixels(spark, d).select("tile_id", blank.otsu_threshold(F.col("pixels")).cast("long").alias("threshold"), blank.detector("otsu")(F.col("pixels")).alias("blank"))


@query(f"WITH {PIXELS} SELECT tile_id, p, round((r / 255.0::DOUBLE - 0.485) / 0.229, 6) AS r, round((g / 255.0::DOUBLE - 0.456) / 0.224, 6) AS g, round((b / 255.0::DOUBLE - 0.406) / 0.225, 6) AS b FROM px")
def pixel_normalize(spark, d):
    from tilescape.config import IMAGENET

    px = pixels(spark, d).select("tile_id", F.posexplode("pixels").alias("p", "px"))
    return px.select("tile_id", F.col("p").cast("long").alias("p"), *[F.round((F.col(f"px.{c}") / 255.0 - m) / s, 6).alias(c) for c, m, s in zip("rgb", *IMAGENET, strict=True)])
