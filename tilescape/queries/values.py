"""Paths, file types, colours, sizes, scores, devices, requests and presets."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilescape.config import PALETTE, SLIDE_PRESETS, TILE_PRESETS
from tilescape.functions import paths, values
from tilescape.operators import catalog
from tilescape.queries.adapters import REQUESTS, SCORES, TILES, Registry, requests, scores, tiles
from tilescape.sources.tables import read, shared_folder
from tilescape.streaming import requests as stream

query = Registry()
QUERIES, ORACLE_SQL = query.queries, query.sql

EXTENSIONS = ("ndpi", "svs", "h5", "tif", "jpg", "png", "txt", "PNG")
FILES = "files AS (SELECT c_custkey AS id, '/data/' || c_mktsegment || '/' || c_name || CASE WHEN c_custkey % 7 = 0 THEN '+b' ELSE '' END || '.' || ['ndpi', 'svs', 'h5', 'tif', 'jpg', 'png', 'txt', 'PNG'][(c_custkey % 8 + 1)::INT] AS path, c_custkey % 11 = 0 AS is_dir, c_mktsegment AS directory, c_custkey AS n FROM customer)"


def files(spark, d):
    c = read(spark, d, "customer")
    ext = F.element_at(F.array(*map(F.lit, EXTENSIONS)), (F.col("c_custkey") % 8 + 1).cast("int"))
    path = F.concat(F.lit("/data/"), "c_mktsegment", F.lit("/"), "c_name", F.when(F.col("c_custkey") % 7 == 0, "+b").otherwise(""), F.lit("."), ext)
    return c.select(F.col("c_custkey").alias("id"), path.alias("path"), (F.col("c_custkey") % 11 == 0).alias("is_dir"), F.col("c_mktsegment").alias("directory"))


EXT = "lower(regexp_extract(path, '(\\.[^./]+)$', 1))"


@query(f"WITH {FILES} SELECT id, translate(regexp_replace(split_part(path, '/', -1), '^(.+)\\.[^.]+$', '\\1'), '+/', '__') AS name FROM files")
def normalize_filename(spark, d):
    return files(spark, d).select("id", paths.normalized_name(F.col("path")).alias("name"))


@query(f"WITH {FILES} SELECT id, CASE WHEN is_dir THEN 'directory' WHEN {EXT} IN ('.ndpi', '.svs') THEN 'wsi' WHEN {EXT} = '.h5' THEN 'hdf5' WHEN {EXT} IN ('.bmp', '.gif', '.icns', '.ico', '.jpg', '.jpeg', '.png', '.tif', '.tiff') THEN 'image' ELSE 'other' END AS type FROM files")
def file_type_classify(spark, d):
    return files(spark, d).select("id", paths.file_type(F.col("path"), F.col("is_dir")).alias("type"))


@query(f"WITH {FILES} SELECT id, CASE WHEN {EXT} IN ('.tif', '.tiff') THEN CASE WHEN id % 3 > 1 THEN 'tifffile' ELSE 'standard' END WHEN {EXT} IN ('.jpg', '.jpeg', '.png') THEN 'standard' ELSE 'openslide' END AS engine FROM files")
def source_engine_dispatch(spark, d):
    return files(spark, d).select("id", paths.reader_engine(F.col("path"), F.col("id") % 3).alias("engine"))


@query(f"WITH {FILES} SELECT id, CASE WHEN id % 2 = 0 THEN '/data/' || directory || '/plot.jpg' ELSE '/data/' || directory || '/ns' || (id % 3) || '/plot.jpg' END AS output FROM files")
def output_path_rule(spark, d):
    ns = F.when(F.col("id") % 2 == 0, F.lit("default")).otherwise(F.concat(F.lit("ns"), F.col("id") % 3))
    return files(spark, d).select("id", paths.output_path(F.col("path"), ns, F.lit("plot.jpg")).alias("output"))


@query(f"WITH {FILES} SELECT directory, CASE WHEN count(*) = 1 THEN 'default' ELSE string_agg(translate(regexp_replace(split_part(path, '/', -1), '^(.+)\\.[^.]+$', '\\1'), '+/', '__'), '+' ORDER BY translate(regexp_replace(split_part(path, '/', -1), '^(.+)\\.[^.]+$', '\\1'), '+/', '__')) END AS namespace FROM files GROUP BY directory")
def build_namespace(spark, d):
    some = files(spark, d).groupBy("directory").agg(F.collect_list("path").alias("paths"))
    return some.select("directory", paths.namespace_of(F.col("paths")).alias("namespace"))


@query(f"WITH {TILES}, n AS (SELECT tile_id, ['default', 'features', '', 'a+b', 'metadata', 'batch1', 'aggregates'][(tile_id % 7 + 1)::INT] AS namespace FROM tiles) SELECT tile_id, namespace, namespace != '' AND namespace NOT IN ('features', 'metadata', 'latent_features') AS valid FROM n")
def validate_namespace(spark, d):
    names = F.array(*map(F.lit, ("default", "features", "", "a+b", "metadata", "batch1", "aggregates")))
    n = tiles(spark, d).select("tile_id", F.element_at(names, (F.col("tile_id") % 7 + 1).cast("int")).alias("namespace"))
    return n.withColumn("valid", paths.valid_namespace(F.col("namespace")))


@query(f"WITH {FILES} SELECT id, regexp_matches(lower(directory), '^[a-z0-9]+$') AS valid FROM files")
def namespace_regex(spark, d):
    return files(spark, d).select("id", paths.user_namespace(F.lower("directory")).alias("valid"))


IDS = "[[tile_id % 10, (tile_id + 3) % 10, 2], [tile_id % 4]]"


@query(f"WITH {TILES} SELECT tile_id, 'uni/default' || list_aggregate(list_transform({IDS}, lambda ids: '/filter/' || list_aggregate(list_transform(list_sort(ids), lambda x: x::VARCHAR), 'string_agg', '+')), 'string_agg', '') || '/clusters' AS path FROM tiles")
def build_filter_path(spark, d):
    ids = F.array(F.array(F.col("tile_id") % 10, (F.col("tile_id") + 3) % 10, F.lit(2).cast("long")), F.array(F.col("tile_id") % 4))
    return tiles(spark, d).select("tile_id", paths.filter_path(F.lit("uni"), F.lit("default"), ids, F.lit("clusters")).alias("path"))


@query(f"WITH {TILES} SELECT tile_id, 'uni' AS model, 'ns' || (tile_id % 3) AS namespace, 2::BIGINT AS levels, (tile_id % 10 + 2)::BIGINT AS first_sum, 'pca2' AS dataset FROM tiles")
def parse_filter_path(spark, d):
    path = F.concat(F.lit("uni/ns"), F.col("tile_id") % 3, F.lit("/filter/"), F.col("tile_id") % 10, F.lit("+2/filter/0+1/pca2"))
    p = tiles(spark, d).select("tile_id", paths.parsed_path(path).alias("p"))
    return p.select("tile_id", "p.model", "p.namespace", F.size("p.filters").cast("long").alias("levels"), F.aggregate(F.col("p.filters")[0], F.lit(0), lambda a, x: a + x).cast("long").alias("first_sum"), "p.dataset")


@query(f"WITH {TILES} SELECT tile_id, l - 1 AS level, unnest(list_transform(string_split(string_split((tile_id % 5) || '+7/3+' || (tile_id % 2), '/')[l], '+'), lambda x: x::BIGINT)) AS id FROM tiles, (VALUES (1::BIGINT), (2)) v(l)")
def parse_filter_string(spark, d):
    text = F.concat(F.col("tile_id") % 5, F.lit("+7/3+"), F.col("tile_id") % 2)
    level = tiles(spark, d).select("tile_id", F.posexplode(paths.parsed_filter(text)).alias("level", "ids"))
    return level.select("tile_id", F.col("level").cast("long").alias("level"), F.explode("ids").alias("id")).withColumn("id", F.col("id").cast("long"))


@query("SELECT p_partkey AS id, CASE WHEN n = 0 THEN '' WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN floor(n / 1024 + 0.5)::BIGINT || ' KB' WHEN n < 1073741824 THEN floor(n / 1048576 + 0.5)::BIGINT || ' MB' ELSE floor(n / 1073741824 + 0.5)::BIGINT || ' GB' END AS size FROM (SELECT p_partkey, (p_partkey % 50) * p_partkey * p_partkey * p_size AS n FROM part)")
def format_size(spark, d):
    p = read(spark, d, "part")
    return p.select(F.col("p_partkey").alias("id"), values.byte_size((F.col("p_partkey") % 50) * F.col("p_partkey") * F.col("p_partkey") * F.col("p_size")).alias("size"))


COLOURS = "[" + ", ".join(f"'{c}'" for c in PALETTE) + "]"


@query(f"WITH {TILES} SELECT tile_id, {COLOURS}[(((cluster % 20) + 20) % 20 + 1)::INT] AS colour FROM tiles")
def cluster_color(spark, d):
    return tiles(spark, d).select("tile_id", values.cluster_colour(F.col("cluster")).alias("colour"))


LINEAR = "CASE WHEN {c} <= 0.03928 THEN {c} / 12.92 ELSE pow(({c} + 0.055) / 1.055, 2.4) END"


@query(
    f"WITH {TILES}, c AS (SELECT tile_id, (tile_id * 7 % 256) AS r, (tile_id * 13 % 256) AS g, (tile_id * 29 % 256) AS b FROM tiles), u AS (SELECT tile_id, printf('#%02x%02x%02x', r, g, b) AS colour, r / 255.0::DOUBLE AS r, g / 255.0::DOUBLE AS g, b / 255.0::DOUBLE AS b FROM c) "
    f"SELECT tile_id, colour, CASE WHEN 0.2126 * {LINEAR.format(c='r')} + 0.7152 * {LINEAR.format(c='g')} + 0.0722 * {LINEAR.format(c='b')} > 0.179 THEN 'black' ELSE 'white' END AS text FROM u"
)
def contrast_color(spark, d):
    colour = F.format_string("#%02x%02x%02x", F.col("tile_id") * 7 % 256, F.col("tile_id") * 13 % 256, F.col("tile_id") * 29 % 256)
    return tiles(spark, d).select("tile_id", colour.alias("colour")).withColumn("text", values.contrast_colour(F.col("colour")))


@query(f"WITH {SCORES} SELECT tile_id, CASE WHEN cluster >= 0 THEN round_even(value, 3) + 0.0 END AS score FROM scores")
def score_quantize(spark, d):
    v = F.when(F.col("cluster") >= 0, F.col("value")).otherwise(F.lit(float("nan")))
    return scores(spark, d).select("tile_id", values.quantised_score(v).alias("score"))


@query(f"WITH {TILES} SELECT slide_id, tile_id, {COLOURS}[(cluster % 20 + 1)::INT] AS colour, cluster::VARCHAR AS label, x // 256 * 64 AS canvas_x, y // 256 * 64 AS canvas_y FROM tiles WHERE cluster >= 0")
def cluster_overlay_plan(spark, d):
    from tilescape.operators.geometry import placement

    t = placement(tiles(spark, d).where("cluster >= 0"), 256, 64)
    return t.select("slide_id", "tile_id", values.cluster_colour(F.col("cluster")).alias("colour"), F.col("cluster").cast("string").alias("label"), "canvas_x", "canvas_y")


@query(f"WITH {TILES}, s AS (SELECT tile_id, ['auto', 'cpu', 'cuda', 'cuda:1', 'cuda:0,1,3', 'cuda:9', 'tpu'][(tile_id % 7 + 1)::INT] AS spec FROM tiles) SELECT tile_id, spec, CASE spec WHEN 'auto' THEN 'cuda:0|cuda:1' WHEN 'cuda' THEN 'cuda:0' WHEN 'cuda:1' THEN 'cuda:1' WHEN 'cuda:0,1,3' THEN 'cuda:0|cuda:1' ELSE 'cpu' END AS devices FROM s")
def parse_device_spec(spark, d):
    specs = F.array(*map(F.lit, ("auto", "cpu", "cuda", "cuda:1", "cuda:0,1,3", "cuda:9", "tpu")))
    s = tiles(spark, d).select("tile_id", F.element_at(specs, (F.col("tile_id") % 7 + 1).cast("int")).alias("spec"))
    return s.withColumn("devices", F.array_join(values.device_list(F.col("spec"), 2), "|"))


@query(f"WITH {REQUESTS} SELECT event_id, CASE WHEN trim(split_part(line, ',', 1)) = '' THEN 'uni2' ELSE trim(split_part(line, ',', 1)) END AS preset, lower(trim(split_part(line, ',', 2))) = 'rotate' AS rotate FROM requests")
def parse_request_line(spark, d):
    return requests(spark, d).select("event_id", values.request(F.col("line")).alias("r")).select("event_id", "r.preset", "r.rotate")


@query(f"WITH {REQUESTS} SELECT event_id FROM requests WHERE regexp_matches(line, '^(PROCESSING|DONE|ERROR)')")
def request_status_filter(spark, d):
    return requests(spark, d).where(values.is_status(F.col("line"))).select("event_id")


@query(f"WITH {REQUESTS}, r AS (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY ts, line) AS rn FROM requests WHERE trim(line) != '' AND NOT regexp_matches(line, '^(PROCESSING|DONE|ERROR)')) SELECT folder, trim(split_part(line, ',', 1)) AS preset, epoch_us(ts)::BIGINT AS micros FROM r WHERE rn = 1")
def request_dedupe(spark, d):
    rows = requests(spark, d)
    asked = rows.where((F.length(F.trim("line")) > 0) & ~values.is_status(F.col("line")))
    one = stream.parsed(stream.first_request(asked))
    return one.select("folder", "preset", F.unix_micros("ts").alias("micros"))


@query(f"WITH {REQUESTS}, r AS (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY ts DESC, event_type DESC) AS rn FROM requests) SELECT folder, event_type AS status, epoch_us(ts)::BIGINT AS micros FROM r WHERE rn = 1")
def latest_status(spark, d):
    rows = requests(spark, d).select("folder", F.col("event_type").alias("status"), "ts")
    return stream.latest_status(rows).select("folder", "status", F.unix_micros("ts").alias("micros"))


@query()
def request_stream(spark, d):
    """Requests through a stream over files, worked off once; the jobs just record their folder."""
    base = shared_folder(spark, "requests")
    requests(spark, d).select("folder", "line", "ts").write.json(f"{base}/in")
    stream.watch(spark, f"{base}/in", f"{base}/checkpoint", f"{base}/status", lambda *_: None).awaitTermination()
    return spark.read.schema(stream.STATUS).parquet(f"{base}/status").select("folder", "status", "preset", "rotate")


@query("SELECT l_orderkey AS run, kept || '/' || total || ' patches (' || printf('%.1f', round_even(kept / total * 100, 1)) || '%), filtered=' || (total - kept) || ', ' || n || ' batches, ' || floor(price)::BIGINT // 60 || 'm' || floor(price)::BIGINT % 60 || 's elapsed (' || printf('%.2f', 1.25::DOUBLE) || '±' || printf('%.2f', 0.5::DOUBLE) || 's/batch), model=uni2, dim=1536' AS summary FROM (SELECT l_orderkey, count(*) AS n, sum(l_quantity)::BIGINT AS kept, sum(l_quantity)::BIGINT + count(*) AS total, max(l_extendedprice) AS price FROM lineitem GROUP BY l_orderkey)")
def extract_summary(spark, d):
    t = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("run")).agg(F.count("*").alias("n"), F.sum("l_quantity").cast("long").alias("kept"), F.max("l_extendedprice").alias("price"))
    total = F.col("kept") + F.col("n")
    return t.select("run", values.extraction_summary(F.col("kept"), total, F.col("n"), F.col("price"), F.lit(1.25), F.lit(0.5), F.lit("uni2"), F.lit(1536)).alias("summary"))


@query("SELECT * FROM (VALUES " + ", ".join(f"('{p}', {i}::BIGINT, {v[0]}::BIGINT, {v[1][0]}::DOUBLE, {v[2][0]}::DOUBLE)" for i, (p, v) in enumerate(TILE_PRESETS.items())) + ") t(preset, ordinal, dim, mean_r, std_r)")
def preset_catalog(spark, d):
    rows = [(p, i, dim, mean[0], std[0]) for i, (p, (dim, mean, std)) in enumerate(TILE_PRESETS.items())]
    return spark.createDataFrame(rows, "preset string, ordinal long, dim long, mean_r double, std_r double")


@query(f"WITH {TILES}, m AS (SELECT DISTINCT slide_id, 'm' || (label % 5) AS model, CASE WHEN label % 5 = slide_id THEN 'conch15_768' WHEN label % 5 = 4 AND slide_id = 1 THEN 'conch15_768' ELSE 'uni2' END AS preset FROM tiles WHERE NOT (slide_id = 2 AND label % 5 = 2)), g AS (SELECT slide_id, count(*) FILTER (preset = 'conch15_768') AS n, min(model) FILTER (preset = 'conch15_768') AS model FROM m GROUP BY slide_id) SELECT slide_id, n, CASE WHEN n = 1 THEN model END AS model, CASE WHEN n = 0 THEN 'none' WHEN n = 1 THEN 'ok' ELSE 'several' END AS status FROM g")
def resolve_tile_model(spark, d):
    k = F.col("label") % 5
    t = tiles(spark, d).where(~((F.col("slide_id") == 2) & (k == 2)))
    m = t.select("slide_id", F.concat(F.lit("m"), k).alias("model"), F.when((k == F.col("slide_id")) | ((k == 4) & (F.col("slide_id") == 1)), "conch15_768").otherwise("uni2").alias("preset")).distinct()
    return catalog.resolved_model(m, SLIDE_PRESETS["titan"])
