"""Properties and golden cases of the parts that SQL cannot check."""

import itertools
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilescape.config import EngineConfig
from tilescape.functions import blank, paths, values
from tilescape.operators import catalog, embed, geometry, graph, knn, pca, scope, stats, umap
from tilescape.plans import analysis as plan
from tilescape.queries import geometry as geometry_queries
from tilescape.sources import tables, tiff
from tilescape.streaming import requests


@pytest.fixture(scope="module")
def blobs(spark):
    return spark.createDataFrame(plan.sample_blobs(), "slide_id long, tile_id long, features array<double>").cache()


def one(spark, column):
    return spark.range(1).select(column.alias("c")).first()["c"]


def test_path_grammar(spark):
    ids = F.array(F.array(*map(F.lit, (3, 1, 2))), F.array(*map(F.lit, (1, 0))))
    text = one(spark, paths.filter_path(F.lit("uni"), F.lit("001+002"), ids, F.lit("clusters")))
    assert text == "uni/001+002/filter/1+2+3/filter/0+1/clusters"
    back = one(spark, paths.parsed_path(F.lit(text)))
    assert (back["model"], back["namespace"], back["filters"], back["dataset"]) == ("uni", "001+002", [[1, 2, 3], [0, 1]], "clusters")
    assert one(spark, paths.filter_path(F.lit("uni"), F.lit("default"), F.array().cast("array<array<int>>"), F.lit("umap"))) == "uni/default/umap"
    assert one(spark, paths.parsed_filter(F.lit("10+2/0"))) == [[10, 2], [0]]
    assert one(spark, paths.normalized_name(F.lit("/a/b+c.d.h5"))) == "b_c.d"


def test_namespaces():
    assert catalog.check_namespace("batch") == "batch"
    for bad in ("", "features", "metadata"):
        with pytest.raises(ValueError):
            catalog.check_namespace(bad)
    with pytest.raises(ValueError):
        catalog.check_namespace("a+b", user=True)
    assert plan.run_namespace(["x/b.h5", "a+.h5"], None) == "a_+b" and plan.run_namespace(["x.h5"], None) == "default"


def test_rename_and_remove(spark):
    rows = spark.createDataFrame([("m", "a", "", 1, 1, 0), ("m", "b", "1", 1, 2, 0)], "model string, namespace string, filter_path string, slide_id long, tile_id long, cluster long")
    with pytest.raises(ValueError):
        catalog.renamed(rows, "a", "b")
    with pytest.raises(ValueError):
        catalog.renamed(rows, "zzz", "c")
    with pytest.raises(ValueError):
        catalog.removed(rows, "features")
    assert {r["namespace"] for r in catalog.renamed(rows, "a", "c").collect()} == {"c", "b"}


def test_deep_zoom_levels(spark):
    sizes = [(1, 1), (256, 256), (257, 1000), (2, 1)]
    df = spark.createDataFrame([(i, w, h) for i, (w, h) in enumerate(sizes)], "slide_id long, width long, height long")
    got = {r["slide_id"]: r["m"] for r in df.select("slide_id", geometry.dzi_max_level(F.col("width"), F.col("height")).alias("m")).collect()}
    assert got == {i: math.ceil(math.log2(max(w, h))) for i, (w, h) in enumerate(sizes)}
    for r in geometry.dzi_levels(df).collect():
        assert r["level_width"] == math.ceil(r["width"] / r["scale"]) and r["rows"] == math.ceil(r["level_height"] / 256)


def test_grid_of_a_narrow_slide_is_empty(spark):
    df = spark.createDataFrame([(1, 255, 9000), (2, 600, 300)], "slide_id long, width long, height long")
    assert [(r["slide_id"], r["tile_id"], r["x"], r["y"]) for r in geometry.tile_grid(df, 256).orderBy("tile_id").collect()] == [(2, 0, 0, 0), (2, 1, 256, 0)]


def test_thumbnail_needs_a_side(spark):
    with pytest.raises(ValueError):
        geometry.thumbnail(spark.range(1), -1, -1)


def test_detectors(spark):
    white = F.array(*[F.struct(*[F.lit(250).alias(c) for c in "rgb"]) for _ in range(10)])
    red = F.array(*[F.struct(F.lit(200).alias("r"), F.lit(20).alias("g"), F.lit(40).alias("b")) for _ in range(10)])
    assert [one(spark, blank.detector(m)(white)) for m in ("ptp", "std", "green")] == [True] * 3
    assert [one(spark, blank.detector(m)(red)) for m in ("ptp", "std", "green", "otsu")] == [False] * 4
    with pytest.raises(ValueError):
        blank.detector("nope")
    assert blank.parse_detector([]) == ("ptp", None) and blank.parse_detector(["std", "0.8"]) == ("std", 0.8)


def test_constant_dimension(spark):
    df = spark.createDataFrame([(0, i, [1.0, float(i)]) for i in range(4)], "slide_id long, tile_id long, features array<double>")
    z = np.array([r["features"] for r in stats.standardised(df).orderBy("tile_id").collect()])
    assert (z[:, 0] == 0).all() and abs(z[:, 1].std() - 1) < 1e-12
    scaled = stats.min_max(df.select(F.lit(3.0).alias("value"))).select("scaled").distinct().collect()
    assert [r["scaled"] for r in scaled] == [0.0]


@pytest.mark.parametrize(("means", "expected"), [([0.0, 8.0, 9.0, 10.0], [3, 2, 1, 0]), ([0.0, 1.0, 2.0, 10.0], [0, 1, 2, 3]), ([5.0], [0])])
def test_reorder(spark, means, expected):
    df = spark.createDataFrame([(c, m) for c, m in enumerate(means)] + [(-1, 0.0)], "cluster long, value double")
    got = {r["value"]: r["cluster"] for r in stats.reorder_clusters(df).where("cluster >= 0").collect()}
    assert [got[m] for m in means] == expected
    assert stats.reorder_clusters(df).where("cluster = -1").count() == 1


def test_components_match_numpy(spark, blobs):
    x = np.array([r["features"] for r in blobs.orderBy("tile_id").collect()])
    mean, components, ratios = pca.fit(blobs)
    _, s, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert np.allclose(ratios, s**2 / (s**2).sum()) and np.allclose(np.abs(components), np.abs(vt), atol=1e-6) and np.allclose(mean, x.mean(0))
    assert pca.n_for_variance(np.array([0.5, 0.3, 0.2])) == 3 and pca.n_for_variance(np.array([0.5, 0.3])) == 2
    with pytest.raises(ValueError):
        plan.component_scores(plan.Scope(blobs), 4)


def test_blocked_neighbours_match_brute_force(spark, blobs):
    rows = blobs.select(F.col("tile_id").alias("id"), "features")
    got = {(r["i"], r["rank"]): r["j"] for r in knn.knn(rows, 5, block_rows=40).collect()}
    x = np.array([r["features"] for r in blobs.orderBy("tile_id").collect()])
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    for i in range(len(x)):
        assert [got[i, r] for r in range(1, 6)] == list(np.lexsort((np.arange(len(x)), d[i]))[:5])


def test_duplicate_vectors_have_edges(spark):
    rows = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(6)], "id long, features array<double>")
    edges = knn.undirected(knn.directed_edges(knn.knn(rows, 3)))
    assert edges.where("src >= dst").count() == 0 and edges.count() > 0



def test_ties_beyond_the_kept_candidates_go_to_the_smaller_id(spark):
    """A third of the rows are copies of one vector; each has more neighbours at distance 0 than are kept."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 16))
    x[200:400] = x[200]
    x[400:430] = x[400] + 1e-3
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, features array<double>")
    d2 = ((x[:, None, :] - x[None, :, :]) ** 2).sum(2)
    best = np.argsort(d2, axis=1, kind="stable")[:, :8]
    got = {(r["i"], r["rank"]): r["j"] for r in knn.knn(rows, 8, block_rows=300).collect()}
    assert got == {(i, r + 1): int(j) for i in range(600) for r, j in enumerate(best[i])}


def test_candidates_of_a_row_are_not_shuffled(spark, blobs):
    """Rows go to the bands; nothing is dealt out anew after the neighbours are found."""
    rows = blobs.select(F.col("tile_id").alias("id"), "features")
    tree = knn.knn(rows, 5, block_rows=40, n=180)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in tree and tree.count("Exchange") == 1 and tree.index("MapInArrow") < tree.index("Exchange")  # the root comes first


def test_a_band_keeps_the_first_of_equally_near_ones_whatever_the_chunks():
    rng = np.random.default_rng(5)
    x = np.repeat(rng.normal(size=(80, 6)), 5, axis=0)[rng.permutation(400)]
    d2 = ((x[:, None, :] - x[None, :, :]) ** 2).sum(2)
    for k, cut in ((7, 50), (60, 33), (500, 90)):
        band = knn._Band(np.arange(100, 140), x[100:140], k)
        for at in range(0, 400, cut):
            band.meet(np.arange(400)[at : at + cut], x[at : at + cut])
        assert (band.at == np.argsort(d2[100:140], axis=1, kind="stable")[:, :k]).all()


def test_communities_of_neighbour_lists_are_those_of_their_edges(spark):
    x = np.random.default_rng(6).normal(size=(300, 4))
    rows = spark.createDataFrame([(7 * i, v.tolist()) for i, v in enumerate(x)], "id long, features array<double>")
    scope = F.lit(0).cast("long").alias("scope")
    edges = knn.undirected(knn.directed_edges(knn.knn(rows, 12, block_rows=100))).select(scope, "src", "dst", F.lit(1.0).alias("weight"))
    lists = knn.neighbour_lists(rows, 12, block_rows=100).select(scope, "at", F.col("i").alias("node"), "near")
    expected = graph.communities(edges, rows.select(scope, F.col("id").alias("node"))).collect()
    assert sorted(graph.list_communities(lists).collect()) == sorted(expected) and len(expected) == 300
    assert len({r["community"] for r in expected}) > 3


def connected_inside(labels, pairs):
    parent = {n: n for n in labels}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in pairs:
        if labels[a] == labels[b]:
            parent[find(a)] = find(b)
    return all(len({find(n) for n in labels if labels[n] == c}) == 1 for c in set(labels.values()))


def test_communities_of_planted_groups(spark, blobs):
    got = plan.cluster(spark, plan.Scope(blobs), EngineConfig(resolution=0.3)).collect()
    label = {r["tile_id"]: r["cluster"] for r in got}
    assert len(label) == 180 and set(label.values()) == {0, 1, 2}
    for k in range(3):
        assert len({label[i] for i in range(k * 60, k * 60 + 60)}) == 1
    again = {r["tile_id"]: r["cluster"] for r in plan.cluster(spark, plan.Scope(blobs.repartition(5)), EngineConfig(resolution=0.3)).collect()}
    assert again == label


def test_leiden_properties():
    rng = np.random.default_rng(1)
    pairs = {(min(a, b), max(a, b)) for a, b in rng.integers(0, 60, (200, 2)) if a != b} | {(i, i + 1) for i in range(59)}
    src, dst = np.array(sorted(pairs)).T
    label = graph.leiden(60, src, dst, np.ones(len(src)))
    assert set(label) == set(range(label.max() + 1))
    assert connected_inside(dict(enumerate(label)), pairs)
    k = np.bincount(np.concatenate([src, dst]), minlength=60)
    quality = lambda c: 2 * (c[src] == c[dst]).sum() - (np.bincount(c, weights=k) ** 2).sum() / (2 * len(src))
    assert quality(label) > quality(np.arange(60))
    assert (label == graph.leiden(60, src, dst, np.ones(len(src)))).all()


def test_drill_down_into_all_clusters_is_the_parent(spark, blobs):
    top = blobs.select(F.lit("").alias("filter_path"), "slide_id", "tile_id", F.lit(0).alias("cluster"))
    assert plan.Scope(blobs, top, "", (0,)).rows().count() == blobs.count()
    with pytest.raises(ValueError):
        scope.members(top, "", [-1])


def test_nan_is_refused(spark):
    df = spark.createDataFrame([(0, 0, [1.0, float("nan")])], "slide_id long, tile_id long, features array<double>")
    with pytest.raises(ValueError):
        plan.component_scores(plan.Scope(df))


def test_layout_keeps_neighbours(spark, blobs):
    got = plan.layout(plan.Scope(blobs), EngineConfig(n_neighbors=10)).orderBy("tile_id").collect()
    pos = np.array([r["values"] for r in got])
    assert pos.shape == (180, 2) and np.isfinite(pos).all()
    near = np.argsort(((pos[:, None] - pos[None]) ** 2).sum(2), axis=1)[:, 1:6]
    assert (near // 60 == np.arange(180)[:, None] // 60).mean() > 0.8
    a, b = umap.curve(0.1)
    assert 1.2 < a < 2.0 and 0.7 < b < 1.1


def test_latent_tokens_must_be_square(spark):
    df = spark.createDataFrame([(0, 0, [[1.0, 2.0, 3.0]] * 3)], "slide_id long, tile_id long, tokens array<array<double>>")
    with pytest.raises(ValueError):
        plan.latent_rgb(df)


def test_tiff_source_and_features(spark, tmp_path):
    rng = np.random.default_rng(0)
    image = rng.integers(0, 255, (300, 200, 3), dtype=np.uint8)
    path = str(tmp_path / "a.tif")
    tiff.write_tiff(path, [image, image[::2, ::2]], mpp=0.25)
    with open(path, "rb") as f:
        found = tiff.pages(f)
    assert [p.shape for p in found] == [(300, 200, 3), (150, 100, 3)] and abs(found[0].mpp - 0.25) < 1e-6
    tiff.register(spark)
    tiles = spark.read.format("tile_tiff").option("path", path).option("patch_size", 64).load()
    got = {r["tile_id"]: r for r in tiles.collect()}
    assert len(got) == 12
    for r in got.values():
        block = np.frombuffer(r["rgb"], np.uint8).reshape(64, 64, 3)
        assert (block == image[r["y"] : r["y"] + 64, r["x"] : r["x"] + 64]).all()
    features = embed.extract(tiles.withColumn("slide_id", F.lit(1).cast("long")), "conch15_768")
    assert features.where(F.size("features") == 768).count() == 12
    pooled = embed.aggregate(features, lambda x, xy: x.mean(0)).first()["feature"]
    assert np.allclose(pooled, embed.mean_pool(features).first()["feature"], atol=1e-5)
    with pytest.raises(ValueError):
        embed.extract(tiles, "nope")


def test_tables_and_runs(spark, tmp_path):
    root = str(tmp_path)
    rows = spark.createDataFrame([("m", "a", "", 1, 1, 0), ("m", "b", "", 1, 2, 5)], "model string, namespace string, filter_path string, slide_id long, tile_id long, cluster int")
    tables.write(rows, root, "assignments")
    tables.write(rows.where("namespace = 'a'").withColumn("cluster", F.lit(9)), root, "assignments")
    assert {(r["namespace"], r["cluster"]) for r in tables.read_stored(spark, root, "assignments").collect()} == {("a", 9), ("b", 5)}
    assert not tables.done(spark, root, "cluster", "m", "a", "", {"resolution": "1"})
    tables.commit(spark, root, "cluster", "m", "a", "", {"resolution": "1"})
    assert tables.done(spark, root, "cluster", "m", "a", "", {"resolution": "1"}) and not tables.done(spark, root, "cluster", "m", "a", "", {"resolution": "2"})


def test_a_partition_without_rows_goes(spark, tmp_path):
    root, at = str(tmp_path), {"model": "m", "namespace": "a", "filter_path": "1+2/0"}
    rows = spark.createDataFrame([("m", "a", "1+2/0", 1, 1, 0), ("m", "a", "", 1, 1, 3)], "model string, namespace string, filter_path string, slide_id long, tile_id long, cluster int")
    assert tables.write(rows, root, "assignments") == 2
    assert tables.exists(spark, tables.partition_path(spark, root, "assignments", at))
    assert tables.write(rows.where("false"), root, "assignments", at) == 0
    assert [(r["filter_path"], r["cluster"]) for r in tables.read_stored(spark, root, "assignments").collect()] == [("", 3)]
    assert tables.write(rows.where("false"), root, "assignments", at | {"filter_path": ""}) == 0
    assert tables.read_stored(spark, root, "assignments").count() == 0


def test_keys_that_do_not_fit_raise(spark):
    ids = lambda rows: [r["id"] for r in plan.with_ids(spark.createDataFrame(rows, "slide_id long, tile_id long")).collect()]
    assert ids([(0, 1), (1, 0), ((1 << 23) - 1, (1 << 40) - 1)]) == [1, 1 << 40, (1 << 63) - 1]
    for bad in ((0, 1 << 40), (1 << 23, 0), (-1, 0), (0, -1), (None, 0)):
        with pytest.raises(Exception, match="no room for the keys"):
            ids([bad])


def test_scores_with_missing_values(spark):
    rows = spark.createDataFrame([(0, 1.0), (0, 3.0), (1, 5.0), (1, None)], "cluster long, value double")
    assert sorted((r["value"] or -1, r["scaled"]) for r in stats.min_max(rows).collect() if r["value"] is not None) == [(1.0, 0.0), (3.0, 0.5), (5.0, 1.0)]
    by = {r["group"]: r for r in stats.violin(rows.where("value is not null")).collect()}
    assert by["All"]["n"] == 3 and by["All"]["median"] == 3.0 and by["1"]["low"] == 5.0


def test_moments_come_from_one_row_a_dimension_and_partition(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(5, 2, (500, 6))
    x[:, 2] = 7.25
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, features array<double>").repartition(7)
    got = sorted(stats.feature_stats(df).collect())
    assert np.allclose([r["mean"] for r in got], x.mean(0)) and np.allclose([r["std"] for r in got], x.std(0)) and got[2]["std"] == 0
    assert {r["n"] for r in got} == {500}
    assert "Generate" not in stats.feature_stats(df)._jdf.queryExecution().executedPlan().toString()


def test_deep_zoom_tiles_are_made_once_and_never_joined(spark):
    slides = spark.createDataFrame([(1, 5000, 3000), (2, 700, 900)], "slide_id long, width long, height long")
    native = spark.createDataFrame([(s, i, 4.0**i) for s in (1, 2) for i in range(3)], "slide_id long, ordinal int, downsample double")
    tree = geometry.dzi_rects(geometry.dzi_levels(slides, 256), native, 256, 1)._jdf.queryExecution().executedPlan().toString()
    made, join = [m.start() for m in re.finditer("Generate explode", tree)], tree.index("Join")
    assert len(made) == 3 and made[1] < join < made[2] and tree.count("Join") == 1  # the root comes first: rows and columns above the join


def test_numbered_tiles_are_neither_shuffled_nor_sorted(spark):
    tree = geometry_queries.tile_numbering(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    made = tree.index("Generate posexplode")  # the root comes first
    assert all(made < m.start() for m in re.finditer("Exchange|Sort|Window", tree)) and "Window" in tree


@pytest.mark.parametrize("band", [1, 3, 7, 1000])
def test_numbers_run_on_over_bands_of_a_grid(spark, band):
    sizes = [(0, 35, 50), (1, 9, 100), (2, 100, 9), (3, 70, 10), (4, 10, 70), (5, 20, 10), (4, 10, 70)]  # slide 4 twice
    slides = spark.createDataFrame(sizes, "slide_id long, width long, height long")
    got = geometry.numbered_grid(slides, 10, lambda col, row: (col * 7 + row * 13) % 5 != 0, band).collect()
    expected = []
    for slide, width, height in sizes:
        kept = [row * (width // 10) + col for row in range(height // 10) for col in range(width // 10) if (col * 7 + row * 13) % 5]
        expected += [(slide, tile) for tile in kept]
    numbers = {}
    expected = [(slide, tile, numbers.setdefault(slide, itertools.count()).__next__()) for slide, tile in sorted(expected)]
    assert sorted(map(tuple, got)) == expected and len({r["slide_id"] for r in got}) == 4


def test_each_pair_of_blocks_is_one_group(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 5))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, features array<double>")
    near = {(r["i"], r["rank"]): r["j"] for r in knn.knn(df, 4, block_rows=60).collect()}
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    assert near == {(i, r + 1): int(j) for i in range(300) for r, j in enumerate(np.argsort(d[i], kind="stable")[:4])}


def test_a_folder_with_a_status_is_not_run_again(spark, tmp_path):
    done = []
    ask = lambda n, day: spark.createDataFrame([("f1", "uni", f"2024-01-{day}")], "folder string, line string, ts string").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
    for n, day in enumerate(("01", "20")):  # the second is long after the stream has forgotten the first
        ask(n, day)
        requests.watch(spark, f"{tmp_path}/in", f"{tmp_path}/checkpoint{n}", f"{tmp_path}/status", lambda s, folder, p, r: done.append(folder)).awaitTermination()
    assert done == ["f1"] and spark.read.parquet(f"{tmp_path}/status").count() == 1


def test_distributed_communities_of_blobs(spark, blobs):
    found = plan.cluster(spark, plan.Scope(blobs), distributed=True).collect()
    groups = {}
    for r in found:
        groups.setdefault(r["tile_id"] // 60, set()).add(r["cluster"])
    assert len(found) == 180 and all(len(g & h) == 0 for i, g in groups.items() for j, h in groups.items() if i < j)


def test_score_colours(spark):
    got = [one(spark, values.score_colour(F.lit(v).cast("double"))) for v in (0.0, 0.5, 1.0, float("nan"))]
    assert got == ["#000080", "#7dff7a", "#800000", None]


def test_watcher(spark, tmp_path):
    lines = [("f1", "uni2, rotate", "2024-01-01"), ("f1", "uni", "2024-01-02"), ("f2", "DONE", "2024-01-01"), ("f3", "", "2024-01-01"), ("f4", "bad", "2024-01-01")]
    spark.createDataFrame(lines, "folder string, line string, ts string").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.json(f"{tmp_path}/in")
    done = []

    def job(session, folder, preset, rotate):
        if preset == "bad":
            raise RuntimeError("no such preset")
        done.append((folder, rotate))

    for _ in range(2):  # the second run finds nothing new
        requests.watch(spark, f"{tmp_path}/in", f"{tmp_path}/checkpoint", f"{tmp_path}/status", job).awaitTermination()
    status = {r["folder"]: r["status"] for r in spark.read.parquet(f"{tmp_path}/status").collect()}
    assert [f for f, _ in done] == ["f1"] and status["f1"] == "DONE" and status["f4"].startswith("ERROR")


def test_sizes_and_devices(spark):
    assert [one(spark, values.byte_size(F.lit(n).cast("long"))) for n in (0, 5, 2048, 3 << 20, 5 << 30)] == ["", "5 B", "2 KB", "3 MB", "5 GB"]
    assert one(spark, values.device_list(F.lit("cuda:0, 7"), 1)) == ["cuda:0"] and one(spark, values.device_list(F.lit("auto"), 0)) == ["cpu"]


def test_coarse_labels(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    edges = spark.createDataFrame([(a, b, 1.0) for a in range(4) for b in range(a + 1, 4)] + [(a, b, 1.0) for a in range(4, 8) for b in range(a + 1, 8)], "src long, dst long, weight double")
    got = {r["node"]: r["community"] for r in plan.label_rounds(edges, spark.range(8).withColumnRenamed("id", "node")).collect()}
    assert {got[i] for i in range(4)} == {0} and {got[i] for i in range(4, 8)} == {4}
