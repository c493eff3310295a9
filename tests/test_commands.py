"""The commands from a slide file to previews, over a store in a temporary folder."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilescape import cli
from tilescape.config import PALETTE, EngineConfig
from tilescape.functions import blank, png, values
from tilescape.plans import analysis, commands, folders
from tilescape.sources import images, tiff


@pytest.fixture(scope="module")
def slide(tmp_path_factory):
    """6 x 4 tiles of 64 pixels in three kinds of texture, one row blank."""
    rng = np.random.default_rng(0)
    image = np.full((256, 384, 3), 250, np.uint8)
    for row in range(3):
        for col in range(6):
            tile = rng.integers(0, 80, (64, 64, 3)) + np.array([[180, 20, 20], [20, 160, 40], [40, 20, 170]])[(row * 6 + col) % 3]
            image[row * 64 : row * 64 + 64, col * 64 : col * 64 + 64] = np.minimum(tile, 255)
    path = str(tmp_path_factory.mktemp("slide") / "s.tif")
    tiff.write_tiff(path, [image, image[::2, ::2]], mpp=0.5)
    return path, image


def test_store(spark, slide, tmp_path):
    path, image = slide
    root = str(tmp_path / "store")
    store = commands.Store(spark, root, EngineConfig(patch_size=64, target_mpp=0.5))
    cached = store.cache(1, path, detector=("ptp", None))
    assert (cached.rows, cached.details["total"], cached.details["level"]) == (18, 24, 0)
    assert store.cache(1, path, detector=("ptp", None)).skipped
    small = lambda: lambda x: x.mean((2, 3))
    assert store.extract(1, "m", preset="uni2", factory=small).rows == 18
    assert store.extract(2, "m", preset="uni2", path=path, factory=small, detector=("std", None)).details["source"] == "slide"
    with pytest.raises(FileNotFoundError):
        store.extract(3, "m")
    found = store.cluster("m", [1], resolution=0.5)
    assert found.rows == 18 and not found.skipped and store.cluster("m", [1], resolution=0.5).skipped and not store.cluster("m", [1], resolution=0.6).skipped
    both = store.cluster("m", [1, 2])
    assert both.target == "m/1+2/clusters" and both.rows == 36
    sub = store.cluster("m", [1], ids=(0,))
    assert sub.target == "m/default/0/clusters" and 0 < sub.rows < 18
    with pytest.raises(ValueError):
        store.cluster("m", [1], parent="9", ids=(0,))
    with pytest.raises(ValueError):
        store.cluster("m", [1], namespace="a+b")
    dense = store.dense_clusters("m", "default", "0")
    assert dense.count() == 36 and dense.where("cluster >= 0").count() == sub.rows
    assert store.scores("m", [1], n_components=2).rows == 18 and store.scores("m", [1], kind="umap").target == "m/default/umap"
    assert store.aggregate("m").rows == 2 and store.show().count() == 3
    out = str(tmp_path / "p.png")
    assert store.preview(1, "m", out, size=16).rows == 18 and store.preview(1, "m", out, size=16, rotate=True).rows == 18
    with open(out, "rb") as f:
        assert f.read(8) == b"\x89PNG\r\n\x1a\n"


def decoded(path):
    """Pixels of a PNG without filters."""
    raw, at, data = path.read_bytes(), 8, b""
    while at < len(raw):
        n, kind = struct.unpack(">I4s", raw[at : at + 8])
        body = raw[at + 8 : at + 8 + n]
        assert struct.unpack(">I", raw[at + 8 + n : at + 12 + n])[0] == zlib.crc32(kind + body)
        if kind == b"IHDR":
            width, height = struct.unpack(">II", body[:8])
        data += body if kind == b"IDAT" else b""
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(data), np.uint8).reshape(height, 1 + width * 3)
    assert not rows[:, 0].any()
    return rows[:, 1:].reshape(height, width, 3)


@pytest.fixture(scope="module")
def store(spark, slide, tmp_path_factory):
    """A store with one slide cached, features with token vectors of two models, and clusters."""
    made = commands.Store(spark, str(tmp_path_factory.mktemp("store")), EngineConfig(patch_size=64, target_mpp=0.5))
    made.cache(1, slide[0], detector=("ptp", None))

    def factory():
        return lambda x: (x.mean((2, 3)), x[:, :, ::32, ::32].reshape(len(x), 3, 4).transpose(0, 2, 1))

    norm = ((0.5, 0.5, 0.5), (0.25, 0.25, 0.25))
    for model in ("m", "other"):
        made.extract(1, model, preset="mine", factory=factory, norm=norm, latent=True, batch_size=5)
    return made


def test_presets_and_token_vectors_of_ones_own(spark, store):
    latent = store.table("latent_features").where("model = 'm'")
    assert latent.count() == 18 and latent.where(F.size("tokens") == 4).count() == 18
    with pytest.raises(ValueError, match="factory and a norm"):
        store.extract(1, "x", preset="mine")
    with pytest.raises(Exception, match="gives no token vectors"):
        store.extract(1, "x", preset="uni2", latent=True)


def test_models_keep_their_slide_embeddings(store):
    assert store.aggregate("m").rows == 1 and store.aggregate("other").rows == 1
    assert {r["tile_model"] for r in store.table("slide_embeddings").collect()} == {"m", "other"}
    assert store.aggregate("m").skipped and store.aggregate("m", overwrite=True).rows == 1 and store.table("slide_embeddings").count() == 2


def test_an_overwrite_leaves_nothing_of_the_run_before(spark, slide, tmp_path):
    path, _ = slide
    store = commands.Store(spark, str(tmp_path), EngineConfig(patch_size=64, target_mpp=0.5))
    assert store.cache(1, path).rows == 24
    assert store.cache(1, path, detector=lambda px: bool(px.mean() > 200), overwrite=True).rows == 18
    assert store.table("slides").count() == 1 and store.table("slides").first()["patch_count"] == 18
    assert store.cache(1, path, detector=lambda px: True, overwrite=True).rows == 0
    assert store.table("tiles").count() == 0 and store.table("slides").first()["patch_count"] == 0


def test_layout_and_clusters_together(store):
    seen = []
    placed, found = store.cluster_with_layout("m", [1], on_progress=lambda step, result: seen.append((step, result.rows)), namespace="both")
    assert placed.target == "m/both/umap" and found.target == "m/both/clusters" and seen == [("umap", 18), ("clusters", 18)]
    again = store.cluster_with_layout("m", [1], namespace="both")
    assert again[0].skipped and again[1].skipped


def test_previews(spark, store, slide, tmp_path):
    _, image = slide
    store.cluster("m", [1])
    store.scores("m", [1], n_components=2)
    out = tmp_path / "a.png"
    assert store.preview(1, "m", str(out), size=16).rows == 18
    canvas = decoded(out)
    assert canvas.shape == (64, 96, 3) and not canvas[48:].any()
    assert (canvas[11, 11] == png.scaled(image[:64, :64], 16, 16)[11, 11]).all()
    store.preview(1, "m", str(out), size=16, rotate=True)
    turned = decoded(out)
    assert not turned[:16].any() and (turned[-12, -12] == canvas[11, 11]).all()
    assert store.preview_scores(1, "m", "pca2", str(out), size=16, invert=True).rows == 18
    first = store.table("scores").where("name = 'pca2'").orderBy("tile_id").first()["values"][0]
    colour = spark.range(1).select(values.score_colour(F.lit(1 - first))).first()[0]
    assert "#" + decoded(out)[0, 0].tobytes().hex() == colour
    with pytest.raises(ValueError, match="no scores"):
        store.preview_scores(1, "m", "pca9", str(out))
    assert store.preview_latent(1, "m", str(out), size=16, alpha=1.0).rows == 18
    rgb = analysis.latent_rgb(store.table("latent_features").where("model = 'm'")).where("tile_id = 0").orderBy("token").collect()
    covered = decoded(out)
    assert [tuple(covered[y, x]) for y in (0, 8) for x in (0, 8)] == [(r["r"], r["g"], r["b"]) for r in rgb]
    tokens = spark.createDataFrame([(1, 0, t, t) for t in range(4)], "slide_id long, tile_id long, token int, cluster long")
    store.preview_latent(1, "m", str(out), clusters=tokens, size=16, alpha=1.0)
    assert "#" + decoded(out)[0, 0].tobytes().hex() == PALETTE[0] and "#" + decoded(out)[8, 8].tobytes().hex() == PALETTE[3]


def test_namespaces_are_renamed_and_removed_in_the_store(spark, store):
    store.cluster("m", [1], namespace="old")
    store.cluster("m", [1], namespace="old", ids=(0,))
    store.cluster("m", [1], namespace="taken")
    with pytest.raises(ValueError, match="taken"):
        store.rename("old", "taken")
    with pytest.raises(ValueError, match="no namespace"):
        store.rename("nowhere", "new")
    with pytest.raises(ValueError, match="reserved"):
        store.rename("old", "features")
    before = store.table("assignments").where("namespace = 'old'").count()
    assert store.rename("old", "new").rows == 1
    assert store.table("assignments").where("namespace = 'new'").count() == before and store.table("assignments").where("namespace = 'old'").count() == 0
    assert store.cluster("m", [1], namespace="new").skipped and not store.cluster("m", [1], namespace="old").skipped
    assert store.remove("new", "m").rows == 1 and store.table("assignments").where("namespace = 'new'").count() == 0
    assert not store.cluster("m", [1], namespace="new").skipped


def test_old_metadata_is_taken_over_once(spark, store):
    old = spark.createDataFrame([(1, 64, 0.5, None, 6, 4, 24), (90, 256, None, 1, 3, 2, 6)], "slide_id long, patch_size int, mpp double, image_level int, cols int, rows int, patch_count long")
    assert store.migrate(old).rows == 1 and store.migrate(old).rows == 0
    assert store.table("slides").where("slide_id = 90").first()["patch_count"] == 6 and store.table("slides").where("slide_id = 1").first()["patch_count"] == 18


def test_plain_images_are_cached_with_a_resolution(spark, tmp_path):
    image = np.random.default_rng(1).integers(0, 255, (130, 200, 3), dtype=np.uint8)
    (tmp_path / "a.png").write_bytes(png.encode(image))
    store = commands.Store(spark, str(tmp_path / "s"), EngineConfig(patch_size=64, target_mpp=0.5))
    with pytest.raises(ValueError, match="no resolution"):
        store.cache(1, str(tmp_path / "a.png"))
    assert store.cache(1, str(tmp_path / "a.png"), mpp=0.5).rows == 6
    for r in store.table("tiles").collect():
        assert (np.frombuffer(r["rgb"], np.uint8).reshape(64, 64, 3) == image[r["y"] : r["y"] + 64, r["x"] : r["x"] + 64]).all()


def test_a_cache_of_another_resolution_is_not_used(spark, slide, tmp_path):
    path, _ = slide
    store = commands.Store(spark, str(tmp_path), EngineConfig(patch_size=64, target_mpp=1.0))
    store.cache(1, path)
    near = images.tile_source(spark, str(tmp_path), 1, 64, 1.05, path)[1]
    far = images.tile_source(spark, str(tmp_path), 1, 64, 0.5, path)[1]
    assert (near, far) == ("cache", "slide")


def test_paths_are_resolved(spark, tmp_path):
    for name in ("a.h5", "a.svs", "a.ndpi", "b.tif", "c.ome.tiff"):
        (tmp_path / name).touch()
    at = lambda name: str(tmp_path / name)
    assert images.sibling(spark, at("a.h5")) == at("a.ndpi") and images.sibling(spark, at("c.h5")) == at("c.ome.tiff") and images.sibling(spark, at("z.h5")) is None
    assert images.resolved(spark, at("a.h5")) == at("a.h5") and images.resolved(spark, at("a.svs")) == at("a.h5")
    with pytest.raises(FileNotFoundError):
        images.resolved(spark, at("b.tif"))
    with pytest.raises(ValueError):
        images.resolved(spark, at("b.jpg"))


def test_the_job_of_a_folder(spark, slide, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "s.tif").write_bytes(open(slide[0], "rb").read())  # noqa: SIM115
    (tmp_path / "in" / "note.txt").write_text("no slide")
    store, steps = commands.Store(spark, str(tmp_path / "store"), EngineConfig(patch_size=64, target_mpp=0.5)), []
    folders.folder_job(store, on_step=lambda path, step: steps.append(step))(spark, str(tmp_path / "in"), "uni2", False)
    assert steps == ["cache", "extract", "cluster", "umap", "preview", "thumbnail"]
    assert (tmp_path / "in" / "s_preview.png").exists() and (tmp_path / "in" / "s_thumb.png").exists()


def test_benchmark_rows_and_file(spark, slide, tmp_path):
    rows = commands.benchmark(spark, [slide[0]], str(tmp_path / "csv"), iterations=2, tile_size=128).collect()
    assert [r["iteration"] for r in rows] == [1, 2] and all(r["tiles_per_sec"] == pytest.approx(r["total_tiles"] / r["elapsed_sec"]) for r in rows)
    back = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert back.columns == [c.split()[0] for c in commands.BENCHMARK.split(", ")] and back.count() == 2


def test_strips_in_a_row_are_one_image(tmp_path):
    image = np.random.default_rng(5).integers(0, 255, (40, 30, 3), dtype=np.uint8)
    with open(tmp_path / "x.png", "wb") as f:
        png.write_strips(f, 30, 40, (png.strip(image[i : i + 10]) for i in range(0, 40, 10)))
    assert (decoded(tmp_path / "x.png") == image).all()


def test_deep_zoom_and_thumbnail(spark, slide, tmp_path):
    path, _ = slide
    made = commands.deep_zoom(spark, path, str(tmp_path), tile_size=128, overlap=1)
    files = list((tmp_path / "slide_files").rglob("*.png"))
    assert len(files) == made.rows and made.details["max_level"] == 9 and (tmp_path / "slide.dzi").exists()
    assert commands.thumbnail(path, str(tmp_path / "t.png"), width=96).details == {"width": 96, "height": 64}
    with pytest.raises(ValueError):
        commands.thumbnail(path, str(tmp_path / "t.png"))


def test_plain_images(spark, tmp_path):
    image = np.random.default_rng(1).integers(0, 255, (10, 12, 3), dtype=np.uint8)
    (tmp_path / "a.png").write_bytes(png.encode(image))
    r = images.plain_images(spark, str(tmp_path)).first()
    assert (np.frombuffer(r["rgb"], np.uint8).reshape(10, 12, 3) == image).all()


def test_pixel_detectors_match_the_expressions(spark):
    rng = np.random.default_rng(2)
    rows = [rng.integers(low, 256, (4, 5, 3)) for low in (0, 150, 235, 245) for _ in range(4)]
    df = spark.createDataFrame([(i, [tuple(int(v) for v in p) for p in r.reshape(-1, 3)]) for i, r in enumerate(rows)], "id int, pixels array<struct<r:int,g:int,b:int>>")
    for method in ("ptp", "std", "green", "otsu"):
        got = {r["id"]: r["b"] for r in df.select("id", blank.detector(method)(F.col("pixels")).alias("b")).collect()}
        assert got == {i: blank.pixel_detector(method)(r.astype(np.uint8)) for i, r in enumerate(rows)}
    with pytest.raises(ValueError):
        blank.pixel_detector("nope")


def test_command_line(spark, slide, tmp_path):
    path, _ = slide
    root = str(tmp_path / "store")
    base = [root, "--patch-size", "64"]
    assert cli.run([*base, "cache", "7", path, "--detect-white", "ptp", "0.9"], spark).rows == 18
    assert cli.run([*base, "extract", "7"], spark).rows == 18
    assert cli.run([*base, "cluster", "7", "--resolution", "0.5"], spark).rows == 18
    assert cli.run([*base, "pca", "7", "-n", "1"], spark).target == "uni2/default/pca1"
    assert cli.run([*base, "show"], spark).count() == 1
    assert cli.run([*base, "thumb", path, str(tmp_path / "x.png"), "--width", "30"], spark).rows == 1


def test_slide_info_stops_at_a_jump(tmp_path):
    base = np.zeros((1600, 1600, 3), np.uint8)
    path = str(tmp_path / "a.tif")
    tiff.write_tiff(path, [base, base[:50, :50], base[::2, ::2], base[::8, ::8]], mpp=0.25)
    info = images.slide_info(path)
    assert [lv[0] for lv in info.levels] == [0, 2] and info.level_for(0.5) == 1 and info.level_for_downsample(1.4) == 0
