"""Commands over a store (a folder of tables): cache, extract, aggregate, cluster, scores, layout, preview, deep zoom.

Each is stateless, records its run, and does nothing if the same run with the same parameters has been committed.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilescape.config import SLIDE_PRESETS, EngineConfig
from tilescape.functions import blank, png, values
from tilescape.operators import catalog, embed, scope
from tilescape.plans import analysis
from tilescape.schema import PARTITIONS, SLIDES
from tilescape.sources import images, tables, tiff

#: A blank detector's name and threshold, or a function of a tile's pixels [H, W, 3].
Detector = tuple[str, float | None] | Callable[[np.ndarray], bool] | None


@dataclass(frozen=True)
class Result:
    kind: str
    target: str
    rows: int = 0
    elapsed: float = 0.0
    skipped: bool = False
    details: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Store:
    spark: SparkSession
    root: str
    config: EngineConfig = EngineConfig()

    def table(self, name: str) -> DataFrame:
        return tables.read_stored(self.spark, self.root, name)

    def _run(self, kind: str, model: str, namespace: str, filter_path: str, params: dict, overwrite: bool, work: Callable[[], tuple[int, dict]]) -> Result:
        params = {k: str(v) for k, v in params.items()}
        target = "/".join(x for x in (model, namespace, filter_path, kind) if x)
        if not overwrite and tables.done(self.spark, self.root, kind, model, namespace, filter_path, params):
            return Result(kind, target, skipped=True)
        began = time.time()
        rows, details = work()
        tables.commit(self.spark, self.root, kind, model, namespace, filter_path, params)
        return Result(kind, target, rows, time.time() - began, False, details)

    def cache(self, slide_id: int, path: str, *, mpp: float | None = None, detector: Detector = None, overwrite: bool = False) -> Result:
        """Store a slide's tiles at the level nearest to the target resolution, without blank ones."""
        size = self.config.patch_size

        def work() -> tuple[int, dict]:
            tiles, info, level = images.open_slide(self.spark, path, size, self.config.target_mpp, mpp)
            _, width, height, down = info.levels[level]
            tiles = drop_blank(tiles, detector) if detector else tiles
            out = tiles.select(F.lit(slide_id).cast("long").alias("slide_id"), F.lit(size).alias("patch_size"), "tile_id", "x", "y", "height", "width", "channels", "rgb")
            at = {"patch_size": size, "slide_id": slide_id}
            kept = tables.write(out, self.root, "tiles", at)
            row = (slide_id, size, path, info.mpp, *info.size, info.mpp * down, width // size, height // size, kept)
            tables.write(self.spark.createDataFrame([row], SLIDES), self.root, "slides", at)
            return kept, {"level": level, "mpp": info.mpp * down, "cols": width // size, "rows": height // size, "total": (width // size) * (height // size)}

        return self._run("cache", "", str(slide_id), "", {"path": path, "size": size, "mpp": self.config.target_mpp, "detector": _name(detector)}, overwrite, work)

    def extract(self, slide_id: int, model: str, *, preset: str | None = None, path: str | None = None, mpp: float | None = None, factory: Callable | None = None, norm: embed.Norm | None = None, latent: bool = False, batch_size: int = 64, detector: Detector = None, overwrite: bool = False) -> Result:
        """Features of a slide's tiles, from the cache or else from the slide file; with ``latent`` their token vectors too."""
        preset = preset or self.config.default_preset

        def work() -> tuple[int, dict]:
            tiles, source = images.tile_source(self.spark, self.root, slide_id, self.config.patch_size, self.config.target_mpp, path, mpp)
            tiles = drop_blank(tiles, detector) if detector and source == "slide" else tiles
            found = embed.extract(tiles, preset, factory, norm=norm, latent=latent, batch_size=batch_size).withColumn("model", F.lit(model))
            at = {"model": model, "slide_id": slide_id}
            if latent:  # the model runs once: what it gave is written, then parted
                staged = tables.shared_folder(self.spark, "extract")
                found.write.parquet(staged)
                found = self.spark.read.schema(found.schema).parquet(staged)
                tables.write(found.select("slide_id", "model", "tile_id", "tokens"), self.root, "latent_features", at)
            n = tables.write(found.select("slide_id", "model", "tile_id", "x", "y", "features"), self.root, "tile_features", at)
            if latent:
                tables.delete(self.spark, staged)
            return n, {"source": source, "preset": preset}

        return self._run("features", model, str(slide_id), "", {"preset": preset, "size": self.config.patch_size, "latent": latent}, overwrite, work)

    def features(self, model: str, slide_ids: list[int] | None = None) -> DataFrame:
        rows = self.table("tile_features").where(F.col("model") == model)
        return rows if slide_ids is None else rows.where(F.col("slide_id").isin(slide_ids))

    def aggregate(self, model: str, slide_preset: str = "titan", *, set_model: Callable | None = None, overwrite: bool = False) -> Result:
        """One vector a slide; the mean of its tiles unless a set model is given."""
        if slide_preset not in SLIDE_PRESETS:
            raise ValueError(f"unknown slide preset {slide_preset!r}; one of {sorted(SLIDE_PRESETS)}")

        def work() -> tuple[int, dict]:
            rows = self.features(model)
            pooled = embed.aggregate(rows, set_model) if set_model else embed.mean_pool(rows).select("slide_id", "feature")
            out = pooled.select("slide_id", F.lit(model).alias("tile_model"), F.lit(slide_preset).alias("slide_preset"), "feature")
            return tables.write(out, self.root, "slide_embeddings", {"tile_model": model, "slide_preset": slide_preset}), {}

        return self._run("aggregate", model, slide_preset, "", {"set_model": set_model is not None}, overwrite, work)

    def _scope(self, model: str, slide_ids: list[int], namespace: str | None, parent: str, ids: tuple[int, ...]) -> tuple[analysis.Scope, str]:
        name = catalog.check_namespace(namespace, user=True) if namespace else ("default" if len(slide_ids) == 1 else "+".join(map(str, sorted(slide_ids))))
        assigned = None
        if ids:
            assigned = self.table("assignments").where((F.col("model") == model) & (F.col("namespace") == name))
            if assigned.where(F.col("filter_path") == parent).limit(1).isEmpty():
                raise ValueError(f"no clusters at {model}/{name}/{parent}")
        return analysis.Scope(self.features(model, slide_ids), assigned, parent, tuple(ids)), name

    def cluster(self, model: str, slide_ids: list[int], *, namespace: str | None = None, parent: str = "", ids: tuple[int, ...] = (), resolution: float | None = None, sort_clusters: bool = True, distributed: bool = False, overwrite: bool = False) -> Result:
        what, name = self._scope(model, slide_ids, namespace, parent, ids)
        config = replace(self.config, resolution=self.config.resolution if resolution is None else resolution)

        def work() -> tuple[int, dict]:
            found = analysis.cluster(self.spark, what, config, sort_clusters, distributed).select(F.lit(model).alias("model"), F.lit(name).alias("namespace"), F.lit(what.filter_path).alias("filter_path"), "slide_id", "tile_id", "cluster")
            tables.write(found, self.root, "assignments", {"model": model, "namespace": name, "filter_path": what.filter_path})
            mine = self.table("assignments").where((F.col("model") == model) & (F.col("namespace") == name) & (F.col("filter_path") == what.filter_path))
            n = mine.agg(F.count("*").alias("n"), F.countDistinct("cluster").alias("c")).first()
            return n["n"], {"clusters": n["c"]}

        return self._run("clusters", model, name, what.filter_path, {"resolution": config.resolution, "sort": sort_clusters, "distributed": distributed, "slides": sorted(slide_ids)}, overwrite, work)

    def scores(self, model: str, slide_ids: list[int], *, kind: str = "pca", namespace: str | None = None, parent: str = "", ids: tuple[int, ...] = (), n_components: int = 2, scaler: str = "minmax", overwrite: bool = False) -> Result:
        """Component scores (kind pca) or a layout (kind umap), stored by name, such as pca2 or umap."""
        what, name = self._scope(model, slide_ids, namespace, parent, ids)
        label = f"pca{n_components}" if kind == "pca" else "umap"

        def work() -> tuple[int, dict]:
            found = analysis.component_scores(what, n_components, scaler) if kind == "pca" else analysis.layout(what, self.config, n_components)
            keyed = found.select(F.lit(model).alias("model"), F.lit(name).alias("namespace"), F.lit(what.filter_path).alias("filter_path"), F.lit(label).alias("name"), "slide_id", "tile_id", "values")
            at = {"model": model, "namespace": name, "filter_path": what.filter_path, "name": label}
            return tables.write(keyed, self.root, "scores", at), {"components": n_components}

        return self._run(label, model, name, what.filter_path, {"scaler": scaler, "n": n_components, "slides": sorted(slide_ids)}, overwrite, work)

    def cluster_with_layout(self, model: str, slide_ids: list[int], *, on_progress: Callable[[str, Result], None] | None = None, resolution: float | None = None, **scope_options) -> tuple[Result, Result]:
        """A layout, then clusters of the same scope; clusters come from the features, not from the layout."""
        placed = self.scores(model, slide_ids, kind="umap", **scope_options)
        if on_progress:
            on_progress("umap", placed)
        found = self.cluster(model, slide_ids, resolution=resolution, **scope_options)
        if on_progress:
            on_progress("clusters", found)
        return placed, found

    def _namespaced(self) -> list[tuple[str, str]]:
        """(table, model) of the stored tables with namespaces."""
        found = []
        for table in ("assignments", "scores"):
            if tables.exists(self.spark, f"{self.root}/{table}"):
                found += [(table, r["model"]) for r in self.table(table).select("model").distinct().collect()]
        return found

    def rename(self, old: str, new: str, model: str | None = None) -> Result:
        """Rename a namespace in one model or all. Everything is checked before anything moves; rows stay where they are
        in their files, as a namespace is a folder."""
        catalog.check_namespace(new)
        path = lambda t, m, n: tables.partition_path(self.spark, self.root, t, {"model": m, "namespace": n})
        mine = [(t, m) for t, m in self._namespaced() if model in (None, m)]
        moves = [(path(t, m, old), path(t, m, new)) for t, m in mine if tables.exists(self.spark, path(t, m, old))]
        if not moves:
            raise ValueError(f"no namespace {old!r}")
        if any(tables.exists(self.spark, target) for _, target in moves):
            raise ValueError(f"namespace {new!r} is taken")
        for source, target in moves:
            tables.move(self.spark, source, target)
        chosen = F.lit(True) if model is None else F.col("model") == model
        tables.change_runs(self.spark, self.root, lambda runs: catalog.with_namespace(runs, old, new, chosen & ~F.col("kind").isin("cache", "features", "aggregate")))
        return Result("rename", new, len(moves))

    def remove(self, namespace: str, model: str | None = None) -> Result:
        """Remove a namespace and all that was filtered from it, in one model or all."""
        catalog.check_namespace(namespace)
        gone = [p for t, m in self._namespaced() if model in (None, m) and tables.exists(self.spark, p := tables.partition_path(self.spark, self.root, t, {"model": m, "namespace": namespace}))]
        for p in gone:
            tables.delete(self.spark, p)
        chosen = F.lit(True) if model is None else F.col("model") == model
        tables.change_runs(self.spark, self.root, lambda runs: runs.where(~((F.col("namespace") == namespace) & chosen & ~F.col("kind").isin("cache", "features", "aggregate"))))
        return Result("remove", namespace, len(gone))

    def migrate(self, old: DataFrame) -> Result:
        """Take over slides recorded in the old layout (slide_id, patch_size, mpp, image_level, cols, rows, patch_count and,
        if known, original sizes); those already there stay as they are."""
        new = catalog.migrated(old).withColumn("path", F.lit(None).cast("string"))
        for c in ("original_mpp", "original_width", "original_height"):
            new = new.join(old.select("slide_id", c), "slide_id") if c in old.columns else new.withColumn(c, F.lit(None).cast("double" if c.endswith("mpp") else "long"))
        types = dict(x.split(" ") for x in SLIDES.split(", "))
        new = new.select(*[F.col(c).cast(k).alias(c) for c, k in types.items()])
        if tables.exists(self.spark, f"{self.root}/slides"):
            new = new.join(self.table("slides").select("slide_id", "patch_size"), ["slide_id", "patch_size"], "left_anti")
        n = new.count()
        if n:
            new.write.mode("append").partitionBy(*PARTITIONS["slides"]).parquet(f"{self.root}/slides")
        return Result("migrate", "slides", n)

    def dense_clusters(self, model: str, namespace: str, filter_path: str = "") -> DataFrame:
        """Every tile with its cluster, -1 outside of the scope."""
        mine = self.table("assignments").where((F.col("model") == model) & (F.col("namespace") == namespace) & (F.col("filter_path") == filter_path))
        return scope.dense(self.features(model).select("slide_id", "tile_id", "x", "y"), mine, "cluster", -1)

    def show(self) -> DataFrame:
        """What is stored: rows and clusters by model, namespace and filter path, for all models there are."""
        rows = self.table("assignments")
        return rows.groupBy("model", "namespace", "filter_path").agg(F.count("*").alias("tiles"), F.countDistinct("cluster").alias("clusters"), F.countDistinct("slide_id").alias("slides")).orderBy("model", "namespace", "filter_path")

    def _canvas(self, slide_id: int, path: str | None = None) -> tuple[DataFrame, int, int]:
        """Tiles of a slide with pixels, and the columns and rows of its canvas: from the cache, or else the places of its
        features with pixels read from the slide file."""
        tiles, source = images.tile_source(self.spark, self.root, slide_id, self.config.patch_size, self.config.target_mpp, path)
        if source == "cache":
            meta = self.table("slides").where((F.col("slide_id") == slide_id) & (F.col("patch_size") == self.config.patch_size)).first()
            return tiles, meta["cols"], meta["rows"]
        info = images.slide_info(path)
        _, width, height, _ = info.levels[info.level_for(self.config.target_mpp)]
        return tiles, width // self.config.patch_size, height // self.config.patch_size

    def _draw(self, tiles: DataFrame, cols: int, rows: int, out: str, size: int, rotate: bool) -> int:
        """A PNG of tiles (x, y, height, width, channels, rgb and frame #rrggbb, label, overlay [l * l * 3 bytes], alpha; each may
        be null). A row of tiles is drawn and deflated by a task; the driver puts the strips in a row, one at a time."""
        patch = self.config.patch_size
        row = F.floor(F.col("y") / patch).cast("int")
        blank_rows = self.spark.range(rows).select(F.col("id").cast("int").alias("strip"))
        placed = tiles.withColumn("strip", (rows - 1 - row) if rotate else row).withColumn("col", F.floor(F.col("x") / patch).cast("int"))
        strips = blank_rows.join(placed, "strip", "left").groupBy("strip").applyInPandas(_strip(cols, size, rotate), "strip int, data binary, adler long, length long, n int")
        n = 0

        def parts():
            nonlocal n
            for r in strips.orderBy("strip").toLocalIterator():
                n += r["n"]
                yield bytes(r["data"]), r["adler"], r["length"]

        with open(out, "wb") as f:
            png.write_strips(f, cols * size, rows * size, parts())
        return n

    def preview(self, slide_id: int, model: str, out: str, *, namespace: str = "default", filter_path: str = "", size: int = 64, rotate: bool = False, path: str | None = None) -> Result:
        """A PNG of the slide's tiles with frames and numbers in their clusters' colours."""
        tiles, cols, rows = self._canvas(slide_id, path)
        mine = self.dense_clusters(model, namespace, filter_path).select("slide_id", "tile_id", F.when(F.col("cluster") >= 0, F.col("cluster")).alias("c"))
        framed = tiles.join(mine, ["slide_id", "tile_id"], "left")
        framed = framed.withColumn("frame", values.cluster_colour(F.col("c"))).withColumn("label", F.col("c").cast("string"))
        return Result("preview", out, self._draw(_plain(framed), cols, rows, out, size, rotate))

    def preview_scores(self, slide_id: int, model: str, name: str, out: str, *, namespace: str = "default", filter_path: str = "", invert: bool = False, size: int = 64, rotate: bool = False, path: str | None = None) -> Result:
        """A PNG with frames and numbers by a score's first component; tiles without a score have none."""
        found = self.table("scores").where((F.col("model") == model) & (F.col("namespace") == namespace) & (F.col("filter_path") == filter_path) & (F.col("name") == name) & (F.col("slide_id") == slide_id))
        if found.limit(1).isEmpty():
            raise ValueError(f"no scores {model}/{namespace}/{filter_path}/{name} of slide {slide_id}")
        first = F.col("values")[0]
        scores = found.select("slide_id", "tile_id", (1 - first if invert else first).alias("s"))
        tiles, cols, rows = self._canvas(slide_id, path)
        framed = tiles.join(scores, ["slide_id", "tile_id"], "left").withColumn("frame", values.score_colour(F.col("s")))
        framed = framed.withColumn("label", F.when(F.col("frame").isNotNull(), F.format_string("%.3f", values.quantised_score(F.col("s")))))
        return Result("preview-score", out, self._draw(_plain(framed), cols, rows, out, size, rotate))

    def preview_latent(self, slide_id: int, model: str, out: str, *, clusters: DataFrame | None = None, alpha: float = 0.5, size: int = 64, rotate: bool = False, path: str | None = None) -> Result:
        """A PNG with an overlay of the tiles' token vectors: their three leading components as colours, or the colours of
        ``clusters`` (slide_id, tile_id, token, cluster)."""
        if clusters is None:
            latent = self.table("latent_features").where((F.col("model") == model) & (F.col("slide_id") == slide_id))
            dots = analysis.latent_rgb(latent).select("slide_id", "tile_id", "token", "r", "g", "b")
        else:
            colour = values.cluster_colour(F.col("cluster"))
            dots = clusters.where(F.col("slide_id") == slide_id).select("slide_id", "tile_id", "token", *[F.round(values.channel(colour, i) * 255).cast("int").alias(c) for i, c in enumerate("rgb")])
        packed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("token", "r", "g", "b"))), lambda t: F.concat(*[F.lpad(F.hex(t[c].cast("long")), 2, "0") for c in "rgb"])), "")
        overlays = dots.groupBy("slide_id", "tile_id").agg(F.unhex(packed).alias("overlay"))
        tiles, cols, rows = self._canvas(slide_id, path)
        covered = tiles.join(overlays, ["slide_id", "tile_id"], "left").withColumn("alpha", F.lit(float(int(alpha * 255)) / 255))
        return Result("preview-latent", out, self._draw(_plain(covered), cols, rows, out, size, rotate))


def _name(detector: Detector) -> str:
    return getattr(detector, "__qualname__", None) or str(detector)


def _plain(tiles: DataFrame) -> DataFrame:
    """The columns that a canvas is drawn from."""
    kinds = {"frame": "string", "label": "string", "overlay": "binary", "alpha": "double"}
    more = [(F.col(c) if c in tiles.columns else F.lit(None).cast(k)).alias(c) for c, k in kinds.items()]
    return tiles.select("x", "y", "height", "width", "channels", "rgb", *more)


def _strip(cols: int, size: int, rotate: bool):
    import pandas as pd

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        canvas, n = np.zeros((size, cols * size, 3), np.uint8), 0
        for r in rows[rows["rgb"].notna()].itertuples():
            shape = (int(r.height), int(r.width), int(r.channels))
            tile = png.scaled(np.frombuffer(r.rgb, np.uint8).reshape(shape)[:, :, :3], size, size)
            if rotate:
                tile = tile[::-1, ::-1]
            if isinstance(r.overlay, bytes | bytearray):
                side = int(round((len(r.overlay) // 3) ** 0.5))
                cover = png.scaled(np.frombuffer(r.overlay, np.uint8).reshape(side, side, 3), size, size)
                tile = np.rint(tile * (1 - r.alpha) + (cover[::-1, ::-1] if rotate else cover) * r.alpha).astype(np.uint8)
            if isinstance(r.frame, str):
                tile = png.labelled(png.framed(tile, r.frame), r.label or "", r.frame)
            x = (cols - 1 - int(r.col) if rotate else int(r.col)) * size
            canvas[:, x : x + size] = tile
            n += 1
        data, adler, length = png.strip(canvas)
        return pd.DataFrame({"strip": rows["strip"].iloc[:1], "data": [data], "adler": [adler], "length": [length], "n": [n]})

    return run


def drop_blank(tiles: DataFrame, detector: Detector) -> DataFrame:
    """Tiles whose pixels are not blank: by a method's name and threshold, or by a function of the pixels."""
    test = detector if callable(detector) else blank.pixel_detector(*detector)

    def run(it):
        for batch in it:
            shapes = zip(*(batch.column(c).to_pylist() for c in ("height", "width", "channels", "rgb")), strict=True)
            yield batch.filter(pa.array([not test(np.frombuffer(b, np.uint8).reshape(h, w, c)[:, :, :3]) for h, w, c, b in shapes], pa.bool_()))

    return tiles.mapInArrow(run, tiles.schema)


def deep_zoom(spark: SparkSession, path: str, out: str, name: str = "slide", *, tile_size: int = 256, overlap: int = 0) -> Result:
    """A deep-zoom folder of PNG tiles and its XML. Tiles are planned as rows and written by their tasks; ``out`` is
    a folder that all executors share."""
    import os

    info = images.slide_info(path)
    width, height = info.size
    slides, levels, rects = _zoom_plan(spark, info, tile_size, overlap)

    def write(rows) -> None:
        for r, tile in _zoom_tiles(info, rows):
            folder = f"{out}/{name}_files/{r['level']}"
            os.makedirs(folder, exist_ok=True)
            with open(f"{folder}/{r['col']}_{r['row']}.png", "wb") as target:
                target.write(png.encode(tile))

    rects.repartition("level", "row").foreachPartition(write)
    xml = slides.select(values.dzi_xml(F.lit(tile_size), F.lit(overlap), F.lit("png"), F.col("width"), F.col("height")).alias("x")).first()["x"]
    with open(f"{out}/{name}.dzi", "w") as f:
        f.write(xml)
    return Result("dzi", f"{out}/{name}.dzi", rects.count(), details={"max_level": levels.agg(F.max("level")).first()[0], "width": width, "height": height})


def _zoom_plan(spark: SparkSession, info: images.SlideInfo, tile_size: int, overlap: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The slide, its deep-zoom levels, and the rectangles of their tiles."""
    from tilescape.operators import geometry

    slides = spark.createDataFrame([(0, *info.size)], "slide_id long, width long, height long")
    native = spark.createDataFrame([(0, i, lv[3]) for i, lv in enumerate(info.levels)], "slide_id long, ordinal int, downsample double")
    levels = geometry.dzi_levels(slides, tile_size)
    return slides, levels, geometry.dzi_rects(levels, native, tile_size, overlap)


def _zoom_tiles(info: images.SlideInfo, rows):
    """Rectangles with their pixels, read from the slide file."""
    with open(info.path, "rb") as f:
        found = tiff.pages(f)
        for r in rows:
            page = found[info.levels[r["native_level"]][0]]
            h, w, _ = page.shape
            y0, y1 = min(r["read_y"], h - 1), min(r["read_y"] + max(1, r["read_height"]), h)
            x0, x1 = min(r["read_x"], w - 1), min(r["read_x"] + max(1, r["read_width"]), w)
            block = tiff.strip_rows(f, page, y0, max(y1, y0 + 1))[:, x0 : max(x1, x0 + 1)]
            yield r, png.scaled(block, r["tile_width"], r["tile_height"])


BENCHMARK = "file string, engine string, iteration int, width int, height int, max_level int, total_tiles int, elapsed_sec double, tiles_per_sec double"


def benchmark(spark: SparkSession, slide_paths: list[str], out: str, *, iterations: int = 3, tile_size: int = 256, overlap: int = 0) -> DataFrame:
    """Time the reading of all deep-zoom tiles of slides; one row a run, also as a CSV file with a header beneath ``out``."""
    measured = []
    for path in slide_paths:
        info = images.slide_info(path)
        _, levels, rects = _zoom_plan(spark, info, tile_size, overlap)
        total, top = rects.count(), levels.agg(F.max("level")).first()[0]

        def read(rows, info=info) -> None:
            for _ in _zoom_tiles(info, rows):
                pass

        for i in range(1, iterations + 1):
            began = time.perf_counter()
            rects.repartition("level", "row").foreachPartition(read)
            took = time.perf_counter() - began
            measured.append((path.rsplit("/", 1)[-1], "tiff", i, *info.size, top, total, took, total / took))
    rows = spark.createDataFrame(measured, BENCHMARK)
    rows.coalesce(1).write.mode("overwrite").option("header", True).csv(out)
    return rows


def thumbnail(path: str, out: str, width: int = -1, height: int = -1) -> Result:
    """A PNG thumbnail, read from the native level nearest to its scale and cropped to its aspect."""
    if width < 0 and height < 0:
        raise ValueError("give a width or a height")
    info = images.slide_info(path)
    w, h = info.size
    width = int(height * (w / h)) if width < 0 else width
    height = int(width / (w / h)) if height < 0 else height
    target = width / height
    crop_w, crop_h = (w, h) if abs(w / h - target) < 0.01 else (int(h * target), h) if w / h > target else (w, int(w / target))
    x, y = (w - crop_w) // 2, (h - crop_h) // 2
    page, _, _, down = info.levels[info.level_for_downsample(max(crop_w / width, crop_h / height))]
    with open(path, "rb") as f:
        rows = tiff.strip_rows(f, tiff.pages(f)[page], int(y / down), int(y / down) + max(1, int(crop_h / down)))
    block = rows[:, int(x / down) : int(x / down) + max(1, int(crop_w / down))]
    with open(out, "wb") as f:
        f.write(png.encode(png.scaled(block, width, height)))
    return Result("thumbnail", out, 1, details={"width": width, "height": height})
