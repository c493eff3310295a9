"""Plain images, slide metadata and the choice of a source for a slide's tiles."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilescape.config import SLIDE_EXTENSIONS
from tilescape.sources import slide_library, tables, tiff

#: Share by which a cached resolution may differ from the wanted one.
MPP_TOLERANCE = 0.1


def plain_images(spark: SparkSession, path: str) -> DataFrame:
    """path, height, width, channels, rgb of plain images; the reader's blue-green-red bytes are turned round."""
    import numpy as np
    import pyarrow as pa

    raw = spark.read.format("image").option("dropInvalid", True).load(path).select("image.origin", "image.height", "image.width", "image.nChannels", "image.data")

    def run(it):
        for batch in it:
            out = []
            for h, w, c, data in zip(*(batch.column(k).to_pylist() for k in ("height", "width", "nChannels", "data")), strict=True):
                px = np.frombuffer(data, np.uint8).reshape(h, w, c)
                out.append(np.ascontiguousarray(px[:, :, 2::-1] if c >= 3 else np.repeat(px, 3, axis=2)).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("origin"), batch.column("height"), batch.column("width"), pa.array([3] * len(out), pa.int32()), pa.array(out, pa.binary())], names=["path", "height", "width", "channels", "rgb"])

    return raw.mapInArrow(run, "path string, height int, width int, channels int, rgb binary")


@dataclass(frozen=True)
class SlideInfo:
    """Native levels (page, width, height, downsample) and resolution of a slide file."""

    path: str
    levels: tuple[tuple[int, int, int, float], ...]
    mpp: float

    @property
    def size(self) -> tuple[int, int]:
        return self.levels[0][1:3]

    def level_for(self, mpp: float) -> int:
        """The level nearest to a resolution; the first of equally near ones."""
        return min(range(len(self.levels)), key=lambda i: abs(self.mpp * self.levels[i][3] - mpp))

    def level_for_downsample(self, downsample: float) -> int:
        return min(range(len(self.levels)), key=lambda i: abs(self.levels[i][3] - downsample))


def slide_info(path: str, mpp: float | None = None) -> SlideInfo:
    """Levels by the rules of geometry.discover_levels, from the headers alone."""
    with open(path, "rb") as f:
        found = tiff.pages(f)
    levels: list[tuple[int, int, int, float]] = []
    for p in found:
        h, w, c = p.shape
        if h < 100 or w < 100 or c != 3:
            continue
        if levels:
            down = levels[0][1] / w
            if abs(w / h - levels[0][1] / levels[0][2]) > 0.1 or down / levels[-1][3] > 3.0:
                break
        else:
            down = 1.0
        levels.append((p.index, w, h, down))
    if not levels:
        raise ValueError(f"no usable page in {path}")
    resolution = found[levels[0][0]].mpp or mpp
    if not resolution:
        raise ValueError(f"{path} has no resolution; give mpp")
    return SlideInfo(path, tuple(levels), resolution)


IMAGE_ENDINGS = (".jpg", ".jpeg", ".png")


def image_tiles(spark: SparkSession, path: str, patch_size: int) -> DataFrame:
    """The whole tiles of a plain image, which has one level: tile_id, col, row, x, y, height, width, channels, rgb."""
    import numpy as np
    import pyarrow as pa

    names = ["tile_id", "col", "row", "x", "y", "height", "width", "channels", "rgb"]

    def run(it):
        for batch in it:
            for r in batch.to_pylist():
                px = np.frombuffer(r["rgb"], np.uint8).reshape(r["height"], r["width"], 3)
                cols = r["width"] // patch_size
                for row in range(r["height"] // patch_size):  # a row of tiles a batch
                    strip = px[row * patch_size : (row + 1) * patch_size]
                    tiles = [(row * cols + c, c, row, c * patch_size, row * patch_size, patch_size, patch_size, 3, np.ascontiguousarray(strip[:, c * patch_size : (c + 1) * patch_size]).tobytes()) for c in range(cols)]
                    kinds = [pa.int64(), *[pa.int32()] * 7, pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array([t[i] for t in tiles], k) for i, k in enumerate(kinds)], names=names)

    return plain_images(spark, path).mapInArrow(run, "tile_id long, col int, row int, x int, y int, height int, width int, channels int, rgb binary")


def open_slide(spark: SparkSession, path: str, patch_size: int, target_mpp: float, mpp: float | None = None) -> tuple[DataFrame, SlideInfo, int]:
    """Tiles, levels and the chosen level of a slide file: a pyramid, or a plain image, whose resolution must be given."""
    if path.lower().endswith(IMAGE_ENDINGS):
        if mpp is None:
            raise ValueError(f"{path} has no resolution; give mpp")
        size = plain_images(spark, path).select("width", "height").first()
        info = SlideInfo(path, ((0, size["width"], size["height"], 1.0),), mpp)
        return image_tiles(spark, path, patch_size), info, 0
    if not path.lower().endswith((".tif", ".tiff")):
        resolution = mpp or slide_library.mpp(path)
        if not resolution:
            raise ValueError(f"{path} has no resolution; give mpp")
        info = SlideInfo(path, slide_library.levels(path), resolution)
        level = info.level_for(target_mpp)
        slide_library.register(spark)
        return spark.read.format("tile_slide").option("path", path).option("level", level).option("patch_size", patch_size).load(), info, level
    info = slide_info(path, mpp)
    level = info.level_for(target_mpp)
    tiff.register(spark)
    return spark.read.format("tile_tiff").option("path", path).option("level", info.levels[level][0]).option("patch_size", patch_size).load(), info, level


def sibling(spark: SparkSession, path: str) -> str | None:
    """The slide file beside a stored result of the same stem that comes first in the lookup order."""
    stem = path.rsplit(".", 1)[0]
    return next((stem + e for e in SLIDE_EXTENSIONS if tables.exists(spark, stem + e)), None)


def resolved(spark: SparkSession, path: str) -> str:
    """The stored result (.h5) of a path: itself, or the one beside a slide file."""
    ending = "." + path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
    if ending == ".h5":
        return path
    if ending not in SLIDE_EXTENSIONS:
        raise ValueError(f"unsupported input {path}: a .h5 file or one of {', '.join(SLIDE_EXTENSIONS)}")
    stored = path[: -len(ending)] + ".h5"
    if not tables.exists(spark, stored):
        raise FileNotFoundError(f"no {stored} beside {path}; extract features first")
    return stored


def tile_source(spark: SparkSession, root: str, slide_id: int, patch_size: int, target_mpp: float, path: str | None, mpp: float | None = None) -> tuple[DataFrame, str]:
    """Tiles (slide_id, tile_id, x, y, height, width, channels, rgb) and where they come from: the cache if it has the
    slide at a resolution within MPP_TOLERANCE of the wanted one, else the slide file."""
    try:
        cached = tables.read_stored(spark, root, "tiles").where((F.col("slide_id") == slide_id) & (F.col("patch_size") == patch_size))
        at = tables.read_stored(spark, root, "slides").where((F.col("slide_id") == slide_id) & (F.col("patch_size") == patch_size)).select("mpp").first()
        fits = at is not None and abs(at["mpp"] - target_mpp) / target_mpp <= MPP_TOLERANCE
        if (fits or path is None) and not cached.limit(1).isEmpty():
            return cached.select("slide_id", "tile_id", "x", "y", "height", "width", "channels", "rgb"), "cache"
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
    if path is None:
        raise FileNotFoundError(f"slide {slide_id} is not cached and no slide file is given")
    read, _, _ = open_slide(spark, path, patch_size, target_mpp, mpp)
    return read.select(F.lit(slide_id).cast("long").alias("slide_id"), "tile_id", "x", "y", "height", "width", "channels", "rgb"), "slide"
