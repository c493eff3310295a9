"""Slides of all formats that the OpenSlide library reads, where it is installed: one partition a row strip of tiles.

``spark.read.format("tile_slide").option("path", p).option("level", 0).option("patch_size", 256).load()`` gives what
``tile_tiff`` gives.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader

from tilescape.sources.tiff import Strip, TiffSource


def opened(path: str):
    try:
        import openslide
    except ImportError as e:
        raise ImportError(f"{path} needs the OpenSlide library, which is not installed") from e
    return openslide.OpenSlide(path)


def levels(path: str) -> tuple[tuple[int, int, int, float], ...]:
    """Native levels (ordinal, width, height, downsample), as the library lists them."""
    with opened(path) as slide:
        return tuple((i, w, h, float(d)) for i, ((w, h), d) in enumerate(zip(slide.level_dimensions, slide.level_downsamples, strict=True)))


def mpp(path: str) -> float | None:
    with opened(path) as slide:
        found = slide.properties.get("openslide.mpp-x")
    return None if found is None else float(found)


class SlideReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.level, self.size = options["path"], int(options.get("level", 0)), int(options.get("patch_size", 256))

    def partitions(self) -> list[Strip]:
        return [Strip(r) for r in range(levels(self.path)[self.level][2] // self.size)]

    def read(self, partition: Strip) -> Iterator[tuple]:
        size, row = self.size, partition.row
        with opened(self.path) as slide:
            width, down = slide.level_dimensions[self.level][0], slide.level_downsamples[self.level]
            cols = width // size
            for col in range(cols):
                # places are those of the largest level
                region = slide.read_region((int(col * size * down), int(row * size * down)), self.level, (size, size))
                tile = np.ascontiguousarray(np.asarray(region)[:, :, :3])
                yield row * cols + col, col, row, col * size, row * size, size, size, 3, tile.tobytes()


class SlideSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tile_slide"

    def schema(self) -> str:
        return TiffSource.schema(self)

    def reader(self, schema) -> SlideReader:
        return SlideReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SlideSource)
