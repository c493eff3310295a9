"""The job that a folder request starts: every slide of the folder cached, its features extracted, clustered and laid out."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilescape.config import SLIDE_EXTENSIONS
from tilescape.plans.commands import Store


def slide_files(spark: SparkSession, folder: str) -> DataFrame:
    """path of every slide file right in a folder, sorted: the work list of a request."""
    ending = F.lower(F.col("path"))
    fits = F.lit(False)
    for e in SLIDE_EXTENSIONS:
        fits = fits | ending.endswith(e)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.*").load(folder)  # the content is never read
    return files.select(F.regexp_replace("path", "^file:/+", "/").alias("path")).where(fits).orderBy("path")


def slide_number(path: str) -> int:
    """A slide's id from its name."""
    return zlib.crc32(path.rsplit("/", 1)[-1].encode()) & 0x7FFFFF


def folder_job(store: Store, *, detector=("ptp", None), on_step: Callable[[str, str], None] | None = None, **extract_options) -> Callable[[SparkSession, str, str, bool], None]:
    """A job for ``streaming.requests.watch``: cache, extract, cluster, layout, preview and thumbnail of every slide of the
    folder, in the order of their paths. The first error ends the folder."""
    from tilescape.plans.commands import thumbnail

    def run(spark: SparkSession, folder: str, preset: str, rotate: bool) -> None:
        for r in slide_files(spark, folder).toLocalIterator():
            path, number = r["path"], slide_number(r["path"])
            stem = path.rsplit(".", 1)[0]
            steps = (
                ("cache", lambda p=path, n=number: store.cache(n, p, detector=detector)),
                ("extract", lambda n=number: store.extract(n, preset, preset=preset, **extract_options)),
                ("cluster", lambda n=number: store.cluster(preset, [n], namespace=f"s{n}")),
                ("umap", lambda n=number: store.scores(preset, [n], kind="umap", namespace=f"s{n}")),
                ("preview", lambda n=number, s=stem: store.preview(n, preset, f"{s}_preview.png", namespace=f"s{n}", rotate=rotate)),
                ("thumbnail", lambda p=path, s=stem: thumbnail(p, f"{s}_thumb.png", width=512)),
            )
            for name, step in steps:
                if on_step:
                    on_step(path, name)
                step()

    return run

