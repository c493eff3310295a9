"""Command line: python -m tilescape.cli STORE COMMAND ..."""

from __future__ import annotations

import argparse
from dataclasses import replace

from pyspark.sql import SparkSession

from tilescape.config import EngineConfig
from tilescape.functions.blank import parse_detector
from tilescape.plans import commands
from tilescape.plans.folders import folder_job
from tilescape.streaming.requests import watch


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tilescape")
    p.add_argument("store")
    p.add_argument("--seed", type=int, default=EngineConfig.seed)
    p.add_argument("--patch-size", type=int, default=EngineConfig.patch_size)
    p.add_argument("--mpp", type=float, default=EngineConfig.target_mpp)
    p.add_argument("--model", default=EngineConfig.default_preset)
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, *, scope: bool = False, slide: bool = False) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        c.add_argument("--overwrite", action="store_true")
        if scope:
            c.add_argument("slides", type=int, nargs="+")
            c.add_argument("--namespace")
            c.add_argument("--parent", default="")
            c.add_argument("--filter", type=int, nargs="*", default=[])
        if slide:
            c.add_argument("slide", type=int)
        return c

    for name in ("cache", "extract"):
        c = add(name, slide=True)
        c.add_argument("path", nargs=None if name == "cache" else "?")
        c.add_argument("--detect-white", nargs="*")
        c.add_argument("--image-mpp", type=float)
        if name == "extract":
            c.add_argument("--with-latent", action="store_true")
            c.add_argument("--batch-size", type=int, default=64)
    add("aggregate").add_argument("--slide-preset", default="titan")
    c = add("cluster", scope=True)
    c.add_argument("--resolution", type=float, default=EngineConfig.resolution)
    c.add_argument("--no-sort", action="store_true")
    c.add_argument("--distributed", action="store_true")
    c = add("umap", scope=True)
    c.add_argument("--n-neighbors", type=int, default=EngineConfig.n_neighbors)
    c.add_argument("--min-dist", type=float, default=EngineConfig.min_dist)
    c = add("pca", scope=True)
    c.add_argument("-n", type=int, default=1)
    c.add_argument("--scaler", choices=("minmax", "std"), default="minmax")
    c = add("preview", slide=True)
    c.add_argument("out")
    c.add_argument("--namespace", default="default")
    c.add_argument("--filter-path", default="")
    c.add_argument("--size", type=int, default=64)
    c.add_argument("--rotate", action="store_true")
    c = add("preview-score", slide=True)
    c.add_argument("name")
    c.add_argument("out")
    c.add_argument("--namespace", default="default")
    c.add_argument("--filter-path", default="")
    c.add_argument("--size", type=int, default=64)
    c.add_argument("--invert", action="store_true")
    c.add_argument("--rotate", action="store_true")
    for name, more in (("rename", ("old", "new")), ("remove", ("namespace",))):
        c = add(name)
        for argument in more:
            c.add_argument(argument)
        c.add_argument("--in-model")
    add("migrate").add_argument("metadata", help="Parquet of old-layout metadata")
    c = add("watch")
    c.add_argument("source", help="folder of JSON requests")
    c.add_argument("--interval")
    add("show")
    c = add("dzi")
    c.add_argument("path")
    c.add_argument("out")
    c.add_argument("--tile-size", type=int, default=256)
    c.add_argument("--overlap", type=int, default=0)
    c = add("thumb")
    c.add_argument("path")
    c.add_argument("out")
    c.add_argument("--width", type=int, default=-1)
    c.add_argument("--height", type=int, default=-1)
    return p


def run(arguments: list[str] | None = None, spark: SparkSession | None = None):
    a = parser().parse_args(arguments)
    spark = spark or SparkSession.builder.appName("tilescape").getOrCreate()
    config = EngineConfig(patch_size=a.patch_size, target_mpp=a.mpp, seed=a.seed)
    if a.command == "umap":
        config = replace(config, n_neighbors=a.n_neighbors, min_dist=a.min_dist)
    store = commands.Store(spark, a.store, config)
    if a.command in ("cache", "extract"):
        white = None if a.detect_white is None else parse_detector(a.detect_white)
        if a.command == "cache":
            return store.cache(a.slide, a.path, mpp=a.image_mpp, detector=white, overwrite=a.overwrite)
        return store.extract(a.slide, a.model, preset=a.model, path=a.path, mpp=a.image_mpp, latent=a.with_latent, batch_size=a.batch_size, detector=white, overwrite=a.overwrite)
    if a.command == "aggregate":
        return store.aggregate(a.model, a.slide_preset, overwrite=a.overwrite)
    if a.command in ("cluster", "umap", "pca"):
        common = {"namespace": a.namespace, "parent": a.parent, "ids": tuple(a.filter), "overwrite": a.overwrite}
        if a.command == "cluster":
            return store.cluster(a.model, a.slides, resolution=a.resolution, sort_clusters=not a.no_sort, distributed=a.distributed, **common)
        options = {"n_components": a.n, "scaler": a.scaler} if a.command == "pca" else {}
        return store.scores(a.model, a.slides, kind=a.command, **options, **common)
    if a.command == "preview":
        return store.preview(a.slide, a.model, a.out, namespace=a.namespace, filter_path=a.filter_path, size=a.size, rotate=a.rotate)
    if a.command == "preview-score":
        return store.preview_scores(a.slide, a.model, a.name, a.out, namespace=a.namespace, filter_path=a.filter_path, invert=a.invert, size=a.size, rotate=a.rotate)
    if a.command == "rename":
        return store.rename(a.old, a.new, a.in_model)
    if a.command == "remove":
        return store.remove(a.namespace, a.in_model)
    if a.command == "migrate":
        return store.migrate(spark.read.parquet(a.metadata))
    if a.command == "watch":
        query = watch(spark, a.source, f"{a.store}/watch-checkpoint", f"{a.store}/watch-status", folder_job(store), interval=a.interval)
        query.awaitTermination()
        return spark.read.parquet(f"{a.store}/watch-status")
    if a.command == "show":
        return store.show()
    if a.command == "dzi":
        return commands.deep_zoom(spark, a.path, a.out, tile_size=a.tile_size, overlap=a.overlap)
    return commands.thumbnail(a.path, a.out, a.width, a.height)


if __name__ == "__main__":
    outcome = run()
    outcome.show(truncate=False) if hasattr(outcome, "show") else print(outcome)
