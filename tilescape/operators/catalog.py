"""Catalog of stored results as rows: listing, renaming, removal, upserts and migration.

A result is a row key (model, namespace, filter_path), where the reference point is a flat, canonical filter
path such as '1+2/0+1'. Every change returns the new rows; the caller overwrites the partitions they live in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilescape.config import RESERVED_NAMESPACES


def check_namespace(name: str, user: bool = False) -> str:
    if not name or name in RESERVED_NAMESPACES:
        raise ValueError(f"invalid namespace {name!r}; reserved: {', '.join(RESERVED_NAMESPACES)}")
    if user and "+" in name:
        raise ValueError("+ parts the names of several files and may not stand in a namespace")
    return name


def namespaces(assignments: DataFrame) -> DataFrame:
    """Namespaces with top-level clusters, by model."""
    return assignments.where("filter_path = ''").select("model", "namespace").distinct()


def filters(assignments: DataFrame, model: str, namespace: str, below: str = "") -> DataFrame:
    """Filter paths of a namespace, those beneath ``below`` if given, with their depth."""
    rows = assignments.where((F.col("model") == model) & (F.col("namespace") == namespace) & (F.col("filter_path") != ""))
    if below:
        rows = rows.where(F.col("filter_path").startswith(below + "/"))
    return rows.select("filter_path").distinct().withColumn("depth", F.size(F.split("filter_path", "/")))


def store_detail(slides: DataFrame, features: DataFrame, assignments: DataFrame) -> DataFrame:
    """Per slide (slide_id, patch_count): whether it has features of every cached tile, its namespaces and number of clusters."""
    n = features.groupBy("slide_id").agg(F.count("*").alias("n"))
    found = assignments.groupBy("slide_id").agg(F.array_join(F.array_sort(F.collect_set("namespace")), ",").alias("namespaces"), F.countDistinct("cluster").alias("ids"))
    out = slides.join(n, "slide_id", "left").join(found, "slide_id", "left")
    return out.select("slide_id", "patch_count", F.coalesce(F.col("n") == F.col("patch_count"), F.lit(False)).alias("has_features"), "namespaces", "ids")


def renamed(rows: DataFrame, old: str, new: str, model: str | None = None) -> DataFrame:
    """Rows with the namespace renamed, in one model or all. Everything is checked before anything changes."""
    check_namespace(new)
    scope = F.lit(True) if model is None else F.col("model") == model
    state = rows.where(scope).agg(F.max(F.col("namespace") == old).alias("old"), F.max(F.col("namespace") == new).alias("new")).first()
    if not state["old"]:
        raise ValueError(f"no namespace {old!r}")
    if state["new"]:
        raise ValueError(f"namespace {new!r} is taken")
    return with_namespace(rows, old, new, scope)


def with_namespace(rows: DataFrame, old: str, new: str, scope: Column) -> DataFrame:
    return rows.withColumn("namespace", F.when(scope & (F.col("namespace") == old), F.lit(new)).otherwise(F.col("namespace")))


def removed(rows: DataFrame, namespace: str, model: str | None = None) -> DataFrame:
    """Rows without a namespace and all that was filtered from it."""
    check_namespace(namespace)
    gone = (F.col("namespace") == namespace) & (F.lit(True) if model is None else F.col("model") == model)
    return rows.where(~gone)


def upserted(existing: DataFrame, incoming: DataFrame, key: str, overwrite: bool = False) -> DataFrame:
    """Insert-if-absent by key, or replace if ``overwrite``."""
    first, second = (incoming, existing) if overwrite else (existing, incoming)
    return first.unionByName(second.join(first.select(key), key, "left_anti"))


def migrated(old: DataFrame) -> DataFrame:
    """Metadata of the old layout as that of the cache layout: defaults for what it did not record."""
    return old.select(
        "slide_id", "patch_size", "mpp", F.coalesce("mpp", F.lit(0.5)).alias("target_mpp"), F.coalesce("image_level", F.lit(0)).alias("level_used"), "cols", "rows", "patch_count"
    )


def siblings(files: DataFrame, stems: DataFrame) -> DataFrame:
    """For each stored stem (directory, stem) the slide file beside it that comes first in the lookup order."""
    ranked = files.where("priority is not null").groupBy("directory", "stem").agg(F.min_by("path", "priority").alias("path"))
    return stems.join(ranked, ["directory", "stem"])


def resolved_model(models: DataFrame, allowed: tuple[str, ...]) -> DataFrame:
    """Per slide the one tile model (slide_id, model, preset) a slide preset takes; status tells none or several."""
    fit = models.groupBy("slide_id").agg(F.count_if(F.col("preset").isin(*allowed)).alias("n"), F.min(F.when(F.col("preset").isin(*allowed), F.col("model"))).alias("model"))
    return fit.select("slide_id", "n", F.when(F.col("n") == 1, F.col("model")).alias("model"), F.when(F.col("n") == 0, "none").when(F.col("n") == 1, "ok").otherwise("several").alias("status"))
