"""Column expressions for file names, namespaces and the path grammar {model}/{namespace}[/filter/{ids}]*/{dataset}."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tilescape.config import FILE_TYPES, RESERVED_NAMESPACES, SLIDE_EXTENSIONS


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    """The file name without its last extension; a leading dot does not start one."""
    return F.regexp_replace(file_name(path), r"^(.+)\.[^.]+$", "$1")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(file_name(path), r"^.+(\.[^.]+)$", 1))


def normalized_name(path: Column) -> Column:
    return F.translate(stem(path), "+/", "__")


def namespace_of(paths: Column) -> Column:
    """Namespace of an array of paths: default for one, else the sorted names joined by +."""
    return F.when(F.size(paths) == 1, F.lit("default")).otherwise(F.array_join(F.array_sort(F.transform(paths, normalized_name)), "+"))


def valid_namespace(namespace: Column) -> Column:
    return F.coalesce((F.length(namespace) > 0) & ~namespace.isin(*RESERVED_NAMESPACES), F.lit(False))


def joined_ids(ids: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(ids), lambda x: x.cast("string")), "+")


def filter_path(model: Column, namespace: Column, filters: Column, dataset: Column) -> Column:
    """Path of a result; ``filters`` is an array of arrays of cluster ids, sorted but not deduplicated."""
    levels = F.transform(filters, lambda ids: F.concat(F.lit("/filter/"), joined_ids(ids)))
    return F.concat(model, F.lit("/"), namespace, F.array_join(levels, ""), F.lit("/"), dataset)


def parsed_path(path: Column) -> Column:
    """struct(model, namespace, filters, dataset), the inverse of ``filter_path``."""
    parts = F.split(path, "/")
    levels = F.filter(F.transform(parts, lambda p, i: F.when((i >= 2) & (i < F.size(parts) - 1) & (F.element_at(parts, i) == "filter"), p)), lambda p: p.isNotNull())
    ids = F.transform(levels, lambda p: F.transform(F.split(p, r"\+"), lambda x: x.cast("int")))
    return F.struct(parts[0].alias("model"), parts[1].alias("namespace"), ids.alias("filters"), F.element_at(parts, -1).alias("dataset"))


def parsed_filter(text: Column) -> Column:
    """'1+2/0+1' as [[1, 2], [0, 1]]; null or empty as an empty array."""
    parts = F.filter(F.split(F.coalesce(text, F.lit("")), "/"), lambda p: p != "")
    return F.transform(parts, lambda p: F.transform(F.split(p, r"\+"), lambda x: x.cast("int")))


def user_namespace(namespace: Column) -> Column:
    return namespace.rlike("^[a-z0-9]+$")


def output_path(path: Column, namespace: Column, name: Column) -> Column:
    parent = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    return F.when(namespace == "default", F.concat_ws("/", parent, name)).otherwise(F.concat_ws("/", parent, namespace, name))


def file_type(path: Column, is_dir: Column) -> Column:
    out = F.when(is_dir, F.lit("directory"))
    for kind, endings in FILE_TYPES.items():
        out = out.when(extension(path).isin(*endings), F.lit(kind))
    return out.otherwise(F.lit("other"))


def sibling_priority(path: Column, extensions: Sequence[str] = SLIDE_EXTENSIONS) -> Column:
    """Rank of a path's longest listed extension in the lookup order; null if none fits."""
    name, out = F.lower(file_name(path)), F.lit(None).cast("int")
    for rank in sorted(range(len(extensions)), key=lambda r: len(extensions[r])):
        out = F.when(name.endswith(extensions[rank]), F.lit(rank)).otherwise(out)
    return out


def reader_engine(path: Column, pages: Column) -> Column:
    """Engine that opens a file: TIFFs by their number of pages, plain images, else the slide library."""
    ext = extension(path)
    return F.when(ext.isin(".tif", ".tiff"), F.when(pages > 1, "tifffile").otherwise("standard")).when(ext.isin(".jpg", ".jpeg", ".png"), "standard").otherwise("openslide")
