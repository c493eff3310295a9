"""Column expressions for sizes, colours, scores, devices and request lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tilescape.config import PALETTE


def byte_size(n: Column) -> Column:
    """Human-readable size with no decimals; empty for 0."""
    unit = lambda power, name: F.concat(F.floor(n / (1024**power) + 0.5).cast("string"), F.lit(f" {name}"))
    return F.when(n == 0, F.lit("")).when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024**2, unit(1, "KB")).when(n < 1024**3, unit(2, "MB")).otherwise(unit(3, "GB"))


def luminance(r: Column, g: Column, b: Column) -> Column:
    """Relative luminance of channels in 0 .. 1 (WCAG)."""
    linear = lambda c: F.when(c <= 0.03928, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))
    return 0.2126 * linear(r) + 0.7152 * linear(g) + 0.0722 * linear(b)


def channel(colour: Column, at: int) -> Column:
    return F.conv(F.substring(colour, 2 + 2 * at, 2), 16, 10).cast("double") / 255.0


def contrast_colour(colour: Column) -> Column:
    return F.when(luminance(*(channel(colour, i) for i in range(3))) > 0.179, "black").otherwise("white")


def cluster_colour(cluster: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, PALETTE)), (F.pmod(cluster, F.lit(len(PALETTE))) + 1).cast("int"))


#: Corners (place, level) of the rainbow colour map's channels.
JET = {"r": ((0.0, 0.0), (0.35, 0.0), (0.66, 1.0), (0.89, 1.0), (1.0, 0.5)), "g": ((0.0, 0.0), (0.125, 0.0), (0.375, 1.0), (0.64, 1.0), (0.91, 0.0), (1.0, 0.0)), "b": ((0.0, 0.5), (0.11, 1.0), (0.34, 1.0), (0.65, 0.0), (1.0, 0.0))}


def score_colour(score: Column) -> Column:
    """Colour of a score in 0 .. 1 on the rainbow map of 256 steps, as #rrggbb; null for a missing score."""
    place = F.least(F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)) * 256), F.lit(255)) / 255.0

    def level(corners) -> Column:
        out = F.lit(corners[-1][1])
        for (x0, y0), (x1, y1) in reversed(list(zip(corners, corners[1:], strict=False))):
            out = F.when(place <= x1, y0 + (place - x0) * ((y1 - y0) / (x1 - x0))).otherwise(out)
        return F.lpad(F.lower(F.hex(F.bround(out * 255, 0).cast("long"))), 2, "0")

    return F.when(score.isNotNull() & ~F.isnan(score), F.concat(F.lit("#"), *[level(JET[c]) for c in "rgb"]))


def quantised_score(score: Column) -> Column:
    """Score rounded half-even to three decimals; null for NaN, which has no frame."""
    return F.when(~F.isnan(score), F.bround(score, 3) + 0.0)


def sigmoid(z: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-z))


def device_list(spec: Column, available: int) -> Column:
    """Devices named by a specification on a machine with so many accelerators; cpu where none is left."""
    cpu, everything = F.array(F.lit("cpu")), F.array(*[F.lit(f"cuda:{i}") for i in range(available)]) if available else F.array(F.lit("cpu"))
    wanted = F.transform(F.split(F.regexp_extract(spec, r"^cuda:(.*)$", 1), ","), lambda x: F.trim(x).cast("int"))
    listed = F.transform(F.filter(wanted, lambda x: (x >= 0) & (x < available)), lambda x: F.concat(F.lit("cuda:"), x.cast("string")))
    named = F.when(F.size(listed) > 0, listed).otherwise(cpu)
    first = F.array(F.lit("cuda:0")) if available else cpu
    return F.when(spec == "auto", everything).when(spec == "cuda", first).when(spec.startswith("cuda:"), named).otherwise(cpu)


def request(line: Column, default_preset: str = "uni2") -> Column:
    """struct(preset, rotate) of a request line 'preset[, rotate]'."""
    parts = F.transform(F.split(line, ","), lambda x: F.trim(x))
    preset = F.when(F.length(parts[0]) > 0, parts[0]).otherwise(F.lit(default_preset))
    return F.struct(preset.alias("preset"), (F.lower(F.coalesce(F.get(parts, F.lit(1)), F.lit(""))) == "rotate").alias("rotate"))


def is_status(text: Column) -> Column:
    """Whether the text is a status that the watcher wrote, rather than a request."""
    return text.rlike("^(PROCESSING|DONE|ERROR)")


def minutes_seconds(elapsed: Column) -> Column:
    whole = F.floor(elapsed).cast("long")
    return F.concat((F.floor(whole / 60)).cast("string"), F.lit("m"), F.pmod(whole, F.lit(60)).cast("string"), F.lit("s"))


def extraction_summary(kept: Column, total: Column, batches: Column, elapsed: Column, mean: Column, std: Column, model: Column, dim: Column) -> Column:
    ratio = F.when(total > 0, kept / total * 100).otherwise(F.lit(0.0))
    return F.concat(
        F.format_string("%d/%d patches (%.1f%%), filtered=%d, %d batches, ", kept, total, F.bround(ratio, 1), total - kept, batches),
        minutes_seconds(elapsed),
        F.format_string(" elapsed (%.2f±%.2fs/batch), model=%s, dim=%d", mean, std, model, dim),
    )


def dzi_xml(tile_size: Column, overlap: Column, fmt: Column, width: Column, height: Column) -> Column:
    return F.format_string(
        '<?xml version="1.0" encoding="utf-8"?>\n<Image xmlns="http://schemas.microsoft.com/deepzoom/2008"\n       Format="%s"\n       Overlap="%d"\n       TileSize="%d">\n  <Size Width="%d" Height="%d"/>\n</Image>', fmt, overlap, tile_size, width, height
    )


def mpp(numerator: Column, denominator: Column, unit: Column) -> Column:
    """Micrometres a pixel of a resolution in pixels an inch (unit 2), a centimetre (3) or a micrometre."""
    resolution = numerator / denominator
    return F.when(unit == 2, 25400.0 / resolution).when(unit == 3, 10000.0 / resolution).otherwise(1.0 / resolution)
