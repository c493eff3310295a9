"""Blank-tile detectors over an array of pixels, struct(r, g, b) of integers. True means blank."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _share(pixels: Column, test: Callable[[Column], Column]) -> Column:
    return F.size(F.filter(pixels, test)) / F.size(pixels)


def peak_to_peak(pixels: Column, ratio: float = 0.9, spread: int = 20) -> Column:
    """More than ``ratio`` of the pixels have channels closer than ``spread``."""
    return _share(pixels, lambda p: F.greatest(p["r"], p["g"], p["b"]) - F.least(p["r"], p["g"], p["b"]) < spread) > ratio


def deviation(pixels: Column, ratio: float = 0.75, std: float = 7.0) -> Column:
    """More than ``ratio`` of the pixels have a channel deviation below ``std``."""

    def small(p: Column) -> Column:
        mean = (p["r"] + p["g"] + p["b"]) / 3.0
        return (p["r"] * p["r"] + p["g"] * p["g"] + p["b"] * p["b"]) / 3.0 - mean * mean < std * std

    return _share(pixels, small) > ratio


def green(pixels: Column, threshold: float = 0.9) -> Column:
    """The mean green channel is above ``threshold``."""
    return F.aggregate(pixels, F.lit(0).cast("long"), lambda acc, p: acc + p["g"]) / F.size(pixels) / 255.0 > threshold


def grey(p: Column) -> Column:
    return F.floor(0.299 * p["r"] + 0.587 * p["g"] + 0.114 * p["b"] + 0.5).cast("int")


def otsu_threshold(pixels: Column) -> Column:
    """The grey level that separates the pixels into the two classes furthest apart; the lowest of equal ones.

    Levels between two occurring ones split the pixels alike, so only occurring levels are tried.
    """
    zero = F.lit(0).cast("long")

    def best(greys: Column) -> Column:
        n = F.size(greys)
        start = F.struct(zero.alias("w"), zero.alias("s"), F.lit(-1.0).alias("v"), F.lit(-1).alias("t"))

        def step(total: Column):
            # sorted greys: after the last one of a level, all up to it are the lower class
            def run(acc: Column, g: Column) -> Column:
                w, s = acc["w"] + 1, acc["s"] + g
                d = s * n - total * w
                v = F.when(w < n, d.cast("double") * d / (w.cast("double") * (n - w))).otherwise(F.lit(0.0))
                last = (w == n) | (F.get(greys, w.cast("int")) != g)
                better = last & (v > acc["v"])
                return F.struct(w.alias("w"), s.alias("s"), F.when(better, v).otherwise(acc["v"]).alias("v"), F.when(better, g).otherwise(acc["t"]).alias("t"))

            return run

        total = F.aggregate(greys, zero, lambda a, g: a + g)
        return F.element_at(F.transform(F.array(total), lambda all_: F.aggregate(greys, start, step(all_), lambda acc: acc["t"])), 1)

    return F.element_at(F.transform(F.array(F.array_sort(F.transform(pixels, grey))), best), 1)


def otsu(pixels: Column, ratio: float = 0.8) -> Column:
    """More than ``ratio`` of the pixels are above the Otsu threshold."""
    # through a one-element array, so that the threshold is worked out once and not for every pixel
    share = F.transform(F.array(otsu_threshold(pixels)), lambda t: _share(pixels, lambda p: grey(p) > t))
    return F.element_at(share, 1) > ratio


DETECTORS: dict[str, Callable[..., Column]] = {"ptp": peak_to_peak, "otsu": otsu, "std": deviation, "green": green}


def detector(method: str, threshold: float | None = None) -> Callable[[Column], Column]:
    """A detector by name; the threshold replaces its first parameter."""
    if method not in DETECTORS:
        raise ValueError(f"unknown detector {method!r}; one of {sorted(DETECTORS)}")
    chosen = DETECTORS[method]
    return (lambda pixels: chosen(pixels)) if threshold is None else (lambda pixels: chosen(pixels, threshold))


def parse_detector(arguments: list[str]) -> tuple[str, float | None]:
    """['std', '0.8'] as ('std', 0.8); nothing as ('ptp', None)."""
    if not arguments:
        return "ptp", None
    if arguments[0] not in DETECTORS:
        raise ValueError(f"unknown detector {arguments[0]!r}; one of {sorted(DETECTORS)}")
    return arguments[0], float(arguments[1]) if len(arguments) > 1 else None


def pixel_detector(method: str, threshold: float | None = None) -> Callable:
    """The same detectors on a decoded tile, a NumPy array [H, W, 3] of bytes."""
    import numpy as np

    first = {"ptp": 0.9, "otsu": 0.8, "std": 0.75, "green": 0.9}
    if method not in first:
        raise ValueError(f"unknown detector {method!r}; one of {sorted(DETECTORS)}")
    limit = first[method] if threshold is None else threshold

    def run(tile) -> bool:
        p = tile.astype(np.float64)
        if method == "ptp":
            share = (p.max(2) - p.min(2) < 20).mean()
        elif method == "std":
            share = (p.std(2) < 7.0).mean()
        elif method == "green":
            share = p[:, :, 1].mean() / 255.0
        else:
            levels = np.floor(p @ np.array([0.299, 0.587, 0.114]) + 0.5).astype(np.int64).ravel()
            counts = np.bincount(levels, minlength=256)
            w, s = counts.cumsum(), (counts * np.arange(256)).cumsum()
            d = s * w[-1] - s[-1] * w
            with np.errstate(divide="ignore", invalid="ignore"):
                between = np.where((w > 0) & (w < w[-1]), d.astype(float) ** 2 / (w * (w[-1] - w)), 0.0)
            share = (levels > between.argmax()).mean()
        return bool(share > limit)

    return run
