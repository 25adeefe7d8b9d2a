"""The filter bank: separable Gaussian derivatives and the eight features made of them.

Each pass is one window over rows (or columns) with clamped ends. All taps of a
pass share one window, so a pass is one shuffle and one sort. Long rows are cut into tiles that overlap by the
kernel's radius: a window then covers a tile and its halo, whatever the size of the image.
"""

from __future__ import annotations

from functools import reduce
from math import ceil

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridmill.constants import DEFAULT_SIGMA, MAX_RADIUS, SECOND_SCALE

FEATURES = [f"f{k}" for k in range(8)]
#: Pixels of a tile along a pass; shorter rows and columns are one.
TILE = 4_096


def half_kernel(sigma: float, order: int = 0) -> list[float]:
    """Weights at distances 0, 1, …, in single precision at each step.

    Order 0 sums to 1. Order 1 has first moment 1, so it acts by correlation. Order 2 has mean 0
    over its support and then half its second moment 1.
    """
    if sigma <= 0:
        raise ValueError("sigma must be above 0")
    radius = ceil((3 + 0.5 * order) * sigma)
    x = np.arange(-radius, radius + 1, dtype=float)
    bell = np.exp(-(x * x) / (2.0 * sigma * sigma))
    if order == 0:
        full = bell.astype(np.float32)
        full = (full / sum(bell.tolist())).astype(np.float32)
    elif order == 1:
        full = ((-x / sigma**2) * bell).astype(np.float32)
        full = (full / sum((x * full).tolist())).astype(np.float32)
    else:
        full = ((x * x / sigma**4 - 1 / sigma**2) * bell).astype(np.float32)
        full = (full - sum(full.astype(float).tolist()) / len(full)).astype(np.float32)
        full = (full / sum((0.5 * x * x * full).tolist())).astype(np.float32)
    return full[radius:].astype(float).tolist()


def kernels(sigma: float = DEFAULT_SIGMA) -> dict[str, dict[int, float]]:
    """Weights by offset of smoothing, first and second derivative, and smoothing at the smaller scale.

    Every tap is a window expression, so their number is bounded: a radius above ``MAX_RADIUS`` is an error.
    """
    if ceil(4 * sigma) > MAX_RADIUS:
        raise ValueError(f"sigma {sigma} needs a radius of {ceil(4 * sigma)}, more than {MAX_RADIUS}")
    out = {}
    for name, scale, order in (("k0", sigma, 0), ("k1", sigma, 1), ("k2", sigma, 2), ("k0s", sigma * SECOND_SCALE, 0)):
        half = half_kernel(scale, order)
        sign = -1.0 if order == 1 else 1.0
        out[name] = {d: half[abs(d)] * (sign if d < 0 else 1.0) for d in range(1 - len(half), len(half))}
    return out


def _with_halos(df: DataFrame, along: str, tile: int, radius: int) -> DataFrame:
    """Every pixel once in its own tile ``_tile``, and once in each tile that is at most ``radius`` pixels away."""
    at = F.col(along)
    first, last = F.floor((at - radius) / tile), F.floor((at + radius) / tile)
    return df.withColumn("_tile", F.explode(F.sequence(F.greatest(first, F.lit(0)), last)))


def _pass(df: DataFrame, keep: list[str], across: str, along: str, sums: dict[str, tuple[str, dict[int, float]]], tile: int | None = None) -> DataFrame:
    """Weighted sums along one axis; ``sums`` maps a new column to its input column and kernel.

    In tiles of ``tile`` pixels, if given: a pixel's taps are all in its tile or the halo, or beyond the image's end, where that of the tile stands.
    """
    if tile:
        df = _with_halos(df, along, tile, max(max(kernel) for _, kernel in sums.values()))
    line = Window.partitionBy("image_id", across, *(["_tile"] if tile else [])).orderBy(along)
    whole = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    reach = {}
    for source, kernel in sums.values():
        reach[source] = max(reach.get(source, 0), max(kernel))
    # A last default makes taps never null, which saves generated code a check for each of them.
    taps: dict[tuple[str, int], Column] = {}
    for source, radius in reach.items():
        for d in range(1, radius + 1):
            taps[source, -d] = F.coalesce(F.lag(source, d).over(line), F.first(source).over(whole), F.lit(0.0))
            taps[source, d] = F.coalesce(F.lead(source, d).over(line), F.last(source).over(whole), F.lit(0.0))
        taps[source, 0] = F.coalesce(F.col(source), F.lit(0.0))
    named = {key: f"_{key[0]}_{key[1] + radius_all}" for radius_all in [max(reach.values())] for key in taps}
    spread = df.select("*", *[taps[k].alias(named[k]) for k in taps])
    if tile:
        spread = spread.where(F.floor(F.col(along) / tile) == F.col("_tile"))
    total = lambda source, kernel: reduce(lambda a, b: a + b, [F.lit(w) * F.col(named[source, d]) for d, w in sorted(kernel.items())])
    return spread.select(*keep, *[total(s, k).alias(name) for name, (s, k) in sums.items()])


def horizontal(pixels: DataFrame, sigma: float = DEFAULT_SIGMA, keep: list[str] | None = None, tile: int | None = None) -> DataFrame:
    k = kernels(sigma)
    sums = {"h0": ("v", k["k0"]), "h1": ("v", k["k1"]), "h2": ("v", k["k2"]), "h0s": ("v", k["k0s"])}
    return _pass(pixels, keep or ["image_id", "x", "y", "i", "v"], "y", "x", sums, tile)


def vertical(rows: DataFrame, sigma: float = DEFAULT_SIGMA, keep: list[str] | None = None, tile: int | None = None) -> DataFrame:
    k = kernels(sigma)
    sums = {
        "l": ("h0", k["k0"]), "lx": ("h1", k["k0"]), "lxx": ("h2", k["k0"]), "ly": ("h0", k["k1"]),
        "lxy": ("h1", k["k1"]), "lyy": ("h0", k["k2"]), "lsub": ("h0s", k["k0s"]),
    }
    return _pass(rows, keep or ["image_id", "x", "y", "i", "v"], "x", "y", sums, tile)


def eigenvalues(a: Column, b: Column, c: Column) -> tuple[Column, Column]:
    """Of the symmetric matrix (a b; b c), the larger first."""
    middle, spread = (a + c) * 0.5, F.sqrt((a - c) * (a - c) * 0.25 + b * b)
    return middle + spread, middle - spread


def feature_columns() -> dict[str, Column]:
    c = F.col
    tensor = eigenvalues(c("lx") * c("lx"), c("lx") * c("ly"), c("ly") * c("ly"))
    hessian = eigenvalues(c("lxx"), c("lxy"), c("lyy"))
    return {
        "f0": c("l"), "f1": c("lxx") + c("lyy"), "f2": F.sqrt(c("lx") * c("lx") + c("ly") * c("ly")), "f3": c("l") - c("lsub"),
        "f4": tensor[0], "f5": tensor[1], "f6": hessian[0], "f7": hessian[1],
    }


def features(pixels: DataFrame, sigma: float = DEFAULT_SIGMA, width: int = 0, height: int = 0) -> DataFrame:
    """``(image_id, x, y, i, v, f0 … f7)`` of a dense raster: smoothing, Laplacian, gradient, difference
    of Gaussians, eigenvalues of the structure tensor and of the Hessian.

    ``width`` and ``height`` say how long rows and columns are; those above ``TILE`` are treated in tiles."""
    in_rows = horizontal(pixels, sigma, tile=TILE if width > TILE else None)
    both = vertical(in_rows, sigma, tile=TILE if height > TILE else None)
    return both.select("image_id", "x", "y", "i", "v", *[e.alias(n) for n, e in feature_columns().items()])
