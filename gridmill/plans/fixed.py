"""Constants of the registered queries."""

from __future__ import annotations

SIGMA = 1.0
RASTER_FEATURES = [f"f{k}" for k in range(8)]
EMBED_FEATURES = [f"e{k}" for k in range(8)]


def _fixed_forest() -> list[tuple[int, int, int, float, int, int, int]]:
    """Eight trees of seven nodes, so that queries need no training: thresholds and classes by rule.

    Thresholds lie off the values that flat places have, where features are 0 up to rounding.
    """
    out = []
    for t in range(8):
        root, low, high = t % 8, (t + 3) % 8, (t + 5) % 8
        inner = [(0, root, 0.2637 + 0.125 * t, 1, 4), (1, low, -0.4863 + 0.25 * t, 2, 3), (4, high, 1.0137 - 0.25 * t, 5, 6)]
        out += [(t, n, f, thr, left, right, -1) for n, f, thr, left, right in inner]
        out += [(t, n, -1, 0.0, -1, -1, (n * (1 + t % 2) + t // 3) % 4) for n in (2, 3, 5, 6)]
    return sorted(out)


FOREST = _fixed_forest()
