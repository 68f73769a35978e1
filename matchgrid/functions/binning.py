"""Assignment of values to bins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The default configuration's edges and operating points.
POSITION_M = (0.0, 1.0, 3.0, 5.0, 10.0, 20.0, 40.0, float("inf"))
AZIMUTH_DEG = (0.0, 5.0, 10.0, 20.0, 45.0, 90.0, 180.0)
KEYPOINT_IOU = (0.0, 0.25, 0.5, 0.75, 1.0)
MIN_KEYPOINTS = (0.0, 4.0, 8.0, 12.0, 16.0, float("inf"))
FAR_TARGETS = (0.001, 0.01, 0.02, 0.05, 0.1)
FIXED_THRESHOLDS = (0.5,)
MIN_POSITIVES, MIN_OBJECTS, MIN_VIDEO_PAIRS = 30, 10, 30

COARSE, FINE = 200, 2000


def check_edges(edges: Sequence[float]) -> None:
    if len(edges) < 2 or any(a >= b for a, b in zip(edges, edges[1:])):
        raise ValueError(f"edges must rise: {edges}")


def bucket(x: Column, edges: Sequence[float]) -> Column:
    """Half-open bins between the edges; below the first is bin 0, at or above the last inner edge the last bin.
    Unknown (null) is one bin more."""
    check_edges(edges)
    inner = [F.when(x >= F.lit(e), 1).otherwise(0) for e in edges[1:-1]]
    return F.when(x.isNull(), F.lit(len(edges) - 1)).otherwise(sum(inner, F.lit(0)))


def labels(edges: Sequence[float]) -> list[str]:
    """Names of the bins, the last closed, and of the bin of unknown values."""
    check_edges(edges)
    n = len(edges) - 1
    return [f"[{a:g},{b:g}{']' if k == n - 1 else ')'}" for k, (a, b) in enumerate(zip(edges, edges[1:]))] + ["unknown"]


def similarity_bin(s: Column, bins: int) -> Column:
    """Bins of equal width over [-1, 1]; values outside go to the outermost."""
    return F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((s + 1) * (bins // 2)).cast("int")))


def edge(k: Column, bins: int) -> Column:
    """The lower edge of a bin."""
    return F.lit(-1.0) + k * F.lit(2.0 / bins)


def point_name(value: float, fixed: bool = False) -> str:
    """An operating point's name: a share of false accepts in percent, or a fixed threshold."""
    return f"th{value:g}" if fixed else f"{value * 100:g}pct"


def operating_points(targets: Sequence[float] = FAR_TARGETS, fixed: Sequence[float] = FIXED_THRESHOLDS) -> list[tuple[int, str, float, bool]]:
    """place, name, value and whether it is a fixed threshold: shares of false accepts from the strictest on, then thresholds."""
    points = [(point_name(v), v, False) for v in sorted(targets)] + [(point_name(v, True), v, True) for v in sorted(fixed)]
    return [(k, *p) for k, p in enumerate(points)]
