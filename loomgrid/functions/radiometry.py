"""Tile weights, softmax and contrast stretch."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def edge_weight(offset: Column, tile: int, overlap: int, taper: float = 0.1) -> Column:
    """Ramp along one axis: taper..1 over the first ``overlap`` places, and mirrored over the last.

    Where the ramps meet (overlap above half a tile) the closing ramp wins. No overlap: 1.
    """
    if overlap <= 0:
        return F.lit(1.0)
    step = (1.0 - taper) / (overlap - 1) if overlap > 1 else 0.0
    rise = taper + offset * step
    fall = taper + (tile - 1 - offset) * step
    return F.when(offset >= tile - overlap, fall).when(offset < overlap, rise).otherwise(1.0).cast("double")


def tile_weight(row_offset: Column, col_offset: Column, tile: int, overlap: int, taper: float = 0.1) -> Column:
    return edge_weight(row_offset, tile, overlap, taper) * edge_weight(col_offset, tile, overlap, taper)


def softmax(scores: Column) -> Column:
    """Softmax of an array, shifted by its largest value."""
    e = F.transform(scores, lambda x: F.exp(x.cast("double") - F.array_max(scores).cast("double")))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, v: s + v))


def stretch(value: Column, low: Column, high: Column) -> Column:
    """Linear stretch to 0..255, truncated; zeros stay 0."""
    scaled = F.least(F.greatest((value - low) / (high - low) * 255, F.lit(0.0)), F.lit(255.0))
    return F.when(value == 0, 0).otherwise(scaled.cast("int"))


def clean(value: Column) -> Column:
    """NaN and infinities become 0."""
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), F.lit(0.0)).otherwise(value)
