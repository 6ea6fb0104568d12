"""Map layers as column expressions: coverage of lines by distance and width, inks one over the other, screen lookups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: screen coordinates that miss the map.
MISS = 65535


def held(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def line_alpha(distance: Column, width: Column, scale: Column) -> Column:
    """Coverage of a pixel by a line of a width in pixels, at a distance in texels of which scale make a pixel."""
    return held(width / 2 + 0.5 - distance / F.greatest(scale, F.lit(0.05)))


def soft_line_alpha(distance: Column, width: Column, rim: float = 0.65) -> Column:
    """Coverage by a line whose edge fades over rim pixels to either side, flat at both ends of the fade."""
    low = F.greatest(F.lit(0.0), width / 2 - rim)
    t = held((distance - low) / (width / 2 + rim - low))
    return 1 - t * t * (3 - 2 * t)


def weighted_width(weight: Column, thickness: Column) -> Column:
    """A line's width by its weight: one pixel at weight 0, thickness at 1."""
    return 1 + (thickness - 1) * weight


def revealed(phase: Column, progress: Column, ramp: float = 0.005) -> Column:
    """How far a place of a phase (0..1) is shown at a progress: a ramp behind the front, done when progress is 1."""
    return held((progress * (1 + ramp) - phase) / ramp)


def single_level_alpha(z: Column, level: float, gradient: Column, width: float, fill: str = "line") -> Column:
    """Coverage of one contour as a line, or of all that is above or below it."""
    slope = F.greatest(gradient, F.lit(0.1))
    if fill == "line":
        return held(width / 2 + 0.5 - F.abs(z - level) / slope) * (F.abs(z) > 0.05).cast("double")
    above = held((z - level) / slope + 0.5)
    return 1 - above if fill == "below" else above


def composited(base: Column, inks: list[tuple[float, Column]]) -> Column:
    """0..255 of inks (a channel's value, and its coverage) laid over base in order, half to even."""
    over = reduce(lambda below, ink: below * (1 - held(ink[1])) + ink[0] * held(ink[1]), inks, base)
    return F.rint(held(over, 0.0, 255.0)).cast("int")


def texels(screen: DataFrame, width: int, height: int) -> DataFrame:
    """screen (u, v: 0 to 65534, or MISS) with the texel (r, c) of a map of width x height that each pixel shows; null where it misses."""
    at = lambda a, n: F.when(F.col(a) != MISS, F.least(F.floor((F.col(a).cast("float") / F.lit(65534.0).cast("float") * F.lit(float(n - 1)).cast("float")).cast("double")), F.lit(n - 1)).cast("int"))
    return screen.withColumns({"r": at("v", height), "c": at("u", width)})


def gathered(screen: DataFrame, cells: DataFrame, width: int, height: int) -> DataFrame:
    """screen with z of the texel that each pixel shows; null where it misses."""
    return texels(screen, width, height).join(cells, ["tile", "r", "c"], "left")


def radially_scaled(x: Column, y: Column, width: float, height: float, factor: float) -> dict[str, Column]:
    """Where a channel is sampled that optics have stretched by a factor about the middle."""
    mx, my = (width - 1) / 2, (height - 1) / 2
    return {"x": mx + (x - mx) * factor, "y": my + (y - my) * factor}
