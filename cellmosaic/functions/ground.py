"""Areas on the WGS84 ellipsoid between meridians and parallels, in square metres."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellmosaic.operators.pixels import over_pole

A, FLATTENING = 6378137.0, 1 / 298.257223563
E2 = FLATTENING * (2 - FLATTENING)


def _apart(south: Column, north: Column) -> Column:
    """Difference of the sines of two latitudes in degrees, as a product."""
    # cosine of the middle as the sine of its distance from the nearer pole, which keeps its digits there
    gap = F.radians(F.lit(90.0) - F.abs((south + north) / 2))
    return F.sin(F.radians(north - south) / 2) * F.sin(gap) * 2


def _between(low: Column, high: Column, apart: Column, width: Column) -> Column:
    """Area between two sines of latitudes that are so far apart."""
    e = math.sqrt(E2)
    inner = F.atanh(apart * e / (F.lit(1.0) - low * high * E2)) / e
    outer = apart * (low * high * E2 + 1) / ((F.lit(1.0) - low * low * E2) * (F.lit(1.0) - high * high * E2))
    return F.radians(width) * (inner + outer) * (A * A * (1 - E2) / 2)


def zone_area(south: Column, north: Column, width: Column) -> Column:
    """Area of a rectangle from its parallels and its width in degrees; null unless -90 <= south < north <= 90 and 0 < width <= 360.

    The area north of the equator is a closed form of the sine of the latitude. Of a small zone both ends have nearly the same, so the
    difference is taken inside: of sines as a product, of inverse hyperbolic tangents by their subtraction theorem.
    """
    area = _between(F.sin(F.radians(south)), F.sin(F.radians(north)), _apart(south, north), width)
    good = (south >= -90) & (north <= 90) & (south < north) & (width > 0) & (width <= 360)
    return F.when(good, area)


def rectangle_area(west: Column, south: Column, east: Column, north: Column) -> Column:
    """Of a rectangle within -180 and 180 degrees; east under west goes over the antimeridian."""
    inside = west.between(-180, 180) & east.between(-180, 180)
    return F.when(inside, zone_area(south, north, F.when(east < west, east - west + 360).otherwise(east - west)))


def pixel_area(row: Column, north: float, size: tuple[float, float]) -> Column:
    """Of a pixel of a raster in degrees whose north edge is given: all pixels of a row are alike."""
    top = F.lit(north) - row * size[1]
    return zone_area(top - size[1], top, F.lit(size[0]))


def with_pixel_area(pixels: DataFrame, north: float, size: tuple[float, float], out: str = "area") -> DataFrame:
    """Adds pixel_area, of rows beyond a pole too: they have the area that they have on the globe, at latitudes of the same sine.

    A pixel across a pole is cut there, and both sides count. Steps name what is used several times, so that generated code stays small.
    """
    c = F.col
    at = pixels.withColumn("_top", F.lit(north) - c("row") * size[1]).withColumn("_bottom", c("_top") - size[1])
    at = at.withColumn("_pole", F.greatest(F.floor((c("_top") + 90) / 180) * 180.0 - 90, c("_bottom")))
    at = at.withColumns({k: over_pole(c(k)) for k in ("_top", "_pole", "_bottom")})
    at = at.withColumns({"_d1": F.abs(_apart(c("_pole"), c("_top"))), "_d2": F.abs(_apart(c("_pole"), c("_bottom")))} | {k: F.sin(F.radians(c(k))) for k in ("_top", "_pole", "_bottom")})
    at = at.withColumn(out, _between(c("_pole"), c("_top"), c("_d1"), F.lit(size[0])) + _between(c("_pole"), c("_bottom"), c("_d2"), F.lit(size[0])))
    # counted, as a filter on the area would otherwise be put before the first step, and with it an expression that grows with each
    return at.observe(f"areas-{uuid.uuid4().hex}", F.count_if(c(out) > 0).alias("areas")).drop("_top", "_bottom", "_pole", "_d1", "_d2")
