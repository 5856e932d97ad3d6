"""Overlap rules of a mosaic, its tiles and planning of partitions."""

from __future__ import annotations

import statistics

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellmosaic.operators.pixels import in_bbox

#: Up to so many tiles ownership is an expression over all of them.
FEW_TILES = 16


def chord(lon: Column, lat: Column, lon0: Column, lat0: Column) -> Column:
    """Squared chord between two points of the unit sphere."""
    a, b, c, d = (F.radians(v) for v in (lon, lat, lon0, lat0))
    dx, dy, dz = F.cos(b) * F.cos(a) - F.cos(d) * F.cos(c), F.cos(b) * F.sin(a) - F.cos(d) * F.sin(c), F.sin(b) - F.sin(d)
    return dx * dx + dy * dy + dz * dz


def owned(samples: DataFrame, tiles: list[dict], rule: str) -> DataFrame:
    """Samples (tile, lon, lat) that their own tile keeps under the rule.

    Tiles are dicts of west, south, east, north in list order. 'first': the first tile whose footprint holds the point;
    'cutline': the tile whose centre is nearest, ties to the earlier; 'average': every sample. Footprints count with their
    edges. A sample whose owner has no data there is not filled from another tile. Ownership among a few tiles is a plain
    expression; of more, a sample is held against those that meet its box of a grid as wide as a tile, by an equi-join.
    """
    if rule == "average":
        return samples
    if rule not in ("first", "cutline"):
        raise ValueError(f"unknown overlap rule {rule!r}")
    if len(tiles) <= FEW_TILES:
        holds = [in_bbox(F.col("lon"), F.col("lat"), (t["west"], t["south"], t["east"], t["north"])) for t in tiles]
        if rule == "first":
            owner = F.coalesce(*[F.when(h, F.lit(k)) for k, h in enumerate(holds)])
        else:
            far = [F.when(h, F.struct(chord(F.col("lon"), F.col("lat"), F.lit((t["west"] + t["east"]) / 2), F.lit((t["south"] + t["north"]) / 2)).alias("d"), F.lit(k).alias("tile"))) for k, (t, h) in enumerate(zip(tiles, holds, strict=True))]
            owner = F.array_min(F.array_compact(F.array(*far)))["tile"]
        return samples.filter(F.col("tile") == owner)
    wide, high = (max(statistics.median(t[b] - t[a] for t in tiles), 1e-6) for a, b in (("west", "east"), ("south", "north")))
    dealt = bucketed_tiles(samples.sparkSession.createDataFrame([(k, *(float(t[c]) for c in ("west", "south", "east", "north"))) for k, t in enumerate(tiles)], "k int, west double, south double, east double, north double"), wide, high)
    near = samples.withColumns({"_gx": F.floor(F.col("lon") / wide), "_gy": F.floor(F.col("lat") / high)}).join(dealt, ["_gx", "_gy"])
    holding = F.filter("_tiles", lambda t: F.col("lat").between(t["south"], t["north"]) & F.col("lon").between(t["west"], t["east"]))
    if rule == "first":
        owner = F.array_min(F.transform(holding, lambda t: t["k"]))
    else:
        owner = F.array_min(F.transform(holding, lambda t: F.struct(chord(F.col("lon"), F.col("lat"), (t["west"] + t["east"]) / 2, (t["south"] + t["north"]) / 2).alias("d"), t["k"].alias("k"))))["k"]
    return near.filter(F.col("tile") == owner).select(*samples.columns)


def bucketed_tiles(tiles: DataFrame, wide: float, high: float) -> DataFrame:
    """(_gx, _gy, _tiles): for each box of a grid the tiles (k, west, south, east, north) that meet it, so that a point meets only those around it."""
    span = lambda a, b, size: F.sequence(F.floor(F.col(a) / size), F.floor(F.col(b) / size))
    met = tiles.withColumn("_gx", F.explode(span("west", "east", wide))).withColumn("_gy", F.explode(span("south", "north", high)))
    return met.groupBy("_gx", "_gy").agg(F.collect_list(F.struct("k", "west", "south", "east", "north")).alias("_tiles"))


def chunk_grid(width: int, height: int, tile_width: int, tile_height: int) -> list[tuple[int, int, int, int, int]]:
    """(chunk, column, row, width, height) in row-major order, clipped at the edges."""
    across = -(-width // tile_width)
    down = -(-height // tile_height)
    return [(r * across + c, c * tile_width, r * tile_height, min(tile_width, width - c * tile_width), min(tile_height, height - r * tile_height)) for r in range(down) for c in range(across)]


def partition_of(chunk: Column, chunks: int, target_chunks: int) -> Column:
    """Consecutive chunks share a partition of about target_chunks; partitions differ by at most one chunk."""
    count = max(1, -(-chunks // target_chunks))
    return F.floor(chunk * count / chunks).cast("long")
