"""From raster files to cells in one call: the options are checked, the source reads, projects, assigns and aggregates.

Every option is honoured or refused. Whatever is asked for, files are read once: levels, quantiles and empty cells all come from one
aggregation of the samples by cell and, for quantiles, by bucket. The result is an ordinary DataFrame, so filters on `cell` and
`resolution` reach the aggregation's input by Catalyst's own rules, and those on finished statistics stay above it.
"""

from __future__ import annotations

import math
from dataclasses import replace

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from cellmosaic.functions import crs, crs_text, grids, healpix, wkb
from cellmosaic.operators import categorical, continuous, mosaic, pixels, polyfill, quantiles, transfer
from cellmosaic.plans.options import ScanOptions, parse_auto, parse_bands, parse_edges, parse_quantiles
from cellmosaic.sources import formats, geotiff
from cellmosaic.sources.scratch import scratch_path

#: Levels that states are rolled up by in one step, so that no group of states is large.
STEP = 3


def _refuse(options: ScanOptions, what: str, **given) -> None:
    for name, value in given.items():
        if getattr(options, name) != value:
            raise ValueError(f"{what} has no use for {name}")


def file_boxes(spark: SparkSession, paths: list[str]) -> list[dict]:
    """west, south, east, north, width, height, pixel and epsg of each file in its own CRS; headers are read in tasks."""

    def run(batches):
        for pdf in batches:
            rows = []
            for k, path in zip(pdf["k"], pdf["path"], strict=True):
                i = geotiff.read_info(path)
                rows.append((k, i.origin[0], i.origin[1] - i.height * i.pixel[1], i.origin[0] + i.width * i.pixel[0], i.origin[1], i.epsg, i.width, i.height, *i.pixel))
            yield pd.DataFrame(rows, columns=["k", "west", "south", "east", "north", "epsg", "width", "height", "px", "py"]).astype({"epsg": "Int64"})

    rows = spark.createDataFrame(list(enumerate(paths)), "k long, path string").repartition(min(len(paths), 1000))
    return [r.asDict() for r in rows.mapInPandas(run, "k long, west double, south double, east double, north double, epsg long, width long, height long, px double, py double").orderBy("k").collect()]


def _code(boxes: list[dict], options: ScanOptions) -> int | str:
    """The CRS of all files: a code, or a PROJ string or well-known text."""
    codes = {options.source_crs or b["epsg"] for b in boxes}
    if len(codes) != 1 or None in codes:
        raise ValueError(f"files need one CRS, or source_crs: {sorted(map(str, codes))}")
    code = codes.pop()
    if isinstance(code, str):
        said = crs_text.parse(code)
        code = said if isinstance(said, int) else 4326 if said.method == "lonlat" and not said.shift else code
    return code


def auto_resolution(spark: SparkSession, path: str, grid: str = "h3", offset: int = 0, source_crs: int | str | None = None) -> int:
    """The resolution whose mean cell is nearest in area to a pixel on the ground, measured at the middle of the raster with the finest pixels."""
    boxes = file_boxes(spark, geotiff.resolve(path))
    finest = min(boxes, key=lambda b: b["px"] * b["py"])
    x, y = (finest["west"] + finest["east"]) / 2, (finest["south"] + finest["north"]) / 2
    corners = [(x - finest["px"] / 2, y - finest["py"] / 2), (x + finest["px"] / 2, y - finest["py"] / 2), (x - finest["px"] / 2, y + finest["py"] / 2)]
    rows = crs.with_lonlat(spark.createDataFrame([(k, *p) for k, p in enumerate(corners)], "k int, x double, y double"), _code([finest], ScanOptions(source_crs=source_crs))).orderBy("k").collect()
    if any(r["lat"] is None for r in rows):
        raise ValueError(f"the middle of {path} is off the globe")
    (lon0, lat0), (lon1, lat1), (lon2, lat2) = ((r["lon"], r["lat"]) for r in rows)
    # two sides as seen on a sphere of the earth's area
    shrunk, metres = math.cos(math.radians((lat0 + lat2) / 2)), math.radians(1) * 6371007.2
    turn = lambda a: (a + 180) % 360 - 180
    area = abs(turn(lon1 - lon0) * shrunk * (lat2 - lat0) - turn(lon2 - lon0) * shrunk * (lat1 - lat0)) * metres**2
    return grids.matched_resolution(grid, area, offset)


def resolved(spark: SparkSession, path: str, options: ScanOptions) -> ScanOptions:
    """Options with resolutions as numbers, where they say auto."""
    if not isinstance(options.resolutions, str):
        return options
    return replace(options, resolutions=(auto_resolution(spark, path, options.grid, parse_auto(options.resolutions), options.source_crs),))


def _valued(at: DataFrame, options: ScanOptions) -> DataFrame:
    """value in place of bands: of a formula, or a row for each of several bands, which `band` tells."""
    if options.formula:
        return at.withColumn("value", pixels.spectral_index(options.formula, {name: F.col(f"band_{b}") for name, b in parse_bands(options.bands, options.formula).items()}))
    if options.bands:
        bands = sorted(set(parse_bands(options.bands).values()))
        if len(bands) == 1:
            return at.withColumn("band", F.lit(bands[0]))
        return at.withColumn("_b", F.explode(F.array(*[F.struct(F.lit(b).alias("band"), F.col(f"band_{b}").alias("value")) for b in bands]))).withColumns({"band": F.col("_b.band"), "value": F.col("_b.value")}).drop("_b", *[f"band_{b}" for b in bands])
    return at


def samples(spark: SparkSession, path: str, options: ScanOptions, failures: Observation | None = None) -> DataFrame:
    """Samples (tile, col, row, lon, lat, value, weight, and band if several are asked for) of the files' pixels; NoData is null.

    Pixels that the projection has no point for are left out, counted in `failures` as `failed`, and with strict_transforms an error.
    over_poles keeps those that files in degrees have beyond a pole, at the latitude of the same sine; files own pixels before that.
    """
    paths = geotiff.resolve(path)
    boxes = file_boxes(spark, paths)
    code = _code(boxes, options)
    flat = code in (4326, 4269)
    if options.over_poles and not flat:
        raise ValueError("over_poles needs files in degrees")
    formats.register(spark)
    reader = spark.read.format("raster_pixels").option("scale_offset", str(options.scale_offset).lower()).option("pixel_size", "true")
    if isinstance(code, int):
        reader = reader.option("source_crs", code)
    names = parse_bands(options.bands, options.formula) if options.bands else {}
    reader = reader.option("bands", ",".join(str(b) for b in sorted(set(names.values())))) if names else reader.option("band", options.band)
    if options.nodata is not None:
        reader = reader.option("nodata", options.nodata)
    if options.partition:
        reader = reader.option("partition", options.partition)
    centred = options.sampling == "center"
    # what lies beyond a pole meets a box where the files' own coordinates don't
    pruned = isinstance(code, int) and not options.over_poles
    if options.bbox and pruned:
        # rows outside are left out by the source where it can tell them, chunks in any case
        reader = reader.option("bbox" if flat and centred else "lonlat_bbox", ",".join(map(repr, options.bbox)))
    if options.within is not None and pruned and not (options.bbox and not (flat and centred)):
        # a geometry's envelope tells chunks that can't meet it; what is left is tested point by point
        reader = reader.option("lonlat_bbox", ",".join(map(repr, wkb.envelope(options.within) or (0.0, 91.0, 0.0, 91.0))))
    at = _valued(reader.load(path), options)
    points = pixels.pattern(options.sampling)
    spread = F.explode(F.array(*[F.struct(F.lit(dx - 0.5).alias("dx"), F.lit(dy - 0.5).alias("dy"), F.lit(w).alias("w")) for dx, dy, w in points]))
    if centred:
        at = at.withColumn("weight", F.lit(1.0))
    else:
        at = at.withColumn("_s", spread).withColumns({"x": F.col("x") + F.col("_s.dx") * F.col("px"), "y": F.col("y") - F.col("_s.dy") * F.col("py"), "weight": F.col("_s.w")}).drop("_s")
    if len(paths) > 1 and options.overlap_rule != "average":
        if not flat and options.overlap_rule == "cutline":
            raise ValueError("cutline ownership needs files in degrees")
        at = mosaic.owned(at.withColumnsRenamed({"x": "lon", "y": "lat"}), boxes, options.overlap_rule).withColumnsRenamed({"lon": "x", "lat": "y"})
    if options.over_poles:
        at = at.withColumn("y", pixels.over_pole(F.col("y")))
    at = crs.with_lonlat(at, code, strict=options.strict_transforms, failures=failures).filter("lat is not null")
    if options.bbox:
        at = at.filter(pixels.in_bbox(F.col("lon"), F.col("lat"), options.bbox))
    if options.within is not None:
        at = at.filter(wkb.holds_point(F.col("lon"), F.col("lat"), options.within))
    return at.select("tile", "col", "row", "lon", "lat", "value", "weight", *(["band"] if names and not options.formula else []))


def _assigned(spark: SparkSession, path: str, options: ScanOptions, resolutions: list[int], failures: Observation | None) -> DataFrame:
    """Samples under their cell of each resolution, from one projection; those of a pixel that share a cell are one."""
    at, own = samples(spark, path, options, failures), grids.grid(options.grid)
    keys = ["band"] if "band" in at.columns else []
    at = at.withColumns({f"_c{r}": own.lonlat_to_cell(F.col("lon"), F.col("lat"), r) for r in resolutions})
    cells = F.array(*[F.struct(F.lit(r).alias("resolution"), F.col(f"_c{r}").alias("cell")) for r in resolutions])
    at = at.withColumn("_c", F.explode(cells)).select("tile", "col", "row", "value", "weight", *keys, "_c.resolution", "_c.cell").filter("cell IS NOT NULL")
    return at if options.sampling == "center" else pixels.combined(at, ["tile", "col", "row", "resolution", *keys], value=["value"])


def _lattice(boxes: list[dict], what: str) -> dict:
    """The one raster that files make whose pixels are on one lattice: west, south, east, north, width, height and pixel."""
    px, py, west, north = boxes[0]["px"], boxes[0]["py"], min(b["west"] for b in boxes), max(b["north"] for b in boxes)
    for b in boxes:
        steps = (b["west"] - west) / px, (north - b["north"]) / py
        if abs(b["px"] / px - 1) > 1e-9 or abs(b["py"] / py - 1) > 1e-9 or any(abs(s - round(s)) > 1e-6 for s in steps):
            raise ValueError(f"{what} needs files whose pixels are on one lattice")
    width, height = (round((max(b["east"] for b in boxes) - west) / px), round((north - min(b["south"] for b in boxes)) / py))
    return {"west": west, "south": north - height * py, "east": west + width * px, "north": north, "width": width, "height": height, "px": px, "py": py}


def _transferred(spark: SparkSession, path: str, options: ScanOptions) -> DataFrame:
    """Samples by interpolation at cell centres, or by the areas that cells have in common with pixels."""
    boxes = file_boxes(spark, geotiff.resolve(path))
    if _code(boxes, options) not in (4326, 4269):
        raise ValueError(f"{options.transfer} needs files in degrees")
    box = _lattice(boxes, options.transfer)
    origin, size, out = (box["west"], box["north"]), (box["px"], box["py"]), None
    place = {"col": F.floor((F.col("lon") - origin[0]) / size[0]), "row": F.floor((F.lit(origin[1]) - F.col("lat")) / size[1])}
    at = samples(spark, path, options).select("lon", "lat", "value").withColumns(place).filter(continuous.finite(F.col("value")) | F.col("value").isNull())
    west, south, east, north = (box[k] for k in ("west", "south", "east", "north"))
    if options.bbox:
        w, s, e, n = options.bbox
        if w > e:
            raise ValueError(f"{options.transfer} takes no box across the antimeridian")
        west, south, east, north = max(west, w), max(south, s), min(east, e), min(north, n)
    frame = spark.createDataFrame([(0, bytearray(wkb.polygon([(west, south), (east, south), (east, north), (west, north)])))], "key long, wkb binary")
    for r in options.resolutions:
        mode = "contains_centroid" if options.transfer == "interpolate" else "covers"
        cells = polyfill.polygons_to_cells(frame, r, mode, grid=options.grid).select("cell")
        if options.transfer == "interpolate":
            lon, lat = grids.center(F.col("cell"), options.grid)
            found = transfer.interpolated(cells.withColumns({"lon": lon, "lat": lat}), at, box["width"], box["height"], origin, size, options.interpolation)
            one = found.select("cell", "value", F.lit(1.0).alias("weight"))
        else:
            weighed = transfer.overlay_weights(transfer.cell_overlaps(cells, r, box["width"], box["height"], origin, size, options.grid), options.overlay_weighted, options.mass_preserve)
            one = transfer.on_pixels(weighed, at).select("cell", "value", "weight")
            if options.valid_coverage_threshold is not None:
                enough = transfer.coverage(weighed, at).filter(F.col("coverage") >= options.valid_coverage_threshold)
                one = one.join(enough.select("cell"), "cell", "left_semi")
        one = one.withColumn("resolution", F.lit(r))
        out = one if out is None else out.unionByName(one)
    return out


def _rolled(rows: DataFrame, options: ScanOptions, fine: int, coarse: int, merge) -> DataFrame:
    """Rows of a level merged to a coarser one, a few levels at a time."""
    own = grids.grid(options.grid)
    while fine > coarse:
        step = max(coarse, fine - STEP)
        rows, fine = merge(rows.withColumn("cell", own.to_parent(F.col("cell"), fine, step))), step
    return rows


def _levels(options: ScanOptions, finest: DataFrame, merge) -> DataFrame:
    """The finest level and, where the grid nests, all coarser ones, each merged from the level before."""
    order = sorted(options.resolutions, reverse=True)
    out, level = finest.withColumn("resolution", F.lit(order[0])), finest
    for fine, coarse in zip(order, order[1:], strict=False):
        level = _rolled(level, options, fine, coarse, merge)
        out = out.unionByName(level.withColumn("resolution", F.lit(coarse)))
    return out


def _written(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """Rows by way of the shared folder, so that what is made of them several times reads no file again."""
    path = scratch_path(spark, "scan")
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def scan_cells(spark: SparkSession, path: str, options: ScanOptions, failures: Observation | None = None) -> DataFrame:
    """Statistics of each cell that pixels fall in: resolution, (band,) cell, count, sum, mean, stddev, min, max, and quantiles if asked for.

    With `partition` (k/n: the k-th of n runs of chunks) mergeable states come in place of mean and stddev. Classes, remapping and
    histograms are scan_classes' and are refused. H3's cells don't nest, so each of its levels is assigned to; of other grids the
    finest is, and the rest merged from it. Work before the first result: where several things are made of the samples' states,
    these are written to the shared folder first.
    """
    options = resolved(spark, path, options)
    _refuse(options, "a scan of statistics", remap=None, histogram=None, histogram_weight="count", histogram_normalize="none", histogram_json=False, min_majority_fraction=None, extra={})
    if options.partition:
        _refuse(options, "a partitioned scan", min_count=None, min_mean=None, max_mean=None, quantiles=None, nodata_policy="omit", decimals=None)
    if options.transfer == "overlay" or options.transfer == "interpolate":
        _refuse(options, f"a scan by {options.transfer}", bands=None, nodata_policy="omit")
    if options.transfer != "overlay":
        _refuse(options, "a scan without overlay", overlay_weighted=True, mass_preserve=False, valid_coverage_threshold=None)
    if options.transfer != "interpolate":
        _refuse(options, "a scan without interpolation", interpolation="bilinear")
    nests = options.grid != "h3" and options.transfer == "assign"
    order = sorted(options.resolutions, reverse=True)
    at = _assigned(spark, path, options, order[:1] if nests else order, failures) if options.transfer == "assign" else _transferred(spark, path, options)
    weight = None if options.sampling == "center" and options.transfer != "overlay" else "weight"
    bands = ["band"] if "band" in at.columns else []
    by = [*bands, "cell"] if nests else ["resolution", *bands, "cell"]
    emit = options.nodata_policy == "emit"
    if options.quantiles or emit:
        # one aggregation by cell and bucket, NoData in a bucket of its own, has all that is asked for
        at = at.withColumns(quantiles.bucket_of(F.col("value")))
        keys = [*by, "sign", "key"]
        valid = continuous.partial_states(at.filter("sign IS NOT NULL"), keys, weight=weight)
        seen = at.filter("sign IS NULL").select(*keys).distinct() if emit else None
        base = _written(spark, valid.unionByName(seen, allowMissingColumns=True) if emit else valid)
        sketch = base.filter("count > 0").select(*keys, F.col("count").alias("w"), F.col("min").alias("lo"), F.col("max").alias("hi"))
        states = continuous.merge_states(base.filter("count > 0").drop("sign", "key"), by)
    else:
        states = continuous.partial_states(at, by, weight=weight)
        if nests and len(order) > 1:
            states = _written(spark, states)
    merge = lambda x: continuous.merge_states(x, by)
    states = _levels(options, states, merge) if nests else states
    keys = ["resolution", *bands, "cell"]
    if options.partition:
        return states.select(*keys, *continuous.STATE)
    cells = continuous.finished(_compacted(continuous.having(states, min_count=options.min_count), options))
    cells = continuous.having(cells, None, options.min_mean, options.max_mean)
    if options.quantiles:
        sketches = _levels(options, sketch, lambda x: quantiles.merged(x, by)) if nests else sketch
        cells = cells.join(quantiles.quantiles(sketches, keys, parse_quantiles(options.quantiles)), keys, "left")
    if emit:
        every = base.select(*by).distinct()
        touched = _levels(options, every, lambda x: x.select(*by).distinct()) if nests else every
        cells = continuous.emit_empty(cells, touched, keys, options.emit_nodata_value)
    if options.decimals is not None:
        cells = cells.withColumns({c: continuous.rounded(F.col(c), options.decimals) for c, t in cells.dtypes if t == "double" and c != "count"})
    return cells.select(*keys, *[c for c in cells.columns if c not in keys])


def _compacted(states: DataFrame, options: ScanOptions) -> DataFrame:
    if not options.compact:
        return states
    if options.grid != "healpix" or "band" in states.columns:
        raise ValueError("compaction is for HEALPix cells of one band")
    out = None
    for r in options.resolutions:
        own = states.filter(F.col("resolution") == r)
        own = continuous.compacted(own, healpix.cell_to_parent(F.col("cell"), r, r - 1))
        out = own if out is None else out.unionByName(own)
    return out


def scan_classes(spark: SparkSession, path: str, options: ScanOptions, failures: Observation | None = None) -> DataFrame:
    """Classes of each cell: the wide summary, or with a histogram specification the weight of each bin, or of each value ('values').

    A histogram counts pixels, or with the weight `area` takes the area (in pixels) that the cell's outline has in common with each, by an
    overlay. It can be a text (histogram_json). min_count is of a cell's total weight. Statistics' options, compaction and empty cells are refused. Files are read once: weights of
    the finest level's classes are written, and coarser levels that nest are summed from them.
    """
    options = resolved(spark, path, options)
    area = options.histogram_weight == "area"
    if not area:
        _refuse(options, "a scan of classes", transfer="assign", overlay_weighted=True, mass_preserve=False, valid_coverage_threshold=None)
    _refuse(options, "a scan of classes", compact=False, quantiles=None, min_mean=None, max_mean=None, nodata_policy="omit", emit_nodata_value=None, partition=None, formula=None, extra={}, interpolation="bilinear")
    if options.histogram:
        _refuse(options, "a histogram", min_majority_fraction=None)
    edges = parse_edges(options.histogram) if options.histogram and options.histogram != "values" else None
    nests, order = options.grid != "h3" and not area, sorted(options.resolutions, reverse=True)
    at = _transferred(spark, path, replace(options, transfer="overlay")) if area else _assigned(spark, path, options, order[:1] if nests else order, failures)
    bands = ["band"] if "band" in at.columns else []
    cls = categorical.bin_of(F.col("value"), edges) if edges else F.col("value").cast("long")
    if options.remap:
        cls = F.when(F.col("value").isNotNull(), categorical.remapped(cls, options.remap))
    by = [*bands, "cell"] if nests else ["resolution", *bands, "cell"]
    weights = categorical.class_weights(at.withColumn("cls", cls), by, weight=None if options.sampling == "center" and not area else "weight")
    if nests:
        summed = lambda x: x.groupBy(*by, "category").agg(F.sum("weight").alias("weight"))
        weights = _levels(options, _written(spark, weights) if len(order) > 1 else weights, summed)
    keys = ["resolution", *bands, "cell"]
    if options.min_count is not None:
        weights = weights.join(weights.groupBy(*keys).agg(F.sum("weight").alias("_total")).filter(F.col("_total") >= options.min_count), keys).drop("_total")
    if options.histogram == "values" and options.histogram_json:
        return categorical.values_json(weights, keys, options.histogram_normalize)
    if options.histogram == "values":
        total = weights.groupBy(*keys).agg(F.sum("weight").alias("_t"))
        out = weights.join(total, keys).withColumn("weight", F.col("weight") / F.col("_t")).drop("_t") if options.histogram_normalize == "fraction" else weights
    else:
        out = categorical.dense_bins(weights, keys, edges, options.histogram_normalize) if edges else categorical.summary(weights, keys)
    if options.histogram_json:
        return categorical.bins_json(out, keys)
    if options.min_majority_fraction is not None:
        out = out.filter(F.col("majority_fraction") >= options.min_majority_fraction)
    if options.decimals is not None:
        out = out.withColumns({c: continuous.rounded(F.col(c), options.decimals) for c, t in out.dtypes if t == "double" and c not in ("lower", "upper", "total_count", "majority_count", "weight")})
    return out
