"""Options of a raster-to-cells scan, their defaults and what may not be combined."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

GRIDS = {"h3": 15, "a5": 30, "s2": 30, "healpix": 29}
OVERLAPS = ("cutline", "first", "average")
TRANSFERS = ("assign", "interpolate", "overlay")
INTERPOLATIONS = ("nearest", "bilinear", "bicubic", "lanczos")

#: Names of quantile presets, fixed values.
QUANTILE_PRESETS = {
    "default": ("p10", "p25", "p50", "p75", "p90"),
    "box": ("p25", "p50", "p75", "iqr"),
    "tails": ("p01", "p05", "p95", "p99"),
    "deciles": ("p10", "p20", "p30", "p40", "p50", "p60", "p70", "p80", "p90"),
}
_QUANTILE_NAMES = {"median": "p50", "q1": "p25", "q2": "p50", "q3": "p75"}


def parse_bbox(text: str) -> tuple[float, float, float, float]:
    """min_lon, min_lat, max_lon, max_lat; min_lon over max_lon crosses the antimeridian."""
    parts = [float(x) for x in re.split(r"[,\s]+", text.strip("[]() \t"))]
    if len(parts) != 4 or parts[1] > parts[3]:
        raise ValueError(f"bbox needs min_lon,min_lat,max_lon,max_lat: {text!r}")
    return tuple(parts)


def parse_auto(text: str) -> int | None:
    """Steps that 'auto', 'auto+N' or 'auto-N' is finer; None for other texts. A malformed one is an error."""
    if not re.match(r"(?i)\s*auto", text):
        return None
    m = re.fullmatch(r"(?i)\s*auto\s*(?:([+-])\s*(\d{1,2}))?\s*", text)
    if not m or int(m[2] or 0) > 64:
        raise ValueError(f"expected 'auto', 'auto+N' or 'auto-N' with N up to 64: {text!r}")
    return int(f"{m[1]}{m[2]}") if m[1] else 0


def parse_resolutions(text: str | int | list[int], grid: str = "h3") -> list[int]:
    """One resolution, a list '6,8', or a range '6-8'; sorted and distinct."""
    if isinstance(text, int):
        text = [text]
    if isinstance(text, str):
        out: list[int] = []
        for part in text.split(","):
            if m := re.fullmatch(r"\s*(\d+)\s*(?:-|\.\.=?)\s*(\d+)\s*", part):
                out += range(int(m[1]), int(m[2]) + 1)
            else:
                out.append(int(part))
        text = out
    if not text or min(text) < 0 or max(text) > GRIDS[grid]:
        raise ValueError(f"resolutions of {grid} are 0 to {GRIDS[grid]}")
    return sorted(set(text))


def parse_quantiles(text: str) -> list[tuple[str, float | None]]:
    """(column name, quantile) from presets, pNN, pNN.N, decimals, median, q1..q3 and iqr (None); each name once."""
    out: dict[str, float | None] = {}
    for token in re.split(r"[,\s]+", text.strip("[]() \t").lower()):
        for name in QUANTILE_PRESETS.get(token, (token,)):
            name = _QUANTILE_NAMES.get(name, name)
            if name == "iqr":
                out.setdefault("iqr", None)
                continue
            q = float(name[1:]) / 100 if name.startswith("p") else float(name)
            if not 0 <= q <= 1:
                raise ValueError(f"quantile out of range: {token!r}")
            percent = f"{q * 100:.6f}".rstrip("0").rstrip(".")
            out.setdefault("p" + (percent if "." in percent else percent.zfill(2)).replace(".", "_"), q)
    return list(out.items())


def parse_bands(spec: str, formula: str | None = None) -> dict[str, int]:
    """Bands by name: 'nir=4,red=3' names those of a formula; '1,3' are several bands, named by their numbers."""
    out: dict[str, int] = {}
    for part in re.split(r"[,\s]+", spec.strip("[]() \t")):
        name, _, number = part.rpartition("=")
        band = int(number)
        if band < 1:
            raise ValueError(f"bands count from 1: {spec!r}")
        out[name.lower() or str(band)] = band
    if formula is not None and any(name.isdecimal() for name in out):
        raise ValueError("a formula's bands need names, as in nir=4,red=3")
    return out


def parse_edges(spec: str) -> list[float]:
    """Ascending bin edges: 'count:low:high' of equal width, or the edges themselves."""
    if ":" in spec:
        count, low, high = spec.split(":")
        n, low, high = int(count), float(low), float(high)
        edges = [low + (high - low) * k / n for k in range(n)] + [high]
    else:
        edges = [float(x) for x in spec.split(",")]
    if not 2 <= len(edges) <= 4097 or any(a >= b for a, b in zip(edges, edges[1:], strict=False)):
        raise ValueError(f"bins need 2 to 4097 ascending edges: {spec!r}")
    return edges


@dataclass(frozen=True)
class ScanOptions:
    grid: str = "h3"
    resolutions: tuple[int, ...] | str = (8,)
    band: int = 1
    bands: str | None = None
    nodata: float | None = None
    scale_offset: bool = True
    bbox: tuple[float, float, float, float] | None = None
    within: bytes | None = None
    source_crs: int | str | None = None
    sampling: str = "center"
    min_count: float | None = None
    min_mean: float | None = None
    max_mean: float | None = None
    min_majority_fraction: float | None = None
    compact: bool = False
    overlap_rule: str = "cutline"
    quantiles: str | None = None
    remap: str | None = None
    strict_transforms: bool = False
    over_poles: bool = False
    nodata_policy: str = "omit"
    emit_nodata_value: float | None = None
    decimals: int | None = None
    transfer: str = "assign"
    interpolation: str = "bilinear"
    overlay_weighted: bool = True
    mass_preserve: bool = False
    valid_coverage_threshold: float | None = None
    histogram: str | None = None
    histogram_weight: str = "count"
    histogram_normalize: str = "none"
    histogram_json: bool = False
    partition: str | None = None
    formula: str | None = None
    extra: dict = field(default_factory=dict, compare=False)

    def __post_init__(self) -> None:
        def need(ok: bool, message: str) -> None:
            if not ok:
                raise ValueError(message)

        need(self.grid in GRIDS, f"unknown grid {self.grid!r}")
        if isinstance(self.resolutions, str) and parse_auto(self.resolutions) is None:
            object.__setattr__(self, "resolutions", tuple(parse_resolutions(self.resolutions, self.grid)))
        need(self.overlap_rule in OVERLAPS, f"unknown overlap rule {self.overlap_rule!r}")
        need(self.transfer in TRANSFERS, f"unknown transfer {self.transfer!r}")
        need(self.interpolation in INTERPOLATIONS, f"unknown interpolation {self.interpolation!r}")
        need(self.nodata_policy in ("omit", "emit"), f"unknown nodata policy {self.nodata_policy!r}")
        need(self.decimals is None or 0 <= self.decimals <= 15, "decimals are 0 to 15")
        need(self.band >= 1, "bands count from 1")
        need(self.valid_coverage_threshold is None or 0 <= self.valid_coverage_threshold <= 1, "coverage is 0 to 1")
        emit = self.nodata_policy == "emit"
        need(not (emit and (self.min_count or 0) > 0), "emitted empty cells can't have a minimum count")
        need(not (emit and self.compact), "compaction can't emit empty cells")
        need(emit or self.emit_nodata_value is None, "a substitute value needs the emit policy")
        need(self.histogram_weight in ("count", "area"), f"unknown histogram weight {self.histogram_weight!r}")
        need(self.histogram_normalize in ("none", "fraction", "density"), f"unknown normalization {self.histogram_normalize!r}")
        need(self.histogram is not None or (self.histogram_weight, self.histogram_normalize, self.histogram_json) == ("count", "none", False), "a histogram's weight, normalization and text need a histogram")
        need(not (self.histogram == "values" and self.histogram_normalize == "density"), "density needs bins")
        need(self.histogram_weight == "count" or (self.transfer in ("assign", "overlay") and self.overlay_weighted), "areas need a weighted overlay")
        need(not self.formula or self.bands is not None, "a formula needs named bands")
        if self.bands is not None:
            parse_bands(self.bands, self.formula)
        if self.partition is not None:
            k, _, n = self.partition.partition("/")
            need(k.isdecimal() and n.isdecimal() and int(k) < int(n), "a partition is k/n with k from 0 to n - 1")
        need(not (self.partition and self.compact), "a partitioned scan can't be compacted")
        need(not self.compact or isinstance(self.resolutions, str) or all(b - a > 1 for a, b in zip(self.resolutions, self.resolutions[1:], strict=False)), "compaction needs resolutions that aren't adjacent")
        if self.transfer != "assign":
            need(not self.partition and not self.compact and not self.formula and self.sampling == "center", f"{self.transfer} can't be partitioned, compacted, sampled or given a formula")
        need(not self.over_poles or (self.transfer == "assign" and self.histogram_weight == "count"), "rasters that go on over a pole are taken by their samples")
        need(not self.mass_preserve or (self.transfer == "overlay" and self.overlay_weighted), "mass preservation needs a weighted overlay")
