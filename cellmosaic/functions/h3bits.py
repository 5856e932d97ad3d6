"""The parts of H3 ids that are plain bit fields: mode, resolution, base cell, digits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_RESOLUTION = 15
#: Base cells that are pentagons, fixed values.
PENTAGONS = (4, 14, 24, 38, 49, 58, 63, 72, 83, 97, 107, 117)
#: Mean cell areas in square metres by resolution, fixed values.
MEAN_AREA_M2 = (4.357e12, 6.097e11, 8.680e10, 1.239e10, 1.770e9, 2.529e8, 3.613e7, 5.161e6, 7.373e5, 1.053e5, 1.505e4, 2.150e3, 3.071e2, 4.387e1, 6.268e0, 8.954e-1)


def _long(x) -> Column:
    return F.lit(x).cast("long")


def resolution(cell: Column) -> Column:
    """Resolution of an id, -1 if it is none."""
    return F.when(is_valid(cell), F.shiftright(cell, 52).bitwiseAND(_long(15)).cast("int")).otherwise(F.lit(-1))


def base_cell(cell: Column) -> Column:
    return F.shiftright(cell, 45).bitwiseAND(_long(127)).cast("int")


def digit(cell: Column, at: int) -> Column:
    """Digit of resolution `at`, from 1."""
    return F.shiftright(cell, 3 * (15 - at)).bitwiseAND(_long(7)).cast("int")


def is_pentagon_base(cell: Column) -> Column:
    return base_cell(cell).isin(*PENTAGONS)


def is_valid(cell: Column) -> Column:
    """Mode 1, no reserved bits, a base cell of 0 to 121, digits 0 to 6 up to the resolution and 7 beyond, none in a pentagon's missing part."""
    res = F.shiftright(cell, 52).bitwiseAND(_long(15))
    ok = (F.shiftrightunsigned(cell, 59) == 1) & (F.shiftright(cell, 56).bitwiseAND(_long(7)) == 0) & (base_cell(cell) < 122)
    first = F.lit(0)
    for k in range(15, 0, -1):
        d = digit(cell, k)
        ok &= F.when(res >= k, d < 7).otherwise(d == 7)
        first = F.when((res >= k) & (d != 0), d).otherwise(first)
    return F.coalesce(ok & ~(is_pentagon_base(cell) & (first == 1)), F.lit(False))


def cell_to_parent(cell: Column, parent: int) -> Column:
    """Ancestor at a resolution that isn't finer; null otherwise."""
    finer = (1 << (3 * (15 - parent))) - 1
    cleared = cell.bitwiseAND(_long(~(15 << 52))).bitwiseOR(_long(parent << 52)).bitwiseOR(_long(finer))
    return F.when(resolution(cell) >= parent, cleared)


def expected_children(cell: Column) -> Column:
    """7, or 6 under a pentagon."""
    zeros = F.lit(True)
    for k in range(1, 16):
        zeros &= (resolution(cell) < k) | (digit(cell, k) == 0)
    return F.when(is_pentagon_base(cell) & zeros, 6).otherwise(7)
