"""Unit conversions used by the pumping and basin jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from aquagrid import constants as C
from aquagrid.functions.numeric import as_col


def af_to_mm(af, cell_area_mm2=C.CELL_AREA_MM2):
    """Acre-feet pumped in one cell to depth in mm over that cell."""
    return as_col(af) * F.lit(C.MM3_PER_AF_RASTER) / F.lit(cell_area_mm2)


def mm_to_m3(mm, cell_area_mm2=C.CELL_AREA_MM2):
    return as_col(mm) * F.lit(cell_area_mm2) / F.lit(1e9)


def m3_to_af(m3):
    return as_col(m3) / F.lit(C.M3_PER_AF)


def af_to_m3(af):
    return as_col(af) * F.lit(C.M3_PER_AF)


def af_to_mean_mm(af, area_m2):
    """Volume spread over a basin, as mean depth in mm."""
    return as_col(af) * F.lit(C.MM3_PER_AF_BASIN) / (as_col(area_m2) * F.lit(1e6))


def correct_ret(value):
    """Bias correction of reference evapotranspiration."""
    return as_col(value) * F.lit(C.RET_BIAS_FACTOR)


def seconds_to_hours(value):
    return as_col(value) / F.lit(C.SECONDS_PER_HOUR)


def doy_to_month(year, doy):
    """Calendar month of a day-of-year number."""
    start = F.make_date(as_col(year), F.lit(1), F.lit(1))
    return F.month(F.date_add(start, as_col(doy).cast("int") - 1))
