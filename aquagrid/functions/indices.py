"""Band arithmetic and quality masks on band columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from aquagrid.constants import NON_CROP_CODES, OSAVI_SOIL_TERM
from aquagrid.functions.numeric import as_col, ratio


def scaled(band, scale=1.0, offset=0.0):
    return as_col(band) * F.lit(float(scale)) + F.lit(float(offset))


def normalised_difference(a, b):
    """(a-b)/(a+b): vegetation index from NIR and red, moisture index from NIR and SWIR."""
    a, b = as_col(a), as_col(b)
    return ratio(a - b, a + b)


def osavi(nir, red):
    nir, red = as_col(nir), as_col(red)
    return ratio(nir - red, nir + red + F.lit(OSAVI_SOIL_TERM))


def gcvi(nir, green):
    return ratio(nir, green) - 1.0


def bit_field_clear(qa, from_bit, to_bit):
    """True where the bits from_bit..to_bit, read as a number, are at most 1."""
    mask = (1 << (to_bit - from_bit + 1)) - 1
    return F.shiftright(as_col(qa), from_bit).bitwiseAND(F.lit(mask)) <= 1


def bits_unset(qa, bits=(3, 4)):
    """True where none of the given bits is set."""
    mask = sum(1 << b for b in bits)
    return as_col(qa).bitwiseAND(F.lit(mask)) == 0


def is_crop(code, non_crop=NON_CROP_CODES):
    return ~as_col(code).isin(list(non_crop))
