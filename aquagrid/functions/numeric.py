"""Missing-value, range and hashing expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from aquagrid.constants import NODATA


def as_col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def decode_nodata(value, nodata=NODATA):
    """Missing for NaN and for anything close to the nodata marker."""
    v = as_col(value).cast("double")
    close = F.abs(v - F.lit(nodata)) <= 1e-8 + 1e-5 * abs(nodata)
    return F.when(F.isnan(v) | close, None).otherwise(v)


def encode_nodata(value, nodata=NODATA):
    return F.coalesce(as_col(value).cast("double"), F.lit(float(nodata)))


def ratio(num, den):
    """Division that gives missing, not an error, for a zero denominator."""
    return as_col(num) / F.nullif(as_col(den).cast("double"), F.lit(0.0))


def zero_to_null(value):
    return F.nullif(as_col(value), F.lit(0))


def null_to_zero(value):
    return F.coalesce(as_col(value), F.lit(0.0))


def total_or_zero(value):
    """Sum whose all-missing group is 0."""
    return F.coalesce(F.sum(as_col(value)), F.lit(0.0))


def keep_between(value, lower, upper):
    v = as_col(value)
    return F.when(v.between(lower, upper), v)


def clamp_low(value, floor=0.0):
    v = as_col(value)
    return F.when(v.isNotNull(), F.greatest(v, F.lit(floor)))


def portable_hash(seed, *keys, digits=8):
    """Hash of seed and keys (four bits a hex digit, at most 15), the same in any engine that has md5.

    The result is never missing, and says so: a nullable join key would make Spark add a
    not-null filter that evaluates the hash once more, on rows before they are aggregated.
    """
    text = F.concat_ws("|", F.lit(str(seed)), *[as_col(k).cast("string") for k in keys])
    number = F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("bigint")
    return F.coalesce(number, F.lit(0).cast("bigint"))


def hash_slot(hashed, n):
    """Hash modulo n, never missing."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.coalesce(F.pmod(hashed, n), F.lit(0).cast("bigint"))


def recode(value, mapping):
    """Look a value up in a small fixed mapping; values not in it become missing."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.create_map(*pairs)[as_col(value)]


def first_valid(*cols):
    return F.coalesce(*[as_col(c) for c in cols])


def add_all(cols):
    return reduce(lambda a, b: a + b, [as_col(c) for c in cols])
