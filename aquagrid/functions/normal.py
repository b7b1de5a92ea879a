"""Inverse of the standard normal distribution as a Column expression."""

from __future__ import annotations

from pyspark.sql import functions as F

from aquagrid.functions.numeric import as_col

# Coefficients of Acklam's rational approximation (relative error 1.15e-9).
_CENTRE_NUM = (-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02,
               1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00)
_CENTRE_DEN = (-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02,
               6.680131188771972e+01, -1.328068155288572e+01, 1.0)
_TAIL_NUM = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00,
             -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00)
_TAIL_DEN = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00,
             3.754408661907416e+00, 1.0)
_TAIL = 0.02425


def _poly(coeffs, x):
    out = F.lit(coeffs[0])
    for c in coeffs[1:]:
        out = out * x + F.lit(c)
    return out


def inverse_normal(p):
    """z with P(Z <= z) = p for 0 < p < 1; missing outside."""
    p = as_col(p)
    r = p - 0.5
    centre = r * _poly(_CENTRE_NUM, r * r) / _poly(_CENTRE_DEN, r * r)
    low = F.sqrt(-2 * F.log(p))
    high = F.sqrt(-2 * F.log(1 - p))
    return (F.when((p <= 0) | (p >= 1), None)
            .when(p < _TAIL, _poly(_TAIL_NUM, low) / _poly(_TAIL_DEN, low))
            .when(p > 1 - _TAIL, -_poly(_TAIL_NUM, high) / _poly(_TAIL_DEN, high))
            .otherwise(centre))
