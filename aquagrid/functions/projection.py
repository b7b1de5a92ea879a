"""UTM to geographic coordinates as Column expressions (Krueger series, GRS80)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from aquagrid.functions.numeric import as_col

# GRS80 ellipsoid and UTM constants.
_AXIS = 6378137.0
_FLATTENING = 1 / 298.257222101
_SCALE = 0.9996
_FALSE_EASTING = 500000.0

_N = _FLATTENING / (2 - _FLATTENING)
_RADIUS = _AXIS / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360,
         _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440,
         17 * _N**3 / 480 - 37 * _N**4 / 840,
         4397 * _N**4 / 161280)
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45,
          7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45,
          56 * _N**3 / 15 - 136 * _N**4 / 35,
          4279 * _N**4 / 630)


def utm_to_lonlat(easting, northing, zone=12):
    """(lon, lat) in degrees for northern-hemisphere UTM metres."""
    xi = as_col(northing) / F.lit(_SCALE * _RADIUS)
    eta = (as_col(easting) - F.lit(_FALSE_EASTING)) / F.lit(_SCALE * _RADIUS)
    xi0, eta0 = xi, eta
    for j, beta in enumerate(_BETA, start=1):
        xi0 = xi0 - F.lit(beta) * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        eta0 = eta0 - F.lit(beta) * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(xi0) / F.cosh(eta0))
    lat = chi
    for j, delta in enumerate(_DELTA, start=1):
        lat = lat + F.lit(delta) * F.sin(2 * j * chi)
    central = math.radians(zone * 6 - 183)
    lon = F.lit(central) + F.atan2(F.sinh(eta0), F.cos(xi0))
    return F.degrees(lon), F.degrees(lat)
