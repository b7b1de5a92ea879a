"""Basin reports."""

from __future__ import annotations

from aquagrid.operators import zonal as Z
from aquagrid.operators.algebra import stack
from pyspark.sql import functions as F


def basin_report(runs, actual, cell_basin, basins, intervals=None, basin="basin_code",
                 exclude=()):
    """Annual totals of every basin for every prediction run, with names.

    ``runs`` maps run name to its predicted layer. The run is a key of one comparison, so the
    actual layer and the basins are read once for all runs.
    """
    predicted = stack([layer.withColumn("run", F.lit(name)) for name, layer in runs.items()])
    every = F.explode(F.array(*[F.lit(name) for name in runs]))
    pixels = Z.compare_pixels(predicted, actual.withColumn("run", every), cell_basin,
                              basin=basin, by=["run"])
    totals = Z.annual_totals(pixels, basins, basin=basin, by=["run"])
    return Z.compile_basins(Z.in_year_window(totals, basins, basin, exclude), basins,
                            intervals, basin)
