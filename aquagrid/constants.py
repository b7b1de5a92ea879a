"""Grid description, unit factors and small configuration tables."""

from __future__ import annotations

from dataclasses import dataclass

NODATA = -9999.0

# Unit factors.
MM3_PER_AF_RASTER = 1233481837548.0   # acre-foot to cubic millimetre, gridded pumping
MM3_PER_AF_BASIN = 1233481837547.5    # the same factor as the basin reports use it
M3_PER_AF = 1233.48
AF_PER_M3 = 0.0008107132
CELL_HEIGHT_M = 2199.59
CELL_WIDTH_M = 1746.53
CELL_AREA_MM2 = (CELL_HEIGHT_M * 1000.0) * (CELL_WIDTH_M * 1000.0)
MODEL_RES_DEG = 0.01976293625031605786

# Thresholds of the cleaning and classification rules.
MAX_WELL_AF = 5000.0
MAX_PREDICTED_MM = 2000.0
IRRIGATED_FRACTION_BASIN_RANGE = 0.01
IRRIGATED_FRACTION_ELSEWHERE = 0.13
MIN_IRRIGATED_CROP_FRACTION = 0.02
GROUNDWATER_DOMINATED_PCT = 70.0
RET_BIAS_FACTOR = 0.85
SECONDS_PER_HOUR = 3600.0
OSAVI_SOIL_TERM = 0.16
CANAL_DELIVERY_FACTOR = 0.77
DISTRICT_DELIVERY_FACTOR = 0.85
RESERVOIR_AUGMENTATION_AF = 44740.50

# Record categories kept for irrigation wells.
IRRIGATION_RIGHTS = [
    "IRRIGATION USE",
    "IRRIGATION DISTRICT (GW ONLY)",
    "IRRIGATION DISTRICT (SW & GW)",
    "BEST MANAGEMENT PRACTICES FARM UNIT",
]
GROUNDWATER = "GROUNDWATER"

# Management-area names.
AREA_NAMES = {
    "DOUGLAS INA": "DOUGLAS AMA",
    "HARQUAHALA VALLEY INA": "HARQUAHALA INA",
    "JOSEPH CITY INA": "JOSEPH CITY INA",
    "PHOENIX AMA": "PHOENIX AMA",
    "PINAL AMA": "PINAL AMA",
    "PRESCOTT AMA": "PRESCOTT AMA",
    "SANTA CRUZ AMA": "SANTA CRUZ AMA",
    "TUCSON AMA": "TUCSON AMA",
}

# Land-cover codes that are not crops.
NON_CROP_CODES = [60, 61, 63, 64, 65, 81, 82, 83, 87, 88, 111, 112, 121, 122,
                  123, 124, 131, 141, 142, 143, 152, 190, 195]

# Climate class codes by group.
CLIMATE_GROUPS = {
    "arid": [4, 5, 6],
    "temperate_dry_summer": [7, 8, 9, 10],
    "temperate_no_dry_summer": [14, 15, 16, 21, 25],
    "cold": [17, 18, 19, 22, 26, 27],
}
CLIMATE_GROUP_ID = {"arid": 1, "temperate_dry_summer": 2,
                    "temperate_no_dry_summer": 3, "cold": 4}

# State codes folded into a neighbour before splitting.
STATE_FOLD = {3: 12, 1: 12}

# Basin code, name, area (m2), first year, last year, kind of reported data.
BASINS = [
    ("gmd4", "GMD4, KS", 12737667189.642, 2000, 2023, "gridded"),
    ("gmd3", "GMD3, KS", 21820149683.491, 2000, 2023, "gridded"),
    ("rpb", "Republican River Basin, CO", 22753400088.854, 2000, 2023, "gridded"),
    ("spb", "South Platte River Basin, CO", 7189173178.537, 2000, 2023, "gridded"),
    ("ar", "Arkansas River Basin, CO", 29106942834.344, 2000, 2023, "gridded"),
    ("slv", "San Luis Valley, CO", 19550637876.463, 2000, 2023, "gridded"),
    ("hqr", "Harquahala INA, AZ", 1982641859.510, 2000, 2023, "gridded"),
    ("doug", "Douglas AMA, AZ", 2459122191.981, 2000, 2023, "gridded"),
    ("phx", "Phoenix AMA, AZ", 13956271593.171, 2000, 2023, "gridded"),
    ("pnl", "Pinal AMA, AZ", 10614105343.818, 2000, 2023, "gridded"),
    ("tucs", "Tucson AMA, AZ", 10027359710.224, 2000, 2023, "gridded"),
    ("scruz", "Santa Cruz AMA, AZ", 1855467461.919, 2000, 2023, "gridded"),
    ("dv", "Diamond Valley, NV", 1933578136.225, 2000, 2023, "gridded"),
    ("pv", "Parowan Valley, UT", 1339578824.848, 2000, 2023, "withdrawals"),
    ("cdr", "Cedar Valley, UT", 1433689295.822, 2000, 2023, "withdrawals"),
    ("brl", "Beryl-Enterprise, UT", 4978562228.985, 2000, 2023, "withdrawals"),
    ("cv", "Central Valley, CA", 52592337551.544, 2000, 2023, "estimates"),
    ("srb", "Snake River Basin, ID", 39974554889.422, 2000, 2023, "estimates"),
]

# Layer, monthly reducer, scale, first month offered, end of the offered range.
LAYERS = [
    ("GRIDMET_Precip", "sum", 1.0, "1979-01-01", "2023-09-15"),
    ("GRIDMET_RET", "sum", 1.0, "1979-01-01", "2024-01-01"),
    ("GRIDMET_Tmax", "mean", 1.0, "1979-01-01", "2024-01-01"),
    ("GRIDMET_maxRH", "mean", 1.0, "1979-01-01", "2024-01-01"),
    ("GRIDMET_minRH", "mean", 1.0, "1979-01-01", "2024-01-01"),
    ("GRIDMET_windVel", "mean", 1.0, "1979-01-01", "2024-01-01"),
    ("GRIDMET_shortRad", "mean", 1.0, "1979-01-01", "2024-01-01"),
    ("GRIDMET_vpd", "mean", 1.0, "1979-01-01", "2024-01-01"),
    ("DAYMET_sunHr", "mean", 1.0, "1980-01-01", "2024-01-01"),
    ("USDA_CDL", "first", 1.0, "2008-01-01", "2022-01-01"),
    ("Tree_cover", "mean", 1.0, "2000-01-01", "2015-01-01"),
    ("spi", "mean", 1.0, "1980-01-05", "2024-12-31"),
    ("spei", "mean", 1.0, "1980-01-05", "2024-12-31"),
    ("eddi", "mean", 1.0, "1980-01-05", "2024-12-31"),
]


@dataclass(frozen=True)
class GridSpec:
    """A regular north-up grid: row 0 is the top row, col 0 the left column."""

    xmin: float
    ymax: float
    res: float
    nrows: int
    ncols: int


def basin_dim(spark):
    """The configured basins as a DataFrame."""
    return spark.createDataFrame(
        BASINS,
        "basin_code string, basin string, area_m2 double, first_year int, "
        "last_year int, kind string")


def layer_catalog(spark):
    """The monthly layers as a DataFrame: reducer, scale factor and offered dates."""
    return spark.createDataFrame(
        LAYERS, "var string, reducer string, scale double, first_date string, end_date string"
    ).selectExpr("var", "reducer", "scale", "cast(first_date as date) first_date",
                 "cast(end_date as date) end_date")
