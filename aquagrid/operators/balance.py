"""Water balances of reservoirs, rivers and districts."""

from __future__ import annotations

from pyspark.sql import functions as F

from aquagrid import constants as C
from aquagrid.functions.numeric import add_all, total_or_zero
from aquagrid.functions.units import af_to_mean_mm


def monthly_loss(et, precip, areas, key="ID", et_col="et", precip_col="ppt",
                 area_col="Area_m2"):
    """Net evaporation loss per water body and month, in mm and acre-feet. Months need both
    inputs; bodies or months without a partner in the area table stay, with missing loss."""
    both = et.select(key, "year", "month", et_col).join(
        precip.select(key, "year", "month", precip_col), [key, "year", "month"])
    joined = both.join(areas.select(key, area_col), key, "full")
    loss = F.col(et_col) - F.col(precip_col)
    return joined.withColumns({
        "net_loss_mm": loss, "net_loss_AF": loss * F.col(area_col) / 1000.0 * C.AF_PER_M3})


def annual_loss(monthly, value="net_loss_AF"):
    return (monthly.filter(F.col("year").isNotNull()).groupBy("year")
            .agg(total_or_zero(value).alias(value)))


def pivot_classes(df, keys, classes, class_col="water_class", value="annual_total"):
    """One column per class and structure-year, 0 where absent.

    The classes are given, so no extra pass looks for them. A key with two rows of the same
    class is an error.
    """
    cells = [F.coalesce(F.max(F.when(F.col(class_col) == c, F.col(value))), F.lit(0.0))
             .alias(c) for c in classes]
    repeats = [F.count_if(F.col(class_col) == c) for c in classes]
    most = F.greatest(*repeats) if len(repeats) > 1 else repeats[0]
    wide = df.groupBy(*keys).agg(*cells, most.alias("_most"))
    checked = F.when(F.col("_most") > 1,
                     F.raise_error(F.lit("repeated class within a key")).cast("double"))
    return wide.withColumn(classes[0], F.coalesce(checked, F.col(classes[0]))).drop("_most")


def annual_class_totals(wide, classes, year="year"):
    return wide.groupBy(year).agg(*[total_or_zero(c).alias(c) for c in classes])


def river_basin_total(pumping, river, reservoirs, area_m2, actual="actual_pumping_mm",
                      delivery=C.CANAL_DELIVERY_FACTOR,
                      augmentation_af=C.RESERVOIR_AUGMENTATION_AF):
    """Surface plus ground water of a river basin with canal losses.

    ``river`` has diversion_AF and recharge_AF, ``reservoirs`` has reservoir_diversion_AF
    and reservoir_release_AF, all by year; only years present in all three are kept.
    """
    y = pumping.join(river, "year").join(reservoirs, "year")
    direct = (F.col("diversion_AF") * delivery - F.col("recharge_AF")
              - F.col("reservoir_diversion_AF"))
    stored = (F.col("reservoir_release_AF") - F.lit(augmentation_af)) * delivery
    return (y.withColumns({"sw_direct_AF": direct, "sw_reservoir_AF": stored})
            .withColumn("sw_total_AF", F.col("sw_direct_AF") + F.col("sw_reservoir_AF"))
            .withColumn("sw_total_mm", af_to_mean_mm("sw_total_AF", F.lit(area_m2)))
            .withColumn("total_irrigation_mm", F.col("sw_total_mm") + F.col(actual)))


def district_total(pumping, deliveries, sources, area_m2, actual="actual_pumping_mm",
                   delivery=C.DISTRICT_DELIVERY_FACTOR):
    """Total irrigation of a district served by several surface sources."""
    y = pumping.join(deliveries, "year")
    return (y.withColumn("sw_total_AF", add_all(sources))
            .withColumn("sw_total_mm", af_to_mean_mm("sw_total_AF", F.lit(area_m2)))
            .withColumn("sw_delivered_mm", F.col("sw_total_mm") * delivery)
            .withColumn("total_irrigation_mm", F.col("sw_delivered_mm") + F.col(actual)))
