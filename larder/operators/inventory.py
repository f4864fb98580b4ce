"""Safety stock, reorder points, order quantities and recommendations."""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder import config
from larder.functions import cleaning as cl


def service_level_z(cls="class", levels=None) -> Column:
    """Normal quantile of the class's service level, constants computed once on the driver."""
    levels = levels or config.SERVICE_LEVELS
    z = {c: config.z_score(p) for c, p in levels.items()}
    return cl.lookup(z, cls, z["C"])


def stock_metrics(mean: Column, std: Column, z: Column, policy: config.StockPolicy) -> dict[str, Column]:
    """Lead-time demand, safety stock, reorder point and EOQ, none below 0."""
    zero = F.lit(0.0)
    safety = z * F.coalesce(std, zero) * F.lit(math.sqrt(policy.lead_time_days))
    lead = mean * F.lit(float(policy.lead_time_days))
    annual = mean * F.lit(365.0)
    eoq = (F.when(annual > 0, F.sqrt(F.lit(2.0) * annual * F.lit(policy.ordering_cost)
                                     / F.lit(policy.holding_cost))).otherwise(zero)
           if policy.holding_cost > 0 else zero)
    return {
        "lead_time_demand": F.greatest(zero, lead),
        "safety_stock": F.greatest(zero, safety),
        "reorder_point": F.greatest(zero, lead + safety),
        "eoq": F.greatest(zero, eoq, F.lit(float(policy.min_order_qty))),
    }


def forecast_by_horizon(forecast: DataFrame, horizons=config.HORIZONS) -> DataFrame:
    """Total, mean and spread of the forecast per item and horizon.

    ``forecast`` has one row per (item_id, step) with ``mean``; negative days count as 0. All
    horizons come out of one aggregation, so the daily rows shuffle once.
    """
    y = F.greatest("mean", F.lit(0.0))
    aggs = []
    for name, days in horizons:
        within = F.when(F.col("step") <= days, y)
        aggs.append(F.struct(
            F.lit(name).alias("horizon"), F.lit(days).alias("forecast_days"),
            F.sum(within).alias("demand"), F.avg(within).alias("mu"),
            F.stddev_samp(within).alias("sigma")))
    wide = forecast.groupBy("item_id").agg(F.array(*aggs).alias("h"))
    return wide.select("item_id", F.inline("h"))


def inventory_metrics(by_horizon: DataFrame, classes: DataFrame,
                      policy: config.StockPolicy | None = None) -> DataFrame:
    """Stock metrics per item and horizon; ``classes`` maps sku to ABC class, default C."""
    policy = policy or config.StockPolicy()
    out = (by_horizon.withColumns({"sku": cl.sku_of(), "channel": cl.channel_of()})
           .join(classes.select("sku", "class"), "sku", "left")
           .withColumn("class", F.coalesce("class", F.lit("C"))))
    return out.withColumns(stock_metrics(
        F.col("mu"), F.col("sigma"), service_level_z("class", policy.service_levels), policy))


def recommendations(metrics: DataFrame) -> DataFrame:
    """The published table: rounded demand, whole units (half to even), warehouse."""
    whole = {c: F.bround(c, 0).cast("int") for c in ("safety_stock", "reorder_point", "eoq")}
    return metrics.select(
        F.col("sku").alias("item_id"), "channel",
        cl.warehouse_of("channel").alias("recommended_warehouse"),
        "horizon", "forecast_days",
        F.bround("demand", 2).alias("total_forecasted_demand"),
        *[c.alias(n) for n, c in whole.items()])


def priced_metrics(items: DataFrame, policy: config.PricedStockPolicy | None = None) -> DataFrame:
    """The price-based variant over rows of (avg_forecast, demand_std, price)."""
    p = policy or config.PricedStockPolicy()
    mean, price = F.col("avg_forecast"), F.coalesce("price", F.lit(0.0))
    lead = mean * F.lit(float(p.lead_time_days))
    safety = F.lit(config.z_score(p.service_level)) * F.col("demand_std") * F.lit(
        math.sqrt(p.lead_time_days))
    hold, order, annual = F.lit(p.holding_share) * price, F.lit(p.ordering_share) * price, mean * 365
    eoq = F.when(hold > 0, F.sqrt(F.try_divide(F.lit(2.0) * annual * order, hold))).otherwise(0.0)
    return items.withColumns({
        "lead_time_demand": lead,
        "safety_stock": safety,
        "reorder_point": lead + safety,
        "eoq": F.greatest(eoq, F.lit(p.min_order_qty)),
        "holding_cost": hold * annual,
        "ordering_cost": order,
    })


def eoq_what_if(demand: DataFrame, scenarios: list[tuple[str, float, float, int]]) -> DataFrame:
    """EOQ and reorder point of every item under each (name, order cost, holding cost, lead days).

    ``demand`` has ``annual_demand`` per row; the scenarios are a short user-given list.
    """
    cases = F.array(*[F.struct(F.lit(n).alias("scenario"), F.lit(float(s)).alias("order_cost"),
                               F.lit(float(h)).alias("hold_cost"), F.lit(t).alias("lead_days"))
                      for n, s, h, t in scenarios])
    out = demand.select("*", F.inline(cases))
    ok = (F.col("order_cost") > 0) & (F.col("hold_cost") > 0)
    return out.withColumns({
        "eoq": F.when(ok, F.sqrt(F.lit(2.0) * F.col("annual_demand") * F.col("order_cost")
                                 / F.col("hold_cost"))).otherwise(0.0),
        "reorder_point": F.col("annual_demand") / F.lit(365.0) * F.col("lead_days"),
    })
