"""Promotion growth, lift against a no-promotion baseline and sales around events."""

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.operators import regression
from larder.operators.grid import previous


def sku_growth(sales: DataFrame, skus: DataFrame, start: dt.date, end: dt.date,
               before_days: int = 90) -> DataFrame:
    """Sales before and during a promotion per requested SKU, one conditional aggregation.

    ``sales`` has ds, qty, disc (percent), revenue; list price is implied from the discount.
    """
    before_from, before_to = start - dt.timedelta(days=before_days), start - dt.timedelta(days=1)
    length = (end - start).days + 1
    before = F.col("ds").between(F.lit(before_from), F.lit(before_to))
    promo = F.col("ds").between(F.lit(start), F.lit(end))
    price = F.coalesce(F.try_divide("revenue", F.col("qty") * (1 - F.col("disc") / 100)), F.lit(0.0))

    def total(when, c):
        return F.coalesce(F.sum(F.when(when, c)), F.lit(0.0))

    sums = (sales.dropna(subset=["qty", "disc", "revenue"])
            .where(F.col("ds").between(F.lit(before_from), F.lit(end)))
            .groupBy("sku").agg(
                total(before, F.col("qty")).alias("qb"), total(promo, F.col("qty")).alias("qp"),
                total(before, F.col("revenue")).alias("rb"), total(promo, F.col("revenue")).alias("rp"),
                F.avg(F.when(promo, F.col("disc"))).alias("avg_discount"),
                total(promo, F.col("qty") * price).alias("gross")))
    rows = skus.select("sku").join(sums, "sku", "left").fillna(0, subset=["qb", "qp", "rb", "rp", "gross"])
    rows = rows.withColumns({
        "avg_before": F.col("qb") / before_days if before_days > 0 else F.lit(0.0),
        "avg_promo": F.col("qp") / length if length > 0 else F.lit(0.0),
        "_rev_before": F.col("rb") / before_days if before_days > 0 else F.lit(0.0)})
    cost = F.when(F.col("avg_discount") > 0, F.col("gross") * F.col("avg_discount") / 100).otherwise(0.0)
    lift = F.col("rp") - F.col("_rev_before") * length
    return rows.select(
        "sku", F.col("avg_before").alias("avg_daily_sales_before"),
        F.col("avg_promo").alias("avg_daily_sales_promo"),
        F.when(F.col("avg_before") > 0,
               (F.col("avg_promo") - F.col("avg_before")) / F.col("avg_before") * 100
               ).otherwise(0.0).alias("growth_pct"),
        (F.col("qp") - F.col("avg_before") * length).alias("sales_lift_units"),
        lift.alias("revenue_lift"), "avg_discount",
        F.when(cost > 0, F.try_divide(lift, cost) * 100).otherwise(0.0).alias("discount_roi_pct"))


def growth_periods(growth: DataFrame) -> DataFrame:
    """The before and promotion columns as rows."""
    return growth.unpivot(["sku"], ["avg_daily_sales_before", "avg_daily_sales_promo"],
                          "period", "avg_daily_sales")


def without_promotion(panel: DataFrame) -> DataFrame:
    """The counterfactual: both promotion flags off."""
    return panel.withColumns({"is_on_promotion": F.lit(0), "is_high_discount": F.lit(0)})


def baseline(panel: DataFrame, days: int = 30) -> DataFrame:
    """No-promotion forecast per day: the mean of the previous unpromoted days, in sample."""
    plain = F.when(F.col("is_on_promotion") == 0, F.coalesce("target", F.lit(0.0)))
    return panel.withColumn(
        "forecast_no_promo", F.coalesce(F.avg(plain).over(previous(days)), F.lit(0.0)))


def flag_effects(panel: DataFrame, days: int = 30) -> DataFrame:
    """``panel`` with its recent level and, per item, a linear model of the gap to it by promotion flag.

    One aggregation fits all items; an item that is never or always promoted has no effect.
    """
    level = F.coalesce(F.avg(F.coalesce("target", F.lit(0.0))).over(previous(days)), F.lit(0.0))
    rows = panel.withColumn("level", level)
    gap, flag = F.coalesce("target", F.lit(0.0)) - F.col("level"), F.col("is_on_promotion").cast("double")
    fits = rows.groupBy("item_id").agg(F.regr_slope(gap, flag).alias("_slope"), F.regr_intercept(gap, flag).alias("_base"),
                                       F.avg(gap).alias("_mean"))
    fits = fits.select("item_id", F.coalesce("_slope", F.lit(0.0)).alias("promo_effect"),
                       F.when(F.col("_slope").isNull(), F.col("_mean")).otherwise(F.col("_base")).alias("plain_gap"))
    return rows.join(fits, "item_id")


def scored_by_flag(fitted: DataFrame) -> DataFrame:
    """The model's forecast under the flags that the rows hold now, never below 0."""
    value = F.col("level") + F.col("plain_gap") + F.col("promo_effect") * F.col("is_on_promotion")
    return fitted.withColumn("forecast", F.greatest(value, F.lit(0.0)))


def lift(actual: DataFrame, forecast: DataFrame) -> DataFrame:
    """Units above the no-promotion forecast on promoted days, per item."""
    both = (actual.where(F.col("is_on_promotion") == 1)
            .select("item_id", "ds", F.col("target").alias("actual"))
            .join(forecast.select("item_id", "ds", "forecast_no_promo"), ["item_id", "ds"]))
    return _lift_totals(both)


def _lift_totals(rows: DataFrame) -> DataFrame:
    sums = rows.groupBy("item_id").agg(
        F.sum("actual").alias("total_actual_sales"),
        F.sum("forecast_no_promo").alias("total_forecast_no_promo"),
        F.sum(F.col("actual") - F.col("forecast_no_promo")).alias("total_lift_units"))
    base = F.when(F.col("total_forecast_no_promo") == 0, 1.0).otherwise(F.col("total_forecast_no_promo"))
    return sums.withColumn("percentage_lift", F.col("total_lift_units") / base * 100)


def lift_in_sample(panel: DataFrame, days: int = 30, lookback: int = 184) -> DataFrame:
    """Lift of the last ``lookback`` days against the in-sample baseline, without a self join."""
    last = panel.agg(F.max("ds")).scalar()
    rows = baseline(panel, days).where(
        (F.col("ds") >= F.date_sub(last, lookback - 1)) & (F.col("is_on_promotion") == 1))
    return _lift_totals(rows.withColumn("actual", F.coalesce("target", F.lit(0.0))))


PROMOTION = regression.Design(waves=((365.25, 3), (7.0, 3)), ridge=0.1, name="NoPromotion", regressors=(
    "is_on_promotion", "is_high_discount", "is_holiday", "was_stocked_out"))


def cross_fitted_baseline(panel: DataFrame, design: regression.Design = PROMOTION, folds: int = 5) -> DataFrame:
    """``panel`` with ``forecast_no_promo``: each day under a model that never saw it, both promotion flags off.

    The days are dealt to folds by week, and a fold is scored by the fit on all others.
    """
    rows = panel.withColumn("y", F.coalesce("target", F.lit(0.0)))
    flags = tuple(c for c in design.regressors if c in ("is_on_promotion", "is_high_discount"))
    scored = regression.cross_fitted(rows.select("item_id", "ds", "y", *[c for c in design.regressors if c in rows.columns],
                                                 F.col("is_on_promotion").alias("promoted")), design, folds, cleared=flags)
    return scored.select("item_id", "ds", F.col("y").alias("target"), F.col("promoted").alias("is_on_promotion"),
                         F.col("mean").alias("forecast_no_promo"))


def lift_cross_fitted(panel: DataFrame, lookback: int = 184, design: regression.Design = PROMOTION) -> DataFrame:
    """Lift of the last ``lookback`` days against the cross-fitted baseline; the model learns from the whole panel."""
    last = panel.agg(F.max("ds")).scalar()
    rows = cross_fitted_baseline(panel, design).where(
        (F.col("ds") >= F.date_sub(last, lookback - 1)) & (F.col("is_on_promotion") == 1))
    return _lift_totals(rows.withColumn("actual", F.col("target")))


def event_sales(sales: DataFrame, events: list[tuple[str, dt.date, int, int]],
                key: str = "sku") -> DataFrame:
    """Units per SKU inside each event's window, one column per event, 0 where none.

    ``events`` is the user's short list of (name, date, days before, days after). Conditional
    sums in one aggregation replace a range join per event; every SKU is listed.
    """
    def inside(e):
        return F.col("ds").between(F.lit(e[1] - dt.timedelta(days=e[2])),
                                   F.lit(e[1] + dt.timedelta(days=e[3])))
    return sales.groupBy(key).agg(*[
        F.coalesce(F.sum(F.when(inside(e), F.col("qty"))), F.lit(0.0)).alias(f"{e[0]}_sales")
        for e in events])
