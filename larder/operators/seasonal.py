"""Classical seasonal decomposition and seasonal strength for all items at once."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.operators.grid import days_of, dense_panel
from larder.session import stage

NEAR_ZERO = 1e-6  # stands for 0 in the multiplicative model


def decompose(series: DataFrame, period: int, model: str = "additive",
              key: str = "item_id", y: str = "y") -> DataFrame:
    """Trend, seasonal and residual of a dense daily series.

    The centred moving average comes from differences of running sums, O(1) per row for any
    period (an even period takes half weights at its ends). The sums are exact decimals with twelve
    places, so large values leave no trace in the average of small ones. Its missing ends continue the
    least-squares line through ``period`` nearby trend points; as is usual for this method, the
    line at the back leaves out the last defined point. Items with fewer than two full periods
    of days are left out.
    """
    w, whole = days_of(key), Window.partitionBy(key)
    half = period // 2
    rows = (series.select(key, "ds", F.col(y).cast("double").alias("y"))
            .withColumns({
                "i": F.row_number().over(w) - 1,
                "days": F.count(F.lit(1)).over(whole),
                "_s": F.sum(F.col("y").cast("decimal(28,12)")).over(
                    w.rowsBetween(Window.unboundedPreceding, 0))})
            .where(F.col("days") >= 2 * period))
    before = lambda n: F.coalesce(F.lag("_s", n).over(w), F.lit(0))
    if period % 2:
        total = (F.lead("_s", half).over(w) - before(half + 1)).cast("double")
    else:
        inner = F.lead("_s", half - 1).over(w) if half > 1 else F.col("_s")
        inner = (inner - before(half)).cast("double")
        total = inner + F.lit(0.5) * (F.lag("y", half).over(w) + F.lead("y", half).over(w))
    defined = (F.col("i") >= half) & (F.col("i") < F.col("days") - half)
    rows = rows.withColumn("_ma", F.when(defined, total / F.lit(float(period))))

    end = F.col("days") - 1 - half
    ahead = F.when(F.col("i") < F.least(F.lit(half + period), end), F.col("_ma"))
    behind = F.when((F.col("i") >= F.greatest(F.lit(half), end - period))
                    & (F.col("i") < end), F.col("_ma"))
    fits = {}
    for name, part in (("h", ahead), ("t", behind)):
        fits[f"_{name}k"] = F.regr_slope(part, F.col("i").cast("double")).over(whole)
        fits[f"_{name}b"] = F.regr_intercept(part, F.col("i").cast("double")).over(whole)
    trend = (F.when(F.col("i") < half, F.col("_hk") * F.col("i") + F.col("_hb"))
             .when(F.col("i") >= F.col("days") - half, F.col("_tk") * F.col("i") + F.col("_tb"))
             .otherwise(F.col("_ma")))
    rows = rows.withColumns(fits).withColumn("trend", trend).select(
        key, "ds", "y", "i", "trend", F.pmod("i", F.lit(period)).alias("phase"))

    multiplicative = model == "multiplicative"
    detrended = F.try_divide("y", "trend") if multiplicative else F.col("y") - F.col("trend")
    rows = rows.withColumn("_d", detrended)
    rows = rows.withColumn("_pm", F.avg("_d").over(Window.partitionBy(key, "phase")))
    centre = F.avg(F.when(F.col("i") < period, F.col("_pm"))).over(whole)
    seasonal = F.try_divide("_pm", centre) if multiplicative else F.col("_pm") - centre
    rows = rows.withColumn("seasonal", seasonal)
    resid = (F.try_divide("y", F.col("trend") * F.col("seasonal")) if multiplicative
             else F.col("y") - F.col("trend") - F.col("seasonal"))
    return rows.select(key, "ds", "y", "trend", "seasonal", resid.alias("resid"))


def filled_series(sales: DataFrame, method: str = "zero", model: str = "additive",
                  key: str = "item_id") -> DataFrame:
    """Dense per-item units between its own first and last day, gaps filled by ``method``."""
    daily = sales.groupBy(key, "ds").agg(F.sum("qty").alias("y"))
    fill = {"interpolate": "interpolate_back", "ffill": "ffill"}.get(method, "zero")
    out = dense_panel(daily, key, fills={"y": fill})
    if model == "multiplicative":
        out = out.withColumn("y", F.when(F.col("y") == 0, NEAR_ZERO).otherwise(F.col("y")))
    return out


def strength(series: DataFrame, period: int, model: str = "additive",
             key: str = "item_id") -> DataFrame:
    """var(seasonal) / (var(seasonal) + var(residual)); 0 for short, zero or constant series.

    A series is zero if it was before zeros were replaced; variances at the level of rounding are 0.
    """
    parts = decompose(series, period, model, key).groupBy(key).agg(
        F.var_pop("seasonal").alias("_vs"), F.var_pop("resid").alias("_vr"),
        F.sum(F.when(F.col("y") != NEAR_ZERO, F.col("y"))).alias("_sum"),
        F.avg(F.col("y") * F.col("y")).alias("_level"))
    nothing = (F.coalesce("_sum", F.lit(0.0)) == 0) | (
        F.col("_vs") + F.col("_vr") <= F.when(F.lit(model == "multiplicative"), 1.0).otherwise(F.col("_level")) * 1e-20)
    value = F.when(nothing, 0.0).otherwise(F.try_divide("_vs", F.col("_vs") + F.col("_vr")))
    known = parts.select(key, value.alias("seasonal_strength"))
    return (series.select(key).distinct().join(known, key, "left")
            .withColumn("seasonal_strength", F.coalesce("seasonal_strength", F.lit(0.0))))


def seasonal_skus(sales: DataFrame, period: int = 365, threshold: float = 0.5,
                  model: str = "additive", method: str = "zero", key: str = "sku") -> DataFrame:
    """Strength, sales statistics and the seasonal flag per SKU.

    The lines are read once: their days are staged with count, sum and sum of squares, which the statistics need.
    """
    daily = stage(sales.groupBy(key, "ds").agg(
        F.sum("qty").alias("qty"), F.count("qty").alias("n"), F.sum(F.col("qty") * F.col("qty")).alias("squares")), "seasonal-days")
    series = stage(filled_series(daily, method, model, key), "seasonal-series")
    n, total = F.sum("n"), F.sum("qty")
    spread = F.when(n > 1, F.sqrt(F.greatest(F.sum("squares") - total * total / n, F.lit(0.0)) / (n - 1)))
    stats = daily.groupBy(key).agg(n.alias("count"), F.try_divide(total, n).alias("mean"), spread.alias("std"))
    return (strength(series, period, model, key).join(stats, key)
            .withColumn("is_seasonal", (F.col("seasonal_strength") >= threshold).cast("int")))


def with_event_sales(skus: DataFrame, events: DataFrame, key: str = "sku") -> DataFrame:
    """Seasonal SKUs with their units around each event next to them; 0 where a SKU sold nothing then, and for unknown figures."""
    rest = [c for c in skus.columns if c != key] + [c for c in events.columns if c != key]
    return skus.join(events, key, "left").fillna(0, subset=rest)
