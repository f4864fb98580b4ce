"""Model features of the daily panel.

All windows use the one spec of ``grid.days_of``, so Spark plans a single exchange and sort
for the whole set. Empty days stay null until the last projection: rolling means skip them.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.functions import cleaning as cl
from larder.operators.grid import days_of, fill_forward, previous
from larder.operators.ordered import quantiles, running_totals


def promo_flags(disc="disc", threshold="threshold") -> dict[str, Column]:
    d, t = cl.as_column(disc), F.coalesce(cl.as_column(threshold), F.lit(0.0))
    return {
        "is_on_promotion": F.coalesce((d > 0).cast("int"), F.lit(0)),
        "is_high_discount": F.coalesce((d > t).cast("int"), F.lit(0)),
    }


def discount_thresholds(rows: DataFrame) -> DataFrame:
    """75th percentile of the positive discounts per SKU.

    ``rows`` may be sales lines or days of many channels, so a SKU's group has no bound.
    """
    return quantiles(rows.where(F.col("disc") > 0), "disc", {"threshold": 0.75}, ("sku",))


def stockout_flag(c="warehouse_qty") -> Column:
    return F.coalesce((cl.as_column(c) <= 0).cast("int"), F.lit(0))


def discount_share(disc="disc", revenue="revenue") -> Column:
    d = cl.as_column(disc)
    return F.coalesce(F.try_divide(d, cl.as_column(revenue) + d), F.lit(0.0))


def lags(y: str, steps=(1, 7, 14, 30), key="item_id", prefix="sales_lag_") -> dict[str, Column]:
    return {f"{prefix}{n}": F.coalesce(F.lag(y, n).over(days_of(key)), F.lit(0.0))
            for n in steps}


def rolling_means(y: str, days=(7, 14, 30), key="item_id", prefix="sales_ma_") -> dict[str, Column]:
    return {f"{prefix}{n}": F.coalesce(F.avg(y).over(previous(n, key)), F.lit(0.0))
            for n in days}


def rolling_stds(y: str, days=(7, 30), key="item_id", prefix="sales_std_") -> dict[str, Column]:
    return {f"{prefix}{n}": F.coalesce(F.stddev_samp(y).over(previous(n, key)), F.lit(0.0))
            for n in days}


def rolling_count(condition: Column, days: int = 7, key="item_id") -> Column:
    """Days of the previous ``days`` on which ``condition`` holds."""
    flag = F.coalesce(condition.cast("int"), F.lit(0))
    return F.coalesce(F.sum(flag).over(previous(days, key)), F.lit(0))


def days_since_sale(y: str = "target", key="item_id", ds="ds") -> Column:
    """Days since the last positive sale, 0 before the first."""
    sold = F.when(F.col(y) > 0, F.col(ds))
    last = F.max(sold).over(days_of(key).rowsBetween(Window.unboundedPreceding, 0))
    return F.coalesce(F.datediff(ds, last), F.lit(0))


def history_features(panel: DataFrame, y: str = "target", stock: str = "warehouse_qty",
                     key="item_id") -> DataFrame:
    """Stock-out, trend, lag, spread and intermittency features in one window pass."""
    out = panel.withColumn("was_stocked_out", stockout_flag(stock)).withColumns({
        "stockout_days_last_7": rolling_count(F.col("was_stocked_out") == 1, 7, key),
        **rolling_means(y, key=key),
        **lags(y, (1, 7, 14, 30), key),
        **rolling_stds(y, key=key),
        "time_since_last_sale": days_since_sale(y, key),
        "days_with_sales_last_7d": rolling_count(F.col(y) > 0, 7, key),
    })
    return out.withColumn(
        "potential_lost_sales", F.col("stockout_days_last_7") * F.col("sales_ma_30"))


def scored_feedback(feedback: DataFrame) -> DataFrame:
    """Scores summed per item and instant, so rows at the same instant count together."""
    return (
        feedback.select(
            cl.item_id("selected_sku", "channel").alias("item_id"),
            F.unix_micros(F.col("timestamp").cast("timestamp")).alias("at"),
            cl.feedback_score("feedback").alias("score"))
        .dropna(subset=["item_id", "at"])
        .groupBy("item_id", "at")
        .agg(F.sum("score").alias("score"), F.count("score").alias("votes")))


def feedback_30d(feedback: DataFrame, days: int = 30) -> DataFrame:
    """Mean score over (t - ``days``, t] at every instant t with feedback.

    Each instant adds a marker at t - ``days`` to the sorted sequence; the window's totals are
    the running totals at t minus those at the marker. One item may hold any share of the rows.
    """
    width = days * 86_400_000_000
    scored = scored_feedback(feedback)
    marks = scored.select("item_id", (F.col("at") - width).alias("at"), F.lit(0.0).alias("score"),
                          F.lit(0).cast("bigint").alias("votes"), F.lit(1).alias("mark"))
    run = running_totals(
        scored.withColumn("mark", F.lit(0)).unionByName(marks),
        [F.col("at"), F.col("mark")], {"s": F.col("score"), "n": F.col("votes")}, ("item_id",))
    instant = F.col("at") + F.col("mark") * F.lit(width)
    sign = F.lit(1) - F.lit(2) * F.col("mark")
    return (run.groupBy("item_id", instant.alias("at"))
            .agg(F.sum(sign * F.col("cum_s")).alias("s"), F.sum(sign * F.col("cum_n")).alias("n"))
            .select("item_id", "at", F.timestamp_micros("at").cast("date").alias("ds"),
                    F.try_divide("s", "n").alias("feedback_score_30d_avg")))


def feedback_daily(feedback: DataFrame) -> DataFrame:
    """The day's last 30-day mean per item."""
    return (feedback_30d(feedback).groupBy("item_id", "ds")
            .agg(F.max_by("feedback_score_30d_avg", "at").alias("feedback_score_30d_avg")))


def join_feedback(panel: DataFrame, daily: DataFrame) -> DataFrame:
    """Left join on (item, day), carry the last value forward, 0 before the first."""
    out = panel.drop("feedback_score_30d_avg").join(daily, ["item_id", "ds"], "left")
    return out.withColumn("feedback_score_30d_avg", F.coalesce(
        fill_forward("feedback_score_30d_avg"), F.lit(0.0)))


def metal_inr(responses: DataFrame) -> DataFrame:
    """One row per date from the nested rates: metal price over the INR rate, 0 if rate <= 0."""
    r = responses.select(F.explode("rates").alias("date", "info"))
    inr = F.coalesce("info.currencies.INR", F.lit(0.0))

    def price(metal):
        value = F.coalesce(F.col(f"info.metals.{metal}"), F.lit(0.0))
        return F.when(inr > 0, value / inr).otherwise(0.0).alias(f"{metal}_price_inr")

    return r.select(cl.iso_day("date").alias("ds"), price("silver"), price("gold"))


def metal_features(prices: DataFrame) -> DataFrame:
    """Day-over-day change and 7-row mean of both metals.

    One row per calendar day, so the single ordered partition is bounded by the calendar. A
    change from a zero price is 0, not infinite.
    """
    one = prices.groupBy("ds").agg(*[F.max(c).alias(c) for c in prices.columns if c != "ds"])
    w = Window.partitionBy(F.lit(1)).orderBy("ds")
    out = {}
    for metal in ("silver", "gold"):
        p = F.col(f"{metal}_price_inr")
        before = F.lag(p).over(w)
        out[f"{metal}_price_change"] = F.coalesce(F.try_divide(p - before, before), F.lit(0.0))
        out[f"{metal}_price_ma_7"] = F.avg(p).over(w.rowsBetween(-6, 0))
    return one.select("ds", *[c.alias(n) for n, c in out.items()])


METAL_FILL = {"silver_price_change": 0.0, "silver_price_ma_7": 0.0,
              "gold_price_change": 0.0, "gold_price_ma_7": 0.0}


def robust_scale(df: DataFrame, columns: list[str], key: str = "item_id") -> DataFrame:
    """(x - median) / IQR per item; an IQR of 0 divides by 1. Groups are days of one item."""
    probs = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))
    q = df.groupBy(key).agg(*[F.percentile(c, probs).alias(f"_q_{c}") for c in columns])
    out = df.join(q, key)
    for c in columns:
        spread = F.col(f"_q_{c}")[2] - F.col(f"_q_{c}")[0]
        out = out.withColumn(c, (F.col(c) - F.col(f"_q_{c}")[1])
                             / F.when(spread == 0, 1.0).otherwise(spread))
    return out.drop(*[f"_q_{c}" for c in columns])
