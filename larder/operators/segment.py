"""ABC classes, SKU statistics, routing attributes and demand clusters."""

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder import config
from larder.operators.grid import days_of
from larder.operators.ordered import ranked, running_totals
from larder.session import stage

WEEKS = 52


def abc_by_volume(totals: DataFrame, shares=None) -> DataFrame:
    """Classes by rank of total units: the first share A, the next B, the rest C.

    ``totals`` has one row per SKU (``sku``, ``units``); counts are floored.
    """
    shares = shares or config.ABC_SHARES
    a = F.floor(F.col("size") * F.lit(shares["A"]))
    b = a + F.floor(F.col("size") * F.lit(shares["B"]))
    return (ranked(totals, [F.desc("units"), F.col("sku")])
            .withColumn("class", F.when(F.col("position") <= a, "A")
                        .when(F.col("position") <= b, "B").otherwise("C"))
            .drop("size"))


def revenue_shares(totals: DataFrame) -> DataFrame:
    """Running share of revenue in percent, best seller first (``sku``, ``revenue``)."""
    run = running_totals(totals, [F.desc("revenue"), F.col("sku")], {"rev": F.col("revenue")})
    return run.select("sku", "revenue", F.col("cum_rev").alias("cumulative_revenue"),
                      (F.col("cum_rev") / F.col("total_rev") * 100).alias("cumulative_pct"))


def abc_pareto(totals: DataFrame, a: float = 80, b: float = 95) -> DataFrame:
    """Classes by cumulative revenue share."""
    share = F.col("cumulative_pct")
    return revenue_shares(totals).withColumn(
        "class", F.when(share <= a, "A").when(share <= b, "B").otherwise("C"))


def sku_stats(sales: DataFrame, value: str = "qty", key: str = "sku") -> DataFrame:
    return sales.groupBy(key).agg(
        F.count(value).alias("count"), F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"))


def sku_attributes(panel: DataFrame, y: str = "y", key: str = "sku") -> DataFrame:
    """Mean, spread, maximum, zero ratio and lag-7 autocorrelation of a dense series."""
    w = Window.partitionBy(key)
    dev = panel.select(key, y, (F.col(y) - F.avg(y).over(w)).alias("_d"), "ds").withColumn(
        "_lagged", F.lag("_d", 7).over(days_of(key)))
    mean, std = F.avg(y), F.stddev_samp(y)
    return dev.groupBy(key).agg(
        mean.alias("avg_sales"), std.alias("std_sales"), F.max(y).alias("max_sales"),
        F.when(mean > 0, std / mean).otherwise(0.0).alias("coefficient_of_variation"),
        F.avg((F.col(y) == 0).cast("double")).alias("zero_sales_ratio"),
        F.try_divide(F.coalesce(F.sum(F.col("_d") * F.col("_lagged")), F.lit(0.0)),
                     F.sum(F.col("_d") * F.col("_d"))).alias("acf_lag_7"),
        F.count(F.lit(1)).alias("days"))


def sporadic(panel: DataFrame, y: str = "y", key: str = "sku",
             threshold: float = config.SPORADIC_THRESHOLD) -> DataFrame:
    """1 where the share of zero days exceeds the threshold."""
    ratio = F.avg((F.col(y) == 0).cast("double"))
    return panel.groupBy(key).agg(ratio.alias("zero_ratio"),
                                  (ratio > threshold).cast("int").alias("is_sporadic"))


def density(sales: DataFrame) -> DataFrame:
    """Days of the common span and share of days without sales per SKU, from sparse lines.

    Routing needs no dense panel: the zero days are the span minus the days with sales.
    """
    first, last = sales.agg(F.min("ds")).scalar(), sales.agg(F.max("ds")).scalar()
    daily = sales.where(F.col("sku").isNotNull()).groupBy(F.col("sku").alias("item_id"), "ds").agg(
        F.sum("qty").alias("y"))
    sold = daily.groupBy("item_id").agg(F.count(F.when(F.col("y") != 0, 1)).alias("sale_days"))
    out = sold.withColumn("days", F.datediff(last, first) + 1)
    return out.select("item_id", "days", (F.lit(1.0) - F.col("sale_days") / F.col("days")).alias("zero_sales_ratio"))


def weekly_profile(daily: DataFrame, key: str = "sku",
                   min_records: int = config.MIN_SERIES_DAYS) -> DataFrame:
    """Min-max scaled units per week of the year, over the whole history, per SKU with enough records.

    ``daily`` has one row per SKU and day with units ``y`` and ``records``. Weeks start on January 1;
    the last one takes the rest of the year.
    """
    weeks = WEEKS
    week = F.least(F.floor((F.dayofyear("ds") - 1) / 7), F.lit(weeks - 1)).cast("int")
    enough = daily.groupBy(key).agg(F.sum("records").alias("_n")).where(
        F.col("_n") >= min_records)
    kept = daily.join(enough.select(key), key, "left_semi")
    wide = kept.groupBy(key).agg(*[
        F.coalesce(F.sum(F.when(week == i, F.col("y"))), F.lit(0.0)).alias(f"w{i}")
        for i in range(weeks)])
    cols = [f"w{i}" for i in range(weeks)]
    lo, hi = F.least(*cols), F.greatest(*cols)
    return wide.select(key, *[
        F.coalesce(F.try_divide(F.col(c) - lo, hi - lo), F.lit(0.0)).alias(c) for c in cols])


def demand_clusters(profile: DataFrame, k: int = 2, key: str = "sku",
                    seed: int = config.RANDOM_SEED) -> DataFrame:
    """k-means over the weekly profiles; -1 for all when there are no more than ``k`` SKUs."""
    profile = stage(profile, "profile")  # every iteration reads it
    if len(profile.select(key).take(k + 1)) <= k:
        return profile.select(key, F.lit(-1).alias("cluster"))
    cols = [c for c in profile.columns if c != key]
    data = VectorAssembler(inputCols=cols, outputCol="features").transform(profile)
    model = KMeans(k=k, seed=seed, maxIter=20, predictionCol="cluster").fit(data)
    return model.transform(data).select(key, "cluster")
