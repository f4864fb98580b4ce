"""Forecast models: a common contract of (model, item_id, step, ds, mean).

Every model forecasts all items in one Spark job: averages and naive as window aggregates, the trees as
one global model. The regressions are in ``regression.py``.
"""

from dataclasses import asdict, dataclass

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder import config
from larder.functions.calendar import calendar_features, cyclical_encoding, month_boundary
from larder.operators.grid import future_days, previous
from larder.operators.ordered import quantiles, ranked
from larder.session import stage


def recent(series: DataFrame, days: int) -> DataFrame:
    """The last ``days`` rows of each item with ``age`` 1 (newest) .. ``days``."""
    newest_first = Window.partitionBy("item_id").orderBy(F.desc("ds"))
    return (series.withColumn("age", F.row_number().over(newest_first))
            .where(F.col("age") <= days))


def tails(series: DataFrame, days: int, own_end: bool = False, end: Column | None = None) -> DataFrame:
    """Each item's last ``days`` daily values, newest first, as ``tail`` with its ``last_ds``.

    By default all items end on ``end``, the newest date of the table, and a day without a row counts 0,
    so sparse sales lines do as well as a dense series: one aggregation with map-side partials,
    no panel and no sort. ``own_end`` takes the last rows of each item's own (dense) history.
    """
    if own_end:
        w = recent(series, days).groupBy("item_id").agg(
            F.max("ds").alias("last_ds"), F.array_sort(F.collect_list(F.struct("age", "y"))).alias("t"))
        return w.select("item_id", "last_ds", F.transform("t", lambda r: r["y"]).alias("tail"))
    end = end if end is not None else series.agg(F.max("ds")).scalar()
    rows = series.withColumn("last_ds", end)
    rows = rows.withColumn("_age", F.datediff("last_ds", "ds") + 1)
    return rows.groupBy("item_id").agg(
        F.max("last_ds").alias("last_ds"),
        F.array(*[F.coalesce(F.sum(F.when(F.col("_age") == k, F.col("y"))), F.lit(0.0))
                  for k in range(1, days + 1)]).alias("tail"))


def _tail_mean(tail="tail"):
    total = F.aggregate(tail, F.lit(0.0), lambda acc, v: acc + v)
    return F.try_divide(total, F.size(tail))


def sma(series: DataFrame, days: int = config.PREDICTION_LENGTH,
        window: int = config.SMA_WINDOW, own_end: bool = False,
        end: Column | None = None) -> DataFrame:
    """Mean of the last ``window`` days, flat over the horizon."""
    level = tails(series, window, own_end, end).withColumn("mean", _tail_mean()).drop("tail")
    return (future_days(level, "last_ds", days)
            .select(F.lit("SMA").alias("model"), "item_id", "step", "ds", "mean"))


def sma_in_sample(series: DataFrame, window: int = config.SMA_WINDOW) -> DataFrame:
    """One-step moving average on history; 0 until the window is full."""
    full = F.count("y").over(previous(window)) == window
    return series.withColumn(
        "yhat", F.when(full, F.avg("y").over(previous(window))).otherwise(0.0))


def seasonal_naive(series: DataFrame, days: int = config.PREDICTION_LENGTH,
                   season: int = config.SEASON_LENGTH, own_end: bool = False,
                   end: Column | None = None) -> DataFrame:
    """The last season, repeated."""
    future = future_days(tails(series, season, own_end, end), "last_ds", days)
    value = F.get("tail", F.lit(season - 1) - F.pmod(F.col("step") - 1, F.lit(season)))
    return future.select(F.lit("SeasonalNaive").alias("model"), "item_id", "step", "ds",
                         value.alias("mean"))


# ---- gradient-boosted trees ---------------------------------------------------------------

ORIGIN_FEATURES = ["level_7", "level_28", "level_182", "std_28", "last_y", "zero_28"]
TARGET_FEATURES = ["step", "same_weekday", "is_holiday", "is_on_promotion", "month", "day_of_week",
                   "is_weekend", "is_wedding_season", "is_diwali_period", "is_valentine_month",
                   "is_month_start", "is_month_end", "day_of_week_sin", "day_of_week_cos",
                   "month_sin", "month_cos", "store_count", "was_stocked_out", "discount_percentage"]
KNOWN_DAYS = ["is_holiday", "is_on_promotion", "store_count", "was_stocked_out", "discount_percentage"]
GBT_FEATURES = ORIGIN_FEATURES + TARGET_FEATURES


def _origin_state(aged: DataFrame, keys: list[str]) -> DataFrame:
    """What is known at an origin: levels, spread and the last seven values by ``age`` in days.

    Plain conditional aggregates per origin; no wide window over every day.
    """
    def within(days, c="y"):
        return F.when(F.col("age") <= days, F.col(c) if isinstance(c, str) else c)

    zero = (F.col("y") == 0).cast("double")
    return aged.groupBy(*keys).agg(
        F.avg(within(7)).alias("level_7"), F.avg(within(28)).alias("level_28"),
        F.avg(within(182)).alias("level_182"),
        F.coalesce(F.stddev_samp(within(28)), F.lit(0.0)).alias("std_28"),
        F.max(F.when(F.col("age") == 1, F.col("y"))).alias("last_y"),
        F.avg(within(28, zero)).alias("zero_28"),
        F.array(*[F.coalesce(F.max(F.when(F.col("age") == k, F.col("y"))), F.lit(0.0))
                  for k in range(7, 0, -1)]).alias("week"))


def _gbt_rows(targets: DataFrame, origins: DataFrame, keys: list[str]) -> DataFrame:
    """Target rows with the state at their origin and the calendar of the target day."""
    missing = {c: F.lit(0.0) for c in KNOWN_DAYS if c not in targets.columns}
    joined = targets.withColumns(missing).join(origins, keys)
    same = F.get("week", F.pmod(F.col("step") - 1, F.lit(7)))
    return joined.withColumn("same_weekday", same).drop("week").withColumns({
        **calendar_features("ds"), **month_boundary("ds"), **cyclical_encoding("ds")})


def gbt_training_rows(series: DataFrame, horizon: int = config.PREDICTION_LENGTH) -> DataFrame:
    """Every history day as a target of the block origin before it.

    Days are cut into blocks of ``horizon`` days after the first seven; the day before a block
    is its origin and the block before it holds all the state needs. Each day is used once and
    all steps 1..horizon are covered, without chained one-step forecasts.
    """
    number = F.datediff("ds", F.min("ds").over(Window.partitionBy("item_id"))) - 7
    rows = series.withColumn("_n", number).withColumns({
        "block": F.floor(F.col("_n") / horizon).cast("int"),
        "step": (F.pmod("_n", F.lit(horizon)) + 1).cast("int")})
    origins = _origin_state(rows.withColumns({
        "block": F.col("block") + 1, "age": F.lit(horizon + 1) - F.col("step")}), ["item_id", "block"])
    return _gbt_rows(rows.where(F.col("_n") >= 0).drop("_n"), origins, ["item_id", "block"])


def gbt_future_rows(series: DataFrame, future: DataFrame, own_end: bool = False) -> DataFrame:
    """Scoring rows: the last history day, with ``own_end`` each item's own, is the origin of the whole horizon."""
    last = F.max("ds").over(Window.partitionBy("item_id")) if own_end else series.agg(F.max("ds")).scalar()
    aged = series.withColumn("age", F.datediff(last, "ds") + 1).where(F.col("age") <= 182)
    return _gbt_rows(future, _origin_state(aged, ["item_id"]), ["item_id"])


@dataclass(frozen=True)
class Boosting:
    """Settings of the trees: depth, learning rate and boosting rounds."""

    depth: int
    rate: float
    rounds: int


@dataclass(frozen=True)
class Trial:
    """Settings that were tried and their root mean squared error on the validation days."""

    settings: Boosting
    rmse: float


def _assembled(rows: DataFrame, *others: str) -> DataFrame:
    data = VectorAssembler(inputCols=GBT_FEATURES, outputCol="features").transform(rows)
    return data.select(F.col("y").alias("label"), "features", *others)


def _trees(settings: Boosting, **more) -> GBTRegressor:
    return GBTRegressor(maxIter=settings.rounds, maxDepth=settings.depth, stepSize=settings.rate, subsamplingRate=1.0,
                        seed=config.RANDOM_SEED, maxBins=32, **more)


def search_gbt(rows: DataFrame, grid=config.GBT_GRID, rounds: int = config.GBT_MAX_ROUNDS,
               horizon: int = config.PREDICTION_LENGTH) -> list[Trial]:
    """Every (depth, rate) of the grid, best first, each with the rounds at which its validation error stopped falling.

    The order of time is kept: the newest ``horizon`` days validate, all days before them train. A fit ends
    when a round no longer lowers the validation error by ``GBT_TOLERANCE`` of it.
    """
    last = rows.agg(F.max("ds")).scalar()
    parts = stage(rows.withColumn("late", F.col("ds") > F.date_sub(last, horizon)).select("y", "late", *GBT_FEATURES), "gbt-search")
    data = _assembled(parts, "late")
    if len({r.late for r in parts.select("late").distinct().collect()}) < 2:  # no day before the validation days
        return [Trial(Boosting(*grid[0], rounds=min(rounds, config.GBT_FEW_ROUNDS)), float("inf"))]
    found = []
    for depth, rate in grid:
        model = _trees(Boosting(depth, rate, rounds), validationIndicatorCol="late", validationTol=config.GBT_TOLERANCE).fit(data)
        mse = model.evaluateEachIteration(data.where("late"), "squared")
        found.append(Trial(Boosting(depth, rate, model.getNumTrees), float(mse[-1]) ** 0.5))
    return sorted(found, key=lambda t: t.rmse)


def fit_gbt(rows: DataFrame, settings: Boosting | None = None) -> GBTRegressionModel:
    """One model for all items; by default with the settings that a search on the same rows finds best."""
    rows = stage(rows.select("ds", "y", *GBT_FEATURES), "gbt")  # each round reads them
    return _trees(settings or search_gbt(rows)[0].settings).fit(_assembled(rows))


def trials_table(spark, trials: list[Trial]) -> DataFrame:
    """(depth, rate, rounds, rmse, rank) of a search."""
    return spark.createDataFrame([(*asdict(t.settings).values(), t.rmse, i + 1) for i, t in enumerate(trials)],
                                 "depth int, rate double, rounds int, rmse double, rank int")


def score_gbt(model: GBTRegressionModel, rows: DataFrame) -> DataFrame:
    data = VectorAssembler(inputCols=GBT_FEATURES, outputCol="features").transform(rows)
    return model.transform(data).select(
        F.lit("GBT").alias("model"), "item_id", "step", "ds",
        F.greatest("prediction", F.lit(0.0)).alias("mean"))


def gbt(series: DataFrame, future: DataFrame, settings: Boosting | None = None) -> DataFrame:
    return score_gbt(fit_gbt(gbt_training_rows(series), settings), gbt_future_rows(series, future))


def split_late(rows: DataFrame, horizon: int = config.PREDICTION_LENGTH) -> tuple[DataFrame, DataFrame]:
    """Training rows before the newest ``horizon`` days, and those days."""
    late = F.col("ds") > F.date_sub(rows.agg(F.max("ds")).scalar(), horizon)
    return rows.where(~late), rows.where(late)


def permutation_importance(model: GBTRegressionModel, rows: DataFrame, seed: int = config.RANDOM_SEED) -> DataFrame:
    """(feature, importance): by how much the error on held-out ``rows`` grows when a feature's values are mixed up.

    ``rows`` are those of ``gbt_training_rows``. Each row gets the values of one partner: the rows are ranked by
    item and day and by a seeded hash, and the ranks are joined. All features are scored in one job, in which
    a row stands once for each of them and once as it is.
    """
    kept = stage(rows.select("item_id", "ds", "y", *GBT_FEATURES), "permuted-rows")
    placed = ranked(kept, [F.col("item_id"), F.col("ds")]).drop("size")
    mixed = ranked(kept.withColumn("_mix", F.xxhash64("item_id", "ds", F.lit(seed))), [F.col("_mix"), F.col("item_id"), F.col("ds")])
    partners = mixed.select("position", F.struct(*GBT_FEATURES).alias("_other"))
    cases = F.explode(F.array(*[F.lit(c) for c in ("", *GBT_FEATURES)]))
    both = placed.join(partners, "position").select("*", cases.alias("feature"))
    values = {c: F.when(F.col("feature") == c, F.col(f"_other.{c}")).otherwise(F.col(c)) for c in GBT_FEATURES}
    scored = model.transform(_assembled(both.withColumns(values), "feature"))
    error = F.sqrt(F.avg((F.col("label") - F.col("prediction")) ** 2))
    errors = stage(scored.groupBy("feature").agg(error.alias("rmse")), "permuted-errors")  # a row per feature
    base = errors.where("feature = ''").select("rmse").scalar()
    return errors.where("feature <> ''").select("feature", (F.col("rmse") - base).alias("importance"))


def top_features(table: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` most important features per model of an (model, importances) table."""
    w = Window.partitionBy("model").orderBy(F.desc("importance"), "feature")
    return (table.select("model", F.inline("importances"))
            .withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n))


# ---- combination --------------------------------------------------------------------------

def horizon_bucket(step="step", days: int = 30):
    """Zero-based horizon bucket of a step."""
    return F.floor((F.col(step) - 1) / days).cast("int")


def item_scales(scored: DataFrame) -> DataFrame:
    """The mean absolute error of each model on each item; an item's residuals are measured by it."""
    return scored.groupBy("model", "item_id").agg(F.avg(F.abs(F.col("y") - F.col("yhat"))).alias("scale"))


def residual_quantiles(scored: DataFrame, scales: DataFrame, levels=config.QUANTILE_LEVELS,
                       bucket_days: int = 30) -> DataFrame:
    """Quantiles of (y - yhat) / scale per model and horizon bucket, over all items and windows.

    Divided by the item's own scale, items of all sizes share one distribution; items without an error
    are left out. A group holds every item's residuals, so the range-partitioned quantiles are used.
    """
    rows = scored.join(scales, ["model", "item_id"]).select(
        "model", horizon_bucket("step", bucket_days).alias("bucket"),
        F.try_divide(F.col("y") - F.col("yhat"), "scale").alias("residual"))
    return quantiles(rows, "residual", {f"r{round(p * 100)}": p for p in levels},
                     ("model", "bucket"))


def with_intervals(forecast: DataFrame, residuals: DataFrame, scales: DataFrame,
                   levels=config.QUANTILE_LEVELS, bucket_days: int = 30) -> DataFrame:
    """Point forecast plus the residual quantiles of its model and bucket in units of the item's scale, never below 0.

    An item without a scale has its mean as every quantile. ``residuals`` holds one row per model and bucket
    of the horizon, a handful in all.
    """
    out = (forecast.withColumn("bucket", horizon_bucket("step", bucket_days))
           .join(F.broadcast(residuals), ["model", "bucket"], "left").join(scales, ["model", "item_id"], "left"))
    names = [round(p * 100) for p in levels]
    return out.select(*forecast.columns, *[
        F.greatest(F.col("mean") + F.coalesce(F.col("scale") * F.col(f"r{n}"), F.lit(0.0)), F.lit(0.0)).alias(f"q{n}") for n in names])


def interval_coverage(scored: DataFrame, held_out: int = 0, levels=config.QUANTILE_LEVELS, bucket_days: int = 30) -> DataFrame:
    """(model, level, days, below, at_or_below): how often the days of one window fall below each quantile.

    Scales and residual quantiles come from the other windows alone. Demand is whole and often 0, so a
    quantile may hold many equal days: the level should lie between the two shares.
    """
    known, new = scored.where(F.col("window") != held_out), scored.where(F.col("window") == held_out)
    scales = stage(item_scales(known), "scales")
    rows = with_intervals(new.withColumnRenamed("yhat", "mean"), residual_quantiles(known, scales, levels, bucket_days),
                          scales, levels, bucket_days)
    sides = F.array(*[F.struct(F.lit(float(p)).alias("level"), F.col(f"q{round(p * 100)}").alias("q")) for p in levels])
    shares = rows.select("model", "y", F.inline(sides)).groupBy("model", "level")
    return shares.agg(F.count(F.lit(1)).alias("days"), F.avg((F.col("y") < F.col("q")).cast("double")).alias("below"),
                      F.avg((F.col("y") <= F.col("q")).cast("double")).alias("at_or_below"))


def ensemble_mean(forecasts: DataFrame, columns=("mean",)) -> DataFrame:
    """Plain average over models per item and day."""
    return forecasts.groupBy("item_id", "step", "ds").agg(*[F.avg(c).alias(c) for c in columns])


def ensemble_weights(metrics: DataFrame) -> DataFrame:
    """1 / (WAPE + 1e-10), normalised per item; models without a WAPE are left out.

    A partition of this window holds one row per model of an item.
    """
    raw = metrics.where(F.col("wape").isNotNull()).withColumn(
        "_w", F.lit(1.0) / (F.col("wape") + F.lit(1e-10)))
    return raw.select("item_id", "model", "wape", (
        F.col("_w") / F.sum("_w").over(Window.partitionBy("item_id"))).alias("weight"))


def ensemble_weighted(forecasts: DataFrame, weights: DataFrame) -> DataFrame:
    return (forecasts.join(weights.select("item_id", "model", "weight"), ["item_id", "model"])
            .groupBy("item_id", "step", "ds")
            .agg(F.sum(F.col("weight") * F.col("mean")).alias("mean")))


def rollup(forecast: DataFrame, lower: str = "q10", upper: str = "q90") -> DataFrame:
    """Sums over the first 30, 90 and 183 days and mean interval widths over 30 and 90."""
    width = F.greatest(F.col(upper) - F.col(lower), F.lit(0.0))
    return forecast.groupBy("item_id").agg(
        *[F.sum(F.when(F.col("step") <= d, F.col("mean"))).alias(f"forecast_next_{m}_months")
          for m, d in ((1, 30), (3, 90), (6, 183))],
        *[F.avg(F.when(F.col("step") <= d, width)).alias(f"interval_width_{m}_months")
          for m, d in ((1, 30), (3, 90))])


def route(attributes: DataFrame, min_days: int = config.MIN_SERIES_DAYS,
          threshold: float = config.SPORADIC_THRESHOLD) -> DataFrame:
    """``category`` for short or sporadic items, else ``contest``."""
    sparse = (F.col("days") < min_days) | (F.col("zero_sales_ratio") > threshold)
    return attributes.withColumn("route", F.when(sparse, "category").otherwise("contest"))


def allocate_category(category_forecast: DataFrame, sales: DataFrame, key: str = "sku") -> DataFrame:
    """Split a category forecast over its SKUs by their share of the category's past units.

    ``sales`` holds units per (key, category); the category total is summed in its own
    aggregate, so a category with very many SKUs is never gathered in one task.
    """
    total = sales.groupBy("category").agg(F.sum("units").alias("_all"))
    whole = category_forecast.groupBy("category").agg(
        F.collect_list(F.struct("step", "ds", "mean")).alias("_days"))  # one row of the horizon's length
    parts = total.join(whole, "category")
    share = F.coalesce(F.try_divide("units", "_all"), F.lit(0.0))
    # The shares are joined as one row per SKU; the days are made after the join, where the SKU is.
    return (sales.join(parts, "category").select(key, "category", share.alias("share"), F.explode("_days").alias("_d"))
            .select(key, "category", "_d.step", "_d.ds", (F.col("share") * F.col("_d.mean")).alias("mean")))
