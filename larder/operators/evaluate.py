"""Forecast errors, rolling-origin backtests, leaderboard and champion choice."""

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder import config
from larder.operators import forecast as fc
from larder.operators.grid import days_of
from larder.session import stage


def metrics(scored: DataFrame, keys=("model", "item_id")) -> DataFrame:
    """RMSE, MAE, R2, MAPE (non-zero actuals), WAPE, sMAPE and accuracy of (y, yhat) rows.

    Every figure is a sum or mean, so one hash aggregation with map-side partials does it.
    """
    err = F.abs(F.col("y") - F.col("yhat"))
    sse = F.sum(err * err)
    sst = F.var_pop("y") * F.count("y")
    wape = F.when(F.sum(F.abs("y")) > 0, F.sum(err) / F.sum(F.abs("y")) * 100).otherwise(0.0)
    smape = F.lit(2.0) * err / (F.abs("yhat") + F.abs("y") + F.lit(1e-10))
    return scored.groupBy(*keys).agg(
        F.sqrt(F.avg(err * err)).alias("rmse"),
        F.avg(err).alias("mae"),
        F.when(sst > 0, F.lit(1.0) - sse / sst).alias("r2"),
        F.coalesce(F.avg(F.when(F.col("y") != 0, err / F.abs("y"))) * 100, F.lit(0.0)).alias("mape"),
        wape.alias("wape"),
        (F.avg(smape) * 100).alias("smape"),
        (F.lit(100.0) - wape).alias("accuracy"))


def naive_scale(series: DataFrame, season: int = config.SEASON_LENGTH,
                windows: int = config.VALIDATION_WINDOWS,
                horizon: int = config.PREDICTION_LENGTH) -> DataFrame:
    """Seasonal-naive MAE per item and validation window, on the days up to the window's cutoff."""
    last = series.agg(F.max("ds")).scalar()
    step = F.abs(F.col("y") - F.lag("y", season).over(days_of()))
    ks = F.array(*[F.lit(k) for k in range(windows)])
    back = F.datediff("_last", "ds")
    return (series.select("item_id", "ds", step.alias("_s")).withColumn("_last", last)
            .withColumn("window", F.explode(F.filter(ks, lambda k: back >= (k + 1) * horizon)))
            .groupBy("item_id", "window").agg(F.avg("_s").alias("scale")))


def mase(scored: DataFrame, series: DataFrame, windows: int = config.VALIDATION_WINDOWS,
         horizon: int = config.PREDICTION_LENGTH) -> DataFrame:
    """Mean over the windows of MAE over scale; a window with scale 0 or no history is left out."""
    mae = scored.groupBy("model", "item_id", "window").agg(
        F.avg(F.abs(F.col("y") - F.col("yhat"))).alias("mae"))
    both = mae.join(naive_scale(series, windows=windows, horizon=horizon), ["item_id", "window"], "left")
    return both.groupBy("model", "item_id").agg(
        F.avg("mae").alias("mae"), F.avg("scale").alias("scale"),
        F.avg(F.try_divide("mae", "scale")).alias("mase"))


def backtest_windows(series: DataFrame, windows: int = config.VALIDATION_WINDOWS,
                     horizon: int = config.PREDICTION_LENGTH) -> DataFrame:
    """Label the days of each rolling-origin window ``train`` or ``test``.

    Window k tests the ``horizon`` days that end k horizons before the newest date.
    """
    last = series.agg(F.max("ds")).scalar()
    ks = F.array(*[F.lit(k) for k in range(windows)])
    out = (series.withColumn("_last", last).withColumn("window", F.explode(ks))
           .withColumn("cutoff", F.date_sub("_last", (F.col("window") + 1) * horizon)))
    return (out.withColumn("part", F.when(F.col("ds") <= F.col("cutoff"), "train").otherwise("test"))
            .where(F.col("ds") <= F.date_add("cutoff", horizon)).drop("_last"))


def backtest(series: DataFrame, windows: int = config.VALIDATION_WINDOWS,
             horizon: int = config.PREDICTION_LENGTH, season: int = config.SEASON_LENGTH,
             sma_window: int = config.SMA_WINDOW) -> DataFrame:
    """Actuals and forecasts of SMA and seasonal naive in every validation window.

    Both models only need the last days before the cutoff, so each history day is exploded
    into the windows where it is a test day or one of those last days, not into all of them.
    """
    last = series.agg(F.max("ds")).scalar()
    tail = max(season, sma_window)
    back = F.datediff("_last", "ds")
    ks = F.array(*[F.lit(k) for k in range(windows)])
    rows = (series.select("item_id", "ds", "y").withColumn("_last", last)
            .withColumn("window", F.explode(F.filter(
                ks, lambda k: (back < (k + 1) * horizon + tail) & (back >= k * horizon))))
            .withColumn("cutoff", F.date_sub("_last", (F.col("window") + 1) * horizon))
            .withColumn("step", F.datediff("ds", "cutoff")))
    w = Window.partitionBy("item_id", "window")
    level = F.avg(F.when(F.col("step").between(1 - sma_window, 0), F.col("y"))).over(w)
    season_days = F.map_from_entries(F.collect_list(
        F.when(F.col("step").between(1 - season, 0),
               F.struct(F.pmod(F.col("step") - 1, F.lit(season)).alias("k"), F.col("y").alias("v")))
    ).over(w))
    out = rows.withColumns({
        "SMA": level,
        "SeasonalNaive": F.try_element_at(season_days, F.pmod(F.col("step") - 1, F.lit(season)))})
    return (out.where(F.col("step") > 0)
            .unpivot(["item_id", "window", "step", "ds", "y"], ["SMA", "SeasonalNaive"],
                     "model", "yhat").where(F.col("yhat").isNotNull()))


def backtest_gbt(series: DataFrame, windows: int = config.VALIDATION_WINDOWS,
                 horizon: int = config.PREDICTION_LENGTH, settings: fc.Boosting | None = None) -> DataFrame:
    """Backtest rows of the trees: one model of all items per window.

    Depth, rate and rounds are searched once, on the days before the oldest window that has any, so no
    window is scored with settings that saw its days.
    """
    last = series.agg(F.max("ds")).first()[0]
    if last is None:
        return _no_rows(series)
    first, scored = series.agg(F.min("ds")).first()[0], []
    for window in reversed(range(windows)):
        cutoff = last - dt.timedelta(days=(window + 1) * horizon)
        if cutoff < first:
            continue
        train = fc.gbt_training_rows(series.where(F.col("ds") <= F.lit(cutoff)), horizon)
        ahead = F.datediff("ds", F.lit(cutoff))
        test = series.withColumns({"step": ahead, "window": F.lit(window)}).where(ahead.between(1, horizon))
        train = stage(train, "gbt-window")
        if train.isEmpty():
            continue
        settings = settings or fc.search_gbt(train, horizon=horizon)[0].settings
        states = fc.gbt_future_rows(series.where(F.col("ds") <= F.lit(cutoff)), test)
        out = fc.score_gbt(fc.fit_gbt(train, settings), states)
        scored.append(_with_actuals(out.withColumn("window", F.lit(window)), test))
    return reduce(DataFrame.unionByName, scored) if scored else _no_rows(series)


def _no_rows(series: DataFrame) -> DataFrame:
    return series.select("item_id", F.lit(0).alias("window"), F.lit(0).alias("step"), "ds", "y", F.lit("GBT").alias("model"),
                         F.lit(0.0).alias("yhat")).limit(0)


def _with_actuals(forecast: DataFrame, test: DataFrame) -> DataFrame:
    actual = test.select("item_id", "window", "ds", "y")
    return forecast.withColumnRenamed("mean", "yhat").join(actual, ["item_id", "window", "ds"]).select(
        "item_id", "window", "step", "ds", "y", "model", "yhat")


def leaderboard(errors: DataFrame) -> DataFrame:
    """Mean errors per model, ranked by MASE."""
    board = errors.groupBy("model").agg(
        F.avg("mase").alias("mase"), F.avg("rmse").alias("rmse"), F.avg("wape").alias("wape"),
        F.count(F.lit(1)).alias("items"))
    # One row per model.
    order = Window.partitionBy(F.lit(1)).orderBy(F.asc_nulls_last("mase"), "model")
    return board.withColumn("rank", F.dense_rank().over(order))


def champions(errors: DataFrame, threshold: float = config.ENSEMBLE_WAPE_THRESHOLD) -> DataFrame:
    """Ensemble if an item has several valid models all below the threshold, else the best one."""
    valid = errors.where(F.col("wape").isNotNull())
    best = valid.groupBy("item_id").agg(
        F.count(F.lit(1)).alias("models"), F.max("wape").alias("worst_wape"),
        F.min(F.struct("wape", "model")).alias("_best"))
    blend = (F.col("models") > 1) & (F.col("worst_wape") < threshold)
    return best.select(
        "item_id", "models", F.col("_best.model").alias("best_model"),
        F.col("_best.wape").alias("best_wape"),
        F.when(blend, "Ensemble").otherwise(F.col("_best.model")).alias("champion"))
