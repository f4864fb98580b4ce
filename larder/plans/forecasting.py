"""Composed forecasting: recommendations, model contest, sparse routing and upload scoring."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder import config
from larder.functions import cleaning as cl
from larder.operators import evaluate as ev
from larder.operators import forecast as fc
from larder.operators import grid, inventory, regression, segment
from larder.operators import sales as sl
from larder.session import stage
from larder.sources import sinks
from larder.sources.artefacts import SavedModel

MASTER_ERRORS = ("rmse", "mae", "mape", "wape", "r2")


def item_series(sales: DataFrame) -> DataFrame:
    """Dense daily units per SKU and channel over the common span, empty days 0."""
    daily = (sales.where(F.col("sku").isNotNull()).withColumn("item_id", cl.item_id())
             .groupBy("item_id", "ds").agg(F.sum("qty").alias("y")))
    return _dense(daily, sales)


def item_lines(sales: DataFrame) -> DataFrame:
    """Sales lines keyed by item, enough for the models that only need the last days."""
    return sales.where(F.col("sku").isNotNull()).select(
        cl.item_id().alias("item_id"), "ds", F.col("qty").alias("y"))


def sku_series(sales: DataFrame) -> DataFrame:
    """The same at SKU grain, with the SKU as item id."""
    daily = (sales.where(F.col("sku").isNotNull())
             .groupBy(F.col("sku").alias("item_id"), "ds").agg(F.sum("qty").alias("y")))
    return _dense(daily, sales)


def dense_units(lines: DataFrame, span_of: DataFrame) -> DataFrame:
    """Daily units per item of (item_id, ds, y) rows on every day that ``span_of`` covers, empty days 0."""
    return _dense(lines.groupBy("item_id", "ds").agg(F.sum("y").alias("y")), span_of)


def _dense(daily: DataFrame, sales: DataFrame) -> DataFrame:
    return grid.dense_panel(daily, span=grid.day_span(sales), fills={"y": "zero"})


def volume_classes(sales: DataFrame) -> DataFrame:
    totals = sales.where(F.col("sku").isNotNull()).groupBy("sku").agg(F.sum("qty").alias("units"))
    return segment.abc_by_volume(totals)


def daily_units(sales: DataFrame) -> DataFrame:
    """Units per SKU, channel and day, staged: enough for forecasts, classes and totals."""
    return stage(sales.groupBy("sku", "channel", "ds").agg(F.sum("qty").alias("qty")), "daily-units")


def recommend(sales: DataFrame, forecast: DataFrame | None = None,
              policy: config.StockPolicy | None = None) -> DataFrame:
    """Recommendations per item and horizon from a forecast, by default the seasonal naive.

    The lines are read once: forecast and classes both start from the staged daily units.
    """
    daily = daily_units(sales)
    forecast = forecast if forecast is not None else fc.seasonal_naive(item_lines(daily))
    table = inventory.forecast_by_horizon(forecast)
    return inventory.recommendations(
        inventory.inventory_metrics(table, volume_classes(daily), policy))


def backtested(series: DataFrame, fitted: bool = False,
               windows: int = config.VALIDATION_WINDOWS) -> tuple[DataFrame, DataFrame]:
    """The staged series and the staged backtest rows of its models.

    ``fitted`` adds the harmonic regression and the trees; the series then needs the flags of the days.
    """
    series = stage(series, "series")
    rows = ev.backtest(series, windows)
    if fitted:
        rows = (rows.unionByName(regression.backtest(series, windows, design=regression.REGRESSORS))
                .unionByName(ev.backtest_gbt(series, windows)))
    return series, stage(rows, "backtest")


def model_errors(series: DataFrame, scored: DataFrame) -> DataFrame:
    """All errors per model and item, MASE included."""
    return ev.metrics(scored).join(ev.mase(scored, series).select("model", "item_id", "mase"), ["model", "item_id"])


def champion_forecast(series: DataFrame, future: DataFrame | None = None,
                      windows: int = config.VALIDATION_WINDOWS) -> DataFrame:
    """Each item's champion, or the error-weighted blend, over the horizon.

    With ``future`` (the horizon with the flags of its days) all four models compete, else the two
    that need no fit.
    """
    series, scored = backtested(series, future is not None, windows)
    errors = stage(ev.metrics(scored), "errors")
    models = fc.sma(series).unionByName(fc.seasonal_naive(series))
    if future is not None:
        models = (models.unionByName(regression.forecast(series, future, regression.REGRESSORS))
                  .unionByName(fc.gbt(series, future)))
    return champion_rows(stage(models, "models"), errors)


def blended_backtest(scored: DataFrame, errors: DataFrame) -> DataFrame:
    """The backtest rows of all models and of their error-weighted blend, as model ``Ensemble``."""
    weights = fc.ensemble_weights(errors).select("item_id", "model", "weight")
    blend = scored.join(weights, ["item_id", "model"]).groupBy("item_id", "window", "step", "ds", "y").agg(
        F.sum(F.col("weight") * F.col("yhat")).alias("yhat"))
    return scored.unionByName(blend.withColumn("model", F.lit("Ensemble")).select(*scored.columns))


def champion_rows(models: DataFrame, errors: DataFrame) -> DataFrame:
    """The forecast of each item's champion among ``models``, or their error-weighted blend."""
    pick = ev.champions(errors).select("item_id", "champion")
    weights = fc.ensemble_weights(errors)
    blend = fc.ensemble_weighted(models, weights).withColumn("model", F.lit("Ensemble"))
    return (models.unionByName(blend).join(
        pick.withColumnRenamed("champion", "model"), ["item_id", "model"])
        .select("item_id", "model", "step", "ds", "mean"))


def sku_master(sales: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """One row per SKU: attributes, class, errors per model and of the champion, roll-ups, interval widths and stock figures.

    ``champion_<error>`` is the backtest error of the model or blend that makes the forecast; ``ci_width_<days>d`` is the mean distance
    between its outer quantiles over the first days. Rows of ``previous`` stay where the SKU was not sold in ``sales``.
    """
    daily = stage(sales.where(F.col("sku").isNotNull()).groupBy("sku", "ds").agg(F.sum("qty").alias("qty")), "daily-units")
    series, scored = backtested(sku_series(daily))
    errors = stage(ev.metrics(scored), "errors")
    models = stage(fc.sma(series).unionByName(fc.seasonal_naive(series)), "models")
    blended = stage(blended_backtest(scored, errors), "blended")
    scales = stage(fc.item_scales(blended), "scales")
    ahead = fc.with_intervals(champion_rows(models, errors), fc.residual_quantiles(blended, scales), scales)
    low, high = (f"q{round(p * 100)}" for p in (config.QUANTILE_LEVELS[0], config.QUANTILE_LEVELS[-1]))
    rolls = stage(ahead.groupBy("item_id").agg(
        F.max("model").alias("champion"), F.avg("mean").alias("avg_forecast"),
        *[F.sum(F.when(F.col("step") <= d, F.col("mean"))).alias(f"forecast_{d}d") for _, d in config.HORIZONS],
        *[F.avg(F.when(F.col("step") <= d, F.col(high) - F.col(low))).alias(f"ci_width_{d}d") for _, d in config.HORIZONS[:2]]), "rolls")
    of_model = errors.groupBy("item_id").agg(*[
        F.max(F.when(F.col("model") == m, F.col(e))).alias(f"{e}_{m.lower()}") for m in ("SMA", "SeasonalNaive") for e in MASTER_ERRORS])
    of_champion = ev.metrics(blended).join(rolls.select("item_id", F.col("champion").alias("model")), ["item_id", "model"]).select(
        "item_id", *[F.col(e).alias(f"champion_{e}") for e in MASTER_ERRORS])
    seen = series.groupBy(F.col("item_id").alias("sku")).agg(F.max("ds").alias("last_processed_date"))
    attributes = segment.sku_attributes(series.withColumnRenamed("item_id", "sku"))
    price = sales.groupBy("sku").agg(F.avg(F.try_divide("revenue", "qty")).alias("price"))
    rows = (attributes.join(volume_classes(daily).select("sku", "class"), "sku", "left").join(price, "sku", "left")
            .join(rolls.join(of_model, "item_id").join(of_champion, "item_id").withColumnRenamed("item_id", "sku"), "sku", "left")
            .join(seen, "sku", "left")
            .withColumn("demand_std", F.col("std_sales")))
    new = inventory.priced_metrics(rows).drop("demand_std", "holding_cost", "ordering_cost").withColumnRenamed("sku", "sku_id")
    return new if previous is None else sinks.upserted(previous, new, ["sku_id"]).select(*new.columns)


def category_level(sales: DataFrame, windows: int = config.VALIDATION_WINDOWS) -> DataFrame:
    """The champion of each category's own contest over the horizon, staged: category, step, ds, mean.

    A category without a SKU of enough records has no series and no forecast.
    """
    daily = stage(sl.category_series(sales).withColumnRenamed("category", "item_id"), "category-days")
    level = champion_forecast(_dense(daily, sales), windows=windows)
    return stage(level.select(F.col("item_id").alias("category"), "step", "ds", "mean"), "category-forecast")


def category_forecast(sales: DataFrame, level: DataFrame | None = None) -> DataFrame:
    """The categories' forecast, by default their champions', shared out to all their SKUs by past units.

    The shares of a category add up to 1, so its SKUs add up to its forecast.
    """
    units = (sales.groupBy("sku").agg(F.sum("qty").alias("units"))
             .withColumn("category", cl.sku_category()).where(F.col("category").isNotNull()))
    return fc.allocate_category(level if level is not None else category_level(sales), units)


def routed_forecast(sales: DataFrame) -> DataFrame:
    """Contest for dense SKUs, category share for sparse ones, moving average where neither fits.

    The lines are read once, for the staged days that all routes start from. Only SKUs of the contest get a
    dense series; the others are forecast from sparse days.
    """
    sales = sales.where(F.col("sku").isNotNull())
    sales = stage(sales.groupBy("sku", "ds").agg(F.sum("qty").alias("qty"), F.count(F.lit(1)).alias("records")), "routed-days")
    routes = stage(fc.route(segment.density(sales)).select("item_id", "route"), "routes")
    picked = routes.where(F.col("route") == "contest").select(F.col("item_id").alias("sku"))
    sparse = routes.where(F.col("route") == "category").select("item_id")
    contest_sales = sales.join(picked, "sku", "left_semi")
    daily = contest_sales.groupBy(F.col("sku").alias("item_id"), "ds").agg(F.sum("qty").alias("y"))
    dense = stage(_dense(daily, sales), "series")
    cols = ["item_id", "model", "step", "ds", "mean"]
    shared = stage(category_forecast(sales).select(
        F.col("sku").alias("item_id"), F.lit("Category").alias("model"), "step", "ds", "mean"
    ).join(sparse, "item_id", "left_semi"), "shared")
    rest = sparse.join(shared.where(F.col("step") == 1), "item_id", "left_anti")
    lines = sales.select(F.col("sku").alias("item_id"), "ds", F.col("qty").alias("y"))
    alone = fc.sma(lines.join(rest, "item_id", "left_semi"), end=sales.agg(F.max("ds")).scalar())
    return (champion_forecast(dense).select(*cols).unionByName(shared.select(*cols))
            .unionByName(alone.select(*cols)))


def upload_forecast(panel: DataFrame, horizon: int = config.PREDICTION_LENGTH, model: SavedModel | None = None) -> DataFrame:
    """Score an enriched upload: whole-unit forecast, and errors of a backtest or why there is none.

    ``model`` is the champion's saved model; nothing is fitted. Items that it cannot score, and all items without it, are
    forecast by the moving average. A series longer than the horizon is also forecast from the days before
    its last ``horizon`` points and scored on them. One aggregate per item does for the moving average, so
    long and short series share a plan.
    """
    series = panel.select("item_id", "ds", F.col("target").alias("y"))
    points = series.groupBy("item_id").agg(F.count(F.lit(1)).alias("points"))
    reason = F.when(F.col("points") <= horizon, F.concat(
        F.lit("history of "), F.col("points").cast("string"),
        F.lit(f" points is not longer than the horizon of {horizon}")))
    out, errors = fc.sma(series, horizon, own_end=True), upload_errors(series, horizon)
    if model is not None and model.name != "SMA":
        days = panel.select("ds", *[c for c in fc.KNOWN_DAYS if c in panel.columns])
        scored = stage(model.score(series, horizon, days), "upload-scored")
        known = scored.select("item_id").distinct()
        out = scored.unionByName(out.join(known, "item_id", "left_anti"))
        errors = model_upload_errors(series, model, horizon, days).unionByName(errors.join(known, "item_id", "left_anti"))
    return (out.withColumn("units", cl.units("mean")).join(points, "item_id").withColumn("backtest_skipped", reason)
            .join(errors, "item_id", "left"))


def model_upload_errors(series: DataFrame, model: SavedModel, horizon: int, days: DataFrame | None = None) -> DataFrame:
    """MAE and WAPE of a saved model on the last ``horizon`` points of each longer series, scored from the points before."""
    newest_first = Window.partitionBy("item_id").orderBy(F.desc("ds"))
    aged = stage(series.withColumn("age", F.row_number().over(newest_first)), "upload-aged")
    ahead = model.score(aged.where(F.col("age") > horizon).drop("age"), horizon, days)
    late = aged.where(F.col("age") <= horizon).join(ahead.select("item_id", "ds", F.col("mean").alias("yhat")), ["item_id", "ds"])
    return ev.metrics(late, ("item_id",)).select("item_id", "mae", "wape")


def upload_errors(series: DataFrame, horizon: int = config.PREDICTION_LENGTH) -> DataFrame:
    """MAE and WAPE of the moving average on the last ``horizon`` points of each longer series."""
    newest_first = Window.partitionBy("item_id").orderBy(F.desc("ds"))
    aged = series.withColumn("age", F.row_number().over(newest_first))
    known = F.when((F.col("age") > horizon) & (F.col("age") <= horizon + config.SMA_WINDOW), F.col("y"))
    rows = aged.withColumn("yhat", F.avg(known).over(Window.partitionBy("item_id")))
    scored = rows.where((F.col("age") <= horizon) & F.col("yhat").isNotNull())
    return ev.metrics(scored, ("item_id",)).select("item_id", "mae", "wape")
