"""Forecast models, backtests, combination, routing and model-based reports."""

import re

from pyspark.sql import functions as F

from catalog import views as v
from catalog.base import query, r, rounded
from larder import config
from larder.functions import cleaning as cl
from larder.operators import evaluate as ev
from larder.operators import features as ft
from larder.operators import forecast as fc
from larder.operators import grid, regression, segment
from larder.operators import sales as sl
from larder.plans import forecasting as plan
from larder.session import stage

# SQL twins of the rolling-origin backtest on the SKU series.
BT = {
    "bt_rows": "SELECT s.item_id, s.ds, s.y, w.win, CAST(date_diff('day', last, s.ds) + (w.win + 1) * 183 AS INTEGER) AS step "
               "FROM sku_series s, (SELECT max(ds) AS last FROM sku_series), (SELECT CAST(unnest(generate_series(0, 4)) AS INTEGER) AS win) w",
    "bt_level": "SELECT item_id, win, avg(y) AS level FROM bt_rows WHERE step BETWEEN -6 AND 0 GROUP BY 1, 2",
    "bt": "SELECT b.item_id, b.win, b.step, b.ds, b.y, 'SMA' AS model, l.level AS yhat FROM bt_rows b JOIN bt_level l USING (item_id, win) "
          "WHERE b.step BETWEEN 1 AND 183 UNION ALL SELECT b.item_id, b.win, b.step, b.ds, b.y, 'SeasonalNaive', h.y FROM bt_rows b JOIN bt_rows h "
          "ON h.item_id = b.item_id AND h.win = b.win AND h.step = (b.step - 1) % 7 - 6 WHERE b.step BETWEEN 1 AND 183",
    "errors": "SELECT model, item_id, sqrt(avg((y - yhat) ** 2)) AS rmse, avg(abs(y - yhat)) AS mae, "
              "CASE WHEN var_pop(y) > 0 THEN 1 - sum((y - yhat) ** 2) / (var_pop(y) * count(y)) END AS r2, "
              "coalesce(avg(CASE WHEN y <> 0 THEN abs(y - yhat) / abs(y) END) * 100, 0) AS mape, "
              "CASE WHEN sum(abs(y)) > 0 THEN sum(abs(y - yhat)) / sum(abs(y)) * 100 ELSE 0 END AS wape, "
              "avg(2 * abs(y - yhat) / (abs(yhat) + abs(y) + 1e-10)) * 100 AS smape FROM bt GROUP BY 1, 2",
    "season_steps": "SELECT item_id, ds, abs(y - lag(y, 7) OVER (PARTITION BY item_id ORDER BY ds)) AS d FROM sku_series",
    "scale": "SELECT b.item_id, b.win, avg(s.d) AS scale FROM bt_rows b JOIN season_steps s USING (item_id, ds) WHERE b.step <= 0 GROUP BY 1, 2",
    "mase_rows": "SELECT model, item_id, avg(mae) AS mae, avg(scale) AS scale, avg(mae / nullif(scale, 0)) AS mase FROM (SELECT model, item_id, win, "
                 "avg(abs(y - yhat)) AS mae FROM bt GROUP BY 1, 2, 3) LEFT JOIN scale USING (item_id, win) GROUP BY 1, 2",
    "bt_weights": "SELECT item_id, model, wape, (1 / (wape + 1e-10)) / sum(1 / (wape + 1e-10)) OVER (PARTITION BY item_id) AS weight FROM errors",
    "sku_level": "SELECT item_id, avg(y) AS mean, max(ds) AS last_ds FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY ds DESC) AS age "
                 "FROM sku_series) WHERE age <= 7 GROUP BY 1",
    "sku_sma": "SELECT 'SMA' AS model, item_id, CAST(step AS INTEGER) AS step, CAST(last_ds + CAST(step AS INTEGER) AS DATE) AS ds, mean "
               "FROM sku_level, (SELECT unnest(generate_series(1, 183)) AS step)",
    "sku_naive": "SELECT 'SeasonalNaive' AS model, f.item_id, f.step, f.ds, h.y AS mean FROM sku_sma f JOIN "
                 "(SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY ds DESC) AS age FROM sku_series) h "
                 "ON h.item_id = f.item_id AND h.age = 7 - (f.step - 1) % 7",
    "sku_models": "SELECT * FROM sku_sma UNION ALL SELECT * FROM sku_naive",
}


def sku_series(spark, sf):
    return plan.sku_series(v.family(spark, sf))


def sku_lines(spark, sf):
    return v.family(spark, sf).select(F.col("sku").alias("item_id"), "ds", F.col("qty").alias("y"))


def sku_models(spark, sf):
    lines = sku_lines(spark, sf)
    return fc.sma(lines).unionByName(fc.seasonal_naive(lines))


def errors(spark, sf):
    return ev.metrics(ev.backtest(sku_series(spark, sf)))


@query("forecast_sma", v.sql("SELECT * FROM sma"))
def forecast_sma(spark, sf):
    return fc.sma(plan.item_lines(v.family(spark, sf)))


@query("forecast_sma_in_sample", v.sql(
    "SELECT item_id, ds, y, " + r(6, yhat="CASE WHEN count(y) OVER w = 7 THEN avg(y) OVER w ELSE 0 END") + " FROM sku_series "
    "WINDOW w AS (PARTITION BY item_id ORDER BY ds ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)"))
def forecast_sma_in_sample(spark, sf):
    return rounded(fc.sma_in_sample(sku_series(spark, sf)), 6, "yhat")


@query("forecast_seasonal_naive", v.sql("SELECT * FROM naive"))
def forecast_seasonal_naive(spark, sf):
    return fc.seasonal_naive(plan.item_lines(v.family(spark, sf)))


def flagged_series(spark, sf):
    """Dense item units with the flags of their days: holidays, promotions, discounts, stock-outs and stores, staged."""
    lines = v.family(spark, sf)
    daily = lines.groupBy(cl.item_id().alias("item_id"), "sku", "ds").agg(
        F.sum("qty").alias("y"), F.max((F.col("disc") > 0).cast("int")).alias("is_on_promotion"),
        F.sum("disc_amt").alias("disc"), F.sum("revenue").alias("revenue"))
    daily = daily.withColumn("discount_percentage", ft.discount_share())
    stock = v.stock(lines).select("sku", "ds", (F.col("warehouse_qty") <= 0).cast("int").alias("was_stocked_out"))
    daily = daily.join(stock, ["sku", "ds"], "left").drop("sku", "disc", "revenue")
    flags = ["is_on_promotion", "discount_percentage", "was_stocked_out"]
    panel = grid.dense_panel(daily, span=grid.day_span(lines), fills={"y": "zero"}).fillna(0, subset=flags)
    return stage(_day_flags(spark, sf, panel), "flagged")


def _day_flags(spark, sf, days):
    """Holidays, the store count and its ratio to the newest one."""
    stores = stage(sl.store_days(v.store_count(spark, sf)), "stores")
    days = sl.join_stores(sl.join_days(days, sl.holiday_days(v.holidays(spark, sf)), {"is_holiday": 0}), stores)
    newest = stores.agg(F.max_by("store_count", "ds")).scalar()
    return days.withColumn("store_growth", F.coalesce(F.try_divide("store_count", newest), F.lit(1.0)))


def item_future(spark, sf, series):
    """The forecast horizon of every item: no promotion, no discount, no stock-out, the last store count."""
    items = series.select("item_id").distinct()
    future = grid.future_days(items, series.agg(F.max("ds")).scalar()).withColumns(
        {"is_on_promotion": F.lit(0), "discount_percentage": F.lit(0.0), "was_stocked_out": F.lit(0)})
    return _day_flags(spark, sf, future)


@query("forecast_harmonic")
def forecast_harmonic(spark, sf):
    series = flagged_series(spark, sf)
    return regression.forecast(series, item_future(spark, sf, series), regression.REGRESSORS)


_TREND = {
    "days": "SELECT item_id, ds, y, date_diff('day', max(ds) OVER (), ds) AS x FROM sku_series",
    "trend": "SELECT item_id, regr_slope(y, x) AS slope, regr_intercept(y, x) AS base, max(ds) AS last_ds FROM days GROUP BY 1",
    "trend_bt": "SELECT item_id, win, regr_slope(y, step) AS slope, regr_intercept(y, step) AS base FROM bt_rows WHERE step <= 0 GROUP BY 1, 2",
}


@query("forecast_trend", v.sql(
    "SELECT 'Trend' AS model, item_id, step, CAST(last_ds + step AS DATE) AS ds, " + r(5, mean="greatest(base + slope * step, 0)")
    + " FROM trend, (SELECT CAST(unnest(generate_series(1, 183)) AS INTEGER) AS step)", **_TREND))
def forecast_trend(spark, sf):
    """The regression with its trend alone."""
    series = stage(sku_series(spark, sf), "series")
    items = series.select("item_id").distinct()
    future = grid.future_days(items, series.agg(F.max("ds")).scalar())
    return rounded(regression.forecast(series, future, regression.TREND), 5, "mean")


@query("backtest_trend", v.sql(
    "SELECT item_id, win AS \"window\", step, ds, y, 'Trend' AS model, " + r(5, yhat="greatest(base + slope * step, 0)")
    + " FROM bt_rows JOIN trend_bt USING (item_id, win) WHERE step BETWEEN 1 AND 183", **BT, **_TREND))
def backtest_trend(spark, sf):
    """All validation windows of the trend regression, from one pass over the history."""
    return rounded(regression.backtest(stage(sku_series(spark, sf), "series"), design=regression.TREND), 5, "yhat")


@query("forecast_gbt")
def forecast_gbt(spark, sf):
    series = flagged_series(spark, sf)
    return fc.gbt(series, item_future(spark, sf, series))


@query("gbt_search")
def gbt_search(spark, sf):
    """What the time-ordered search of the trees tried, best first."""
    return fc.trials_table(spark, fc.search_gbt(fc.gbt_training_rows(flagged_series(spark, sf))))


def _importance_table(spark, sf):
    """Held-out importances of the trees: fitted before the newest window, judged on it."""
    rows = stage(fc.gbt_training_rows(flagged_series(spark, sf)), "gbt-rows")
    early, late = fc.split_late(rows)
    out = fc.permutation_importance(fc.fit_gbt(early), late)
    pair = F.struct("feature", "importance")
    return out.agg(F.collect_list(pair).alias("importances")).select(F.lit("GBT").alias("model"), "importances")


@query("feature_importance")
def feature_importance(spark, sf):
    return _importance_table(spark, sf).select("model", F.inline("importances"))


@query("feature_top5")
def feature_top5(spark, sf):
    return fc.top_features(_importance_table(spark, sf))


_LEVELS = {f"q{round(p * 100)}": p for p in config.QUANTILE_LEVELS}


def _quantile_sql(rows):
    """Residual quantiles in units of the item's scale, from the backtest rows ``rows`` (with their scale)."""
    return (f"SELECT model, (step - 1) // 30 AS bucket, " + ", ".join(f"quantile_cont((y - yhat) / nullif(scale, 0), {p}) AS r{n}" for n, p in _LEVELS.items())
            + f" FROM {rows} GROUP BY 1, 2")


_INTERVALS = {
    "item_scale": "SELECT model, item_id, avg(abs(y - yhat)) AS scale FROM bt GROUP BY 1, 2",
    "scaled": "SELECT * FROM bt JOIN item_scale USING (model, item_id)",
    "residual_q": _quantile_sql("scaled"),
    "intervals": "SELECT m.model, m.item_id, m.step, m.ds, m.mean, " + ", ".join(f"greatest(mean + coalesce(scale * r{n}, 0), 0) AS {n}" for n in _LEVELS)
                 + " FROM sku_models m LEFT JOIN residual_q q ON q.model = m.model AND q.bucket = (m.step - 1) // 30 "
                   "LEFT JOIN item_scale i ON i.model = m.model AND i.item_id = m.item_id",
}
_COVERAGE = {
    "old_scale": "SELECT model, item_id, avg(abs(y - yhat)) AS scale FROM bt WHERE win > 0 GROUP BY 1, 2",
    "old_scaled": "SELECT * FROM bt JOIN old_scale USING (model, item_id) WHERE win > 0",
    "old_q": _quantile_sql("old_scaled"),
    "new_q": "SELECT b.model, b.y, " + ", ".join(f"greatest(yhat + coalesce(scale * r{n}, 0), 0) AS {n}" for n in _LEVELS)
             + " FROM bt b LEFT JOIN old_scale i ON i.model = b.model AND i.item_id = b.item_id "
               "LEFT JOIN old_q q ON q.model = b.model AND q.bucket = (b.step - 1) // 30 WHERE win = 0",
}


def intervals(spark, sf):
    scored = stage(ev.backtest(sku_series(spark, sf)), "backtest")
    scales = stage(fc.item_scales(scored), "scales")
    return fc.with_intervals(sku_models(spark, sf), fc.residual_quantiles(scored, scales), scales)


@query("interval_coverage", v.sql(" UNION ALL ".join(
    f"SELECT model, {p}::DOUBLE AS level, count(*) AS days, " + r(5, below=f"avg((y < {n})::INTEGER)", at_or_below=f"avg((y <= {n})::INTEGER)")
    + " FROM new_q GROUP BY 1" for n, p in _LEVELS.items()), **BT, **_COVERAGE))
def interval_coverage(spark, sf):
    """Quantiles calibrated on the older windows, judged on the newest one."""
    return rounded(fc.interval_coverage(stage(ev.backtest(sku_series(spark, sf)), "backtest")), 5, "below", "at_or_below")


@query("forecast_intervals", v.sql("SELECT model, item_id, step, ds, " + r(5, mean="mean", **{n: n for n in _LEVELS}) + " FROM intervals",
                                   **_INTERVALS, **BT))
def forecast_intervals(spark, sf):
    return rounded(intervals(spark, sf), 5, "mean", *_LEVELS)


@query("forecast_ensemble_mean", v.sql("SELECT item_id, step, ds, " + r(5, mean="avg(mean)", **{n: f"avg({n})" for n in _LEVELS})
                                       + " FROM intervals GROUP BY 1, 2, 3", **_INTERVALS, **BT))
def forecast_ensemble_mean(spark, sf):
    return rounded(fc.ensemble_mean(intervals(spark, sf), ("mean", *_LEVELS)), 5, "mean", *_LEVELS)


@query("forecast_ensemble_weighted", v.sql(
    "SELECT item_id, step, ds, " + r(5, mean="sum(weight * mean)") + " FROM sku_models JOIN bt_weights USING (item_id, model) GROUP BY 1, 2, 3", **BT))
def forecast_ensemble_weighted(spark, sf):
    weights = fc.ensemble_weights(errors(spark, sf))
    return rounded(fc.ensemble_weighted(sku_models(spark, sf), weights), 5, "mean")


_M = ("rmse", "mae", "r2", "mape", "wape", "smape")


@query("forecast_metrics", v.sql("SELECT model, item_id, " + r(5, **{m: m for m in _M}, accuracy="100 - wape") + " FROM errors", **BT))
def forecast_metrics(spark, sf):
    return rounded(errors(spark, sf), 5, *_M, "accuracy")


@query("forecast_mase", v.sql("SELECT model, item_id, " + r(5, mae="mae", scale="scale", mase="mase") + " FROM mase_rows", **BT))
def forecast_mase(spark, sf):
    s = sku_series(spark, sf)
    return rounded(ev.mase(ev.backtest(s), s), 5, "mae", "scale", "mase")


@query("leaderboard", v.sql(
    "SELECT *, dense_rank() OVER (ORDER BY mase NULLS LAST, model) AS rank FROM (SELECT model, "
    + r(5, mase="avg(mase)", rmse="avg(rmse)", wape="avg(wape)") + ", count(*) AS items FROM errors "
    "JOIN (SELECT model, item_id, mase FROM mase_rows) USING (model, item_id) GROUP BY 1)", **BT))
def leaderboard(spark, sf):
    return _board(*plan.backtested(sku_series(spark, sf)))


def _board(series, scored):
    board = ev.leaderboard(plan.model_errors(series, scored))
    return rounded(board, 5, "mase", "rmse", "wape").withColumn("rank", F.col("rank").cast("bigint"))


@query("union_leaderboards", v.sql(
    "SELECT 'all windows' AS preset, model, " + r(5, wape="avg(wape)") + " FROM errors GROUP BY 2 UNION ALL "
    "SELECT 'newest window', model, " + r(5, wape="avg(wape)") + " FROM (SELECT model, item_id, CASE WHEN sum(abs(y)) > 0 THEN "
    "sum(abs(y - yhat)) / sum(abs(y)) * 100 ELSE 0 END AS wape FROM bt WHERE win = 0 GROUP BY 1, 2) GROUP BY 2", **BT))
def union_leaderboards(spark, sf):
    """The boards of two presets, all validation windows and the newest one, stacked."""
    _, scored = plan.backtested(sku_series(spark, sf))
    boards = [ev.metrics(rows).groupBy("model").agg(F.avg("wape").alias("wape")).withColumn("preset", F.lit(name))
              for name, rows in (("all windows", scored), ("newest window", scored.where("window = 0")))]
    return rounded(boards[0].unionByName(boards[1]), 5, "wape").select("preset", "model", "wape")


@query("leaderboard_fitted")
def leaderboard_fitted(spark, sf):
    """The board of all four models; the fitted ones learn anew before each window's cutoff."""
    return _board(*plan.backtested(flagged_series(spark, sf), fitted=True))


@query("champion_fitted")
def champion_fitted(spark, sf):
    """Each item's champion among all four models, or their blend, over the horizon."""
    series = flagged_series(spark, sf)
    out = plan.champion_forecast(series, item_future(spark, sf, series))
    return out.groupBy("item_id", "model").agg(F.count(F.lit(1)).alias("days"), F.sum("mean").alias("total"))


@query("champion_select", v.sql(
    "SELECT item_id, count(*) AS models, min_by(model, (wape, model)) AS best_model, round(min(wape), 5) AS best_wape, "
    "CASE WHEN count(*) > 1 AND max(wape) < 50 THEN 'Ensemble' ELSE min_by(model, (wape, model)) END AS champion FROM errors GROUP BY 1", **BT))
def champion_select(spark, sf):
    return rounded(ev.champions(errors(spark, sf)), 5, "best_wape")


@query("forecast_champion", v.sql(
    "SELECT item_id, champion AS model, step, ds, " + r(5, mean="mean") + " FROM (SELECT item_id, "
    "CASE WHEN count(*) > 1 AND max(wape) < 50 THEN 'Ensemble' ELSE min_by(model, (wape, model)) END AS champion FROM errors GROUP BY 1) c "
    "JOIN (SELECT * FROM sku_models UNION ALL SELECT 'Ensemble', item_id, step, ds, sum(weight * mean) FROM sku_models "
    "JOIN bt_weights USING (item_id, model) GROUP BY ALL) m USING (item_id) WHERE m.model = c.champion", **BT))
def forecast_champion(spark, sf):
    return rounded(plan.champion_forecast(sku_series(spark, sf)), 5, "mean")


# Family SKUs and one coarse SKU per part type: dense and sparse items side by side.
_MIXED = ("SELECT sku, ds, qty FROM family UNION ALL SELECT sku, ds, qty FROM sales")


def mixed(spark, sf):
    """Family SKUs (dense) and part SKUs (sparse) in one sales table."""
    return v.family(spark, sf).select("sku", "ds", "qty").unionByName(v.sales(spark, sf).select("sku", "ds", "qty"))


_DENSITY = ("SELECT sku AS item_id, days, 1 - sale_days / CAST(days AS DOUBLE) AS zero_sales_ratio FROM (SELECT sku, count(DISTINCT ds) FILTER (qty <> 0) "
            "AS sale_days, (SELECT date_diff('day', min(ds), max(ds)) + 1 FROM mixed) AS days FROM mixed GROUP BY 1)")


@query("forecast_routing", v.sql(
    "SELECT item_id, CAST(days AS INTEGER) AS days, " + r(6, zero_sales_ratio="zero_sales_ratio")
    + ", CASE WHEN days < 30 OR zero_sales_ratio > 0.6::DOUBLE THEN 'category' ELSE 'contest' END AS route FROM density",
    mixed=_MIXED, density=_DENSITY))
def forecast_routing(spark, sf):
    return rounded(fc.route(segment.density(mixed(spark, sf))), 6, "zero_sales_ratio")


_CAT = ("SELECT c.category, c.item_id, c.units / sum(c.units) OVER (PARTITION BY c.category) AS share FROM "
        "(SELECT nullif(regexp_extract(sku, '^([A-Z]+)', 1), '') AS category, sku AS item_id, sum(qty) AS units FROM {t} GROUP BY 1, 2) c WHERE category IS NOT NULL")
def _contest(series, prefix):
    """The twins of the contest on another series (item_id, ds, y), under names of their own, and its winners' days."""
    names = [*BT, "sku_series"]
    word = re.compile(r"\b(" + "|".join(sorted(names, key=len, reverse=True)) + r")\b")
    renamed = {prefix + k: word.sub(lambda m: prefix + m[0], body) for k, body in {**BT, "sku_series": series}.items()}
    p = prefix
    return {**renamed,
            f"{p}chosen": f"SELECT item_id, CASE WHEN count(*) > 1 AND max(wape) < 50 THEN 'Ensemble' ELSE min_by(model, (wape, model)) END AS champion "
                          f"FROM {p}errors GROUP BY 1",
            f"{p}blended": f"SELECT item_id, model, step, mean FROM {p}sku_models UNION ALL SELECT item_id, 'Ensemble', step, sum(weight * mean) "
                           f"FROM {p}sku_models JOIN {p}bt_weights USING (item_id, model) GROUP BY item_id, step",
            f"{p}won": f"SELECT item_id, step, mean FROM {p}blended JOIN {p}chosen USING (item_id) WHERE model = champion"}


_CAT_SERIES = ("SELECT i.item_id, c.ds, coalesce(d.y, 0) AS y FROM (SELECT DISTINCT category AS item_id FROM cat_daily) i CROSS JOIN "
               "(SELECT CAST(unnest(generate_series((SELECT min(ds) FROM {t}), (SELECT max(ds) FROM {t}), INTERVAL 1 DAY)) AS DATE) AS ds) c "
               "LEFT JOIN cat_daily d ON d.category = i.item_id AND d.ds = c.ds")


def _categories(t):
    """The twins of the category contest over the lines ``t``."""
    return {"cat": _CAT.format(t=t),
            "cat_daily": "SELECT nullif(regexp_extract(sku, '^([A-Z]+)', 1), '') AS category, ds, sum(qty) AS y FROM " + t + " WHERE sku IN "
                         "(SELECT sku FROM " + t + " GROUP BY 1 HAVING count(*) >= 30) GROUP BY 1, 2 HAVING category IS NOT NULL",
            **_contest(_CAT_SERIES.format(t=t), "cat_"),
            "cat_total": "SELECT item_id AS category, avg(mean) AS daily, sum(mean) AS total FROM cat_won GROUP BY 1"}


@query("forecast_category", v.sql(
    "SELECT item_id AS sku, category, " + r(4, daily_mean="share * daily", total="share * total") + " FROM cat JOIN cat_total USING (category)",
    **_categories("sales")))
def forecast_category(spark, sf):
    """The champion of each category, shared out to SKUs by their past units."""
    out = plan.category_forecast(v.sales(spark, sf).select("sku", "ds", "qty"))
    totals = out.groupBy("sku", "category").agg(F.avg("mean").alias("daily_mean"), F.sum("mean").alias("total"))
    return rounded(totals, 4, "daily_mean", "total")


@query("category_reconciled", v.sql("SELECT category, step, " + r(4, forecast="mean", of_skus="mean")
                                    + " FROM (SELECT item_id AS category, step, mean FROM cat_won)", **_categories("sales")))
def category_reconciled(spark, sf):
    """Each category's forecast next to the sum over its SKUs."""
    sales = v.sales(spark, sf).select("sku", "ds", "qty")
    level = plan.category_level(sales)
    sums = plan.category_forecast(sales, level).groupBy("category", "step").agg(F.sum("mean").alias("of_skus"))
    whole = level.select("category", "step", F.col("mean").alias("forecast"))
    return rounded(whole.join(sums, ["category", "step"]), 4, "forecast", "of_skus")


_ROUTED = {
    **BT, "mixed": _MIXED, "density": _DENSITY, **_categories("mixed"),
    "sku_daily": "SELECT sku AS item_id, ds, sum(qty) AS y FROM mixed WHERE sku IN (SELECT item_id FROM density WHERE days >= 30 "
                 "AND zero_sales_ratio <= 0.6::DOUBLE) GROUP BY 1, 2",
    "sku_series": "SELECT i.item_id, c.ds, coalesce(d.y, 0) AS y FROM (SELECT DISTINCT item_id FROM sku_daily) i CROSS JOIN day_list c "
                  "LEFT JOIN sku_daily d ON d.item_id = i.item_id AND d.ds = c.ds",
    "chosen": "SELECT item_id, CASE WHEN count(*) > 1 AND max(wape) < 50 THEN 'Ensemble' ELSE min_by(model, (wape, model)) END AS champion "
              "FROM errors GROUP BY 1",
    "blended": "SELECT item_id, model, mean FROM sku_models UNION ALL SELECT item_id, 'Ensemble', sum(weight * mean) FROM sku_models "
               "JOIN bt_weights USING (item_id, model) GROUP BY item_id, step",
}


@query("forecast_routed", v.sql(
    "SELECT item_id, model, count(*) AS days, round(sum(mean), 4) AS total FROM blended JOIN chosen USING (item_id) WHERE model = champion GROUP BY 1, 2 "
    "UNION ALL SELECT item_id, 'Category', 183, round(share * total, 4) FROM cat JOIN cat_total USING (category) "
    "WHERE item_id IN (SELECT item_id FROM density WHERE days < 30 OR zero_sales_ratio > 0.6::DOUBLE)", **_ROUTED))
def forecast_routed(spark, sf):
    """Every SKU forecast on its route: contest champion, category share or moving average."""
    out = plan.routed_forecast(mixed(spark, sf))
    return rounded(out.groupBy("item_id", "model").agg(
        F.count(F.lit(1)).alias("days"), F.sum("mean").alias("total")), 4, "total")


@query("backtest_windows", v.sql(
    "SELECT item_id, win AS \"window\", part, count(*) AS days, min(ds) AS first_ds, max(ds) AS last_ds FROM (SELECT *, CASE WHEN step <= 0 THEN 'train' ELSE 'test' END AS part "
    "FROM bt_rows WHERE step <= 183) GROUP BY 1, 2, 3", **BT))
def backtest_windows(spark, sf):
    return ev.backtest_windows(sku_series(spark, sf)).groupBy("item_id", "window", "part").agg(
        F.count(F.lit(1)).alias("days"), F.min("ds").alias("first_ds"), F.max("ds").alias("last_ds"))


@query("robust_scale", v.sql(
    "SELECT item_id, ds, " + r(6, y="(y - q2) / CASE WHEN q3 = q1 THEN 1 ELSE q3 - q1 END") + " FROM sku_series JOIN "
    "(SELECT item_id, quantile_cont(y, 0.25) AS q1, quantile_cont(y, 0.5) AS q2, quantile_cont(y, 0.75) AS q3 FROM sku_series GROUP BY 1) USING (item_id)"))
def robust_scale(spark, sf):
    return rounded(ft.robust_scale(sku_series(spark, sf), ["y"]), 6, "y")


_WEEKS = segment.WEEKS


def part_profile(spark, sf):
    daily = v.sales(spark, sf).groupBy("sku", "ds").agg(F.sum("qty").alias("y"), F.count(F.lit(1)).alias("records"))
    return segment.weekly_profile(daily)


@query("demand_profile", v.sql(
    "SELECT sku, " + r(6, **{f"w{i}": f"coalesce((w{i} - lo) / nullif(hi - lo, 0), 0)" for i in range(_WEEKS)}) + " FROM (SELECT *, least("
    + ", ".join(f"w{i}" for i in range(_WEEKS)) + ") AS lo, greatest(" + ", ".join(f"w{i}" for i in range(_WEEKS)) + ") AS hi FROM (SELECT sku, "
    + ", ".join(f"coalesce(sum(qty) FILTER (least((dayofyear(ds) - 1) // 7, {_WEEKS - 1}) = {i}), 0) AS w{i}" for i in range(_WEEKS))
    + " FROM sales GROUP BY sku HAVING count(*) >= 30))"))
def demand_profile(spark, sf):
    return rounded(part_profile(spark, sf), 6, *[f"w{i}" for i in range(_WEEKS)])


@query("demand_clusters")
def demand_clusters(spark, sf):
    return segment.demand_clusters(part_profile(spark, sf), 4)


_MASTER = {
    **BT,
    "m_attr": "SELECT item_id, avg(y) AS avg_sales, stddev_samp(y) AS std_sales, max(y) AS max_sales, avg((y = 0)::INTEGER) AS zero_sales_ratio, "
              "count(*) AS days, max(ds) AS last_processed_date FROM sku_series GROUP BY 1",
    "m_pick": "SELECT item_id, CASE WHEN count(*) > 1 AND max(wape) < 50 THEN 'Ensemble' ELSE min_by(model, (wape, model)) END AS champion, "
              + ", ".join(f"max({e}) FILTER (model = '{m}') AS {e}_{m.lower()}" for m in ("SMA", "SeasonalNaive") for e in plan.MASTER_ERRORS)
              + " FROM errors GROUP BY 1",
    "m_bt": "SELECT model, item_id, win, step, y, yhat FROM bt UNION ALL SELECT 'Ensemble', item_id, win, step, y, sum(weight * yhat) FROM bt "
            "JOIN bt_weights USING (item_id, model) GROUP BY item_id, win, step, y",
    "m_errors": BT["errors"].replace("FROM bt ", "FROM m_bt "),
    "m_scaled": "SELECT * FROM m_bt JOIN (SELECT model, item_id, mae AS scale FROM m_errors) USING (model, item_id)",
    "m_q": _quantile_sql("m_scaled"),
    "m_models": "SELECT item_id, model, step, mean FROM sku_models UNION ALL SELECT item_id, 'Ensemble', step, sum(weight * mean) FROM sku_models "
                "JOIN bt_weights USING (item_id, model) GROUP BY item_id, step",
    "m_ahead": "SELECT m.item_id, m.step, m.mean, greatest(mean + coalesce(e.mae * q90, 0), 0) - greatest(mean + coalesce(e.mae * q10, 0), 0) AS width "
               "FROM m_models m JOIN m_pick p ON p.item_id = m.item_id AND p.champion = m.model LEFT JOIN "
               "(SELECT model, bucket, rq10 AS q10, rq90 AS q90 FROM m_q) q ON q.model = m.model AND q.bucket = (m.step - 1) // 30 "
               "LEFT JOIN m_errors e ON e.model = m.model AND e.item_id = m.item_id",
    "m_roll": "SELECT item_id, avg(mean) AS f, sum(mean) FILTER (step <= 30) AS forecast_30d, sum(mean) FILTER (step <= 90) AS forecast_90d, "
              "sum(mean) AS forecast_183d, avg(width) FILTER (step <= 30) AS ci_width_30d, avg(width) FILTER (step <= 90) AS ci_width_90d FROM m_ahead GROUP BY 1",
    "m_own": "SELECT e.item_id, " + ", ".join(f"{e} AS champion_{e}" for e in plan.MASTER_ERRORS)
             + " FROM m_errors e JOIN m_pick p ON p.item_id = e.item_id AND p.champion = e.model",
}
_MASTER_FIGURES = ("avg_sales", "std_sales", "max_sales", "zero_sales_ratio",
                   *[f"{e}_{m}" for m in ("sma", "seasonalnaive") for e in plan.MASTER_ERRORS], *[f"champion_{e}" for e in plan.MASTER_ERRORS],
                   "forecast_30d", "forecast_90d", "forecast_183d", "ci_width_30d", "ci_width_90d")


@query("sku_master", v.sql(
    "SELECT item_id AS sku_id, abc.class, champion, days, last_processed_date, " + r(4, **{c: c for c in _MASTER_FIGURES},
        safety_stock=f"{config.z_score(0.95)!r}::DOUBLE * std_sales * sqrt(21.0::DOUBLE)", lead_time_demand="f * 21")
    + " FROM m_attr JOIN m_pick USING (item_id) JOIN m_roll USING (item_id) JOIN m_own USING (item_id) JOIN abc ON abc.sku = item_id", **_MASTER))
def sku_master(spark, sf):
    out = plan.sku_master(v.family(spark, sf))
    return rounded(out, 4, *_MASTER_FIGURES, "safety_stock", "lead_time_demand").select(
        "sku_id", "class", "champion", "days", "last_processed_date", *_MASTER_FIGURES, "safety_stock", "lead_time_demand")
