"""Seasonality, promotions, run monitoring and summaries."""

from pyspark.sql import functions as F

from catalog import views as v
from catalog.base import query, r, rounded
from catalog.forecasting import BT
from catalog.joins import _FLAGGED, promo_panel
from larder.operators import evaluate as ev
from larder.operators import grid, monitor, promo, regression, seasonal
from larder.plans import forecasting as plan
from larder.session import new_path, stage
from larder.sources import sinks


def decomposition(period: int, multiplicative: bool, source: str) -> dict[str, str]:
    """Classical decomposition in SQL over ``source`` (item_id, ds, y)."""
    half = period // 2
    if period % 2:
        ma = f"avg(y) OVER (PARTITION BY item_id ORDER BY ds ROWS BETWEEN {half} PRECEDING AND {half} FOLLOWING)"
    else:
        ma = (f"(0.5::DOUBLE * lag(y, {half}) OVER w + 0.5::DOUBLE * lead(y, {half}) OVER w + sum(y) OVER (PARTITION BY item_id ORDER BY ds "
              f"ROWS BETWEEN {half - 1} PRECEDING AND {half - 1} FOLLOWING)) / {period}")
    op, centre = ("/", "pm / nullif(centre, 0)") if multiplicative else ("-", "pm - centre")
    resid = "y / nullif(trend * seasonal, 0)" if multiplicative else "y - trend - seasonal"
    detr = "y / nullif(trend, 0)" if multiplicative else "y - trend"
    return {
        "dec_base": f"SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY ds) - 1 AS i, count(*) OVER (PARTITION BY item_id) AS n FROM {source}",
        "dec_ma": f"SELECT *, CASE WHEN i >= {half} AND i < n - {half} THEN {ma} END AS ma FROM dec_base WINDOW w AS (PARTITION BY item_id ORDER BY ds)",
        "dec_fit": f"SELECT item_id, regr_slope(ma, i) FILTER (i < least({half + period}, n - 1 - {half})) AS hk, "
                   f"regr_intercept(ma, i) FILTER (i < least({half + period}, n - 1 - {half})) AS hb, "
                   f"regr_slope(ma, i) FILTER (i >= greatest({half}, n - 1 - {half} - {period}) AND i < n - 1 - {half}) AS tk, "
                   f"regr_intercept(ma, i) FILTER (i >= greatest({half}, n - 1 - {half} - {period}) AND i < n - 1 - {half}) AS tb "
                   "FROM dec_ma WHERE ma IS NOT NULL GROUP BY 1",
        "dec_trend": f"SELECT item_id, ds, y, i, i % {period} AS phase, CASE WHEN i < {half} THEN hk * i + hb WHEN i >= n - {half} THEN tk * i + tb "
                     f"ELSE ma END AS trend FROM dec_ma JOIN dec_fit USING (item_id) WHERE n >= {2 * period}",
        "dec_phase": f"SELECT item_id, phase, avg({detr}) AS pm FROM dec_trend GROUP BY 1, 2",
        "dec_centre": "SELECT item_id, avg(pm) AS centre FROM dec_phase GROUP BY 1",
        "decomposed": f"SELECT *, {resid} AS resid FROM (SELECT item_id, ds, y, trend, {centre} AS seasonal FROM dec_trend "
                      "JOIN dec_phase USING (item_id, phase) JOIN dec_centre USING (item_id))",
    }


_PARTS = r(4, trend="trend", seasonal="seasonal", resid="resid")
_POSITIVE = "SELECT item_id, ds, CASE WHEN y = 0 THEN 1e-6::DOUBLE ELSE y END AS y FROM sku_own"
_OWN = ("SELECT i.item_id, c.ds, coalesce(d.y, 0) AS y FROM (SELECT item_id, min(ds) AS lo, max(ds) AS hi FROM sku_daily GROUP BY 1) i "
        "JOIN day_list c ON c.ds BETWEEN i.lo AND i.hi LEFT JOIN sku_daily d ON d.item_id = i.item_id AND d.ds = c.ds")


def own_series(spark, sf, method="zero", model="additive"):
    lines = v.family(spark, sf).select(F.col("sku").alias("item_id"), "ds", "qty")
    return seasonal.filled_series(lines, method, model)


@query("seasonal_decompose", v.sql(f"SELECT item_id, ds, y, {_PARTS} FROM decomposed", sku_own=_OWN, **decomposition(7, False, "sku_own")))
def seasonal_decompose(spark, sf):
    return rounded(seasonal.decompose(own_series(spark, sf), 7), 4, "trend", "seasonal", "resid")


@query("seasonal_decompose_even", v.sql(f"SELECT item_id, ds, y, {_PARTS} FROM decomposed", sku_own=_OWN, **decomposition(30, False, "sku_own")))
def seasonal_decompose_even(spark, sf):
    return rounded(seasonal.decompose(own_series(spark, sf), 30), 4, "trend", "seasonal", "resid")


@query("seasonal_decompose_multiplicative", v.sql(
    f"SELECT item_id, ds, y, {_PARTS} FROM decomposed", sku_own=_OWN, sku_pos=_POSITIVE, **decomposition(90, True, "sku_pos")))
def seasonal_decompose_multiplicative(spark, sf):
    out = seasonal.decompose(own_series(spark, sf, model="multiplicative"), 90, "multiplicative")
    return rounded(out, 4, "trend", "seasonal", "resid")


_STRENGTH = ("SELECT item_id, coalesce(s, 0) AS seasonal_strength FROM (SELECT DISTINCT item_id FROM sku_own) LEFT JOIN (SELECT item_id, "
             "var_pop(seasonal) / nullif(var_pop(seasonal) + var_pop(resid), 0) AS s FROM decomposed GROUP BY 1) USING (item_id)")
_S365 = {"sku_own": _OWN, **decomposition(365, False, "sku_own"), "strength": _STRENGTH}


@query("seasonal_strength", v.sql("SELECT item_id, " + r(5, seasonal_strength="seasonal_strength") + " FROM strength", **_S365))
def seasonal_strength(spark, sf):
    return rounded(seasonal.strength(own_series(spark, sf), 365), 5, "seasonal_strength")


_SKUS = ("SELECT item_id AS sku, seasonal_strength, count, mean, std, (seasonal_strength >= 0.2::DOUBLE)::INTEGER AS is_seasonal FROM strength JOIN "
         "(SELECT sku AS item_id, count(qty) AS count, avg(qty) AS mean, stddev_samp(qty) AS std FROM family GROUP BY 1) USING (item_id)")


def seasonal_table(spark, sf):
    return seasonal.seasonal_skus(v.family(spark, sf), 365, 0.2)


@query("seasonal_skus", v.sql("SELECT sku, is_seasonal, count, " + r(5, seasonal_strength="seasonal_strength", mean="mean", std="std")
                              + " FROM skus", skus=_SKUS, **_S365))
def seasonal_skus(spark, sf):
    return rounded(seasonal_table(spark, sf), 5, "seasonal_strength", "mean", "std")


@query("seasonal_split", v.sql("SELECT is_seasonal, count(*) AS skus FROM skus GROUP BY 1", skus=_SKUS, **_S365))
def seasonal_split(spark, sf):
    return seasonal_table(spark, sf).groupBy("is_seasonal").agg(F.count(F.lit(1)).alias("skus"))


@query("top_seasonal_skus", v.sql("SELECT sku, " + r(5, seasonal_strength="seasonal_strength")
                                  + " FROM skus ORDER BY seasonal_strength DESC, sku LIMIT 100", skus=_SKUS, **_S365))
def top_seasonal_skus(spark, sf):
    top = seasonal_table(spark, sf).orderBy(F.desc("seasonal_strength"), "sku").limit(100)
    return rounded(top.select("sku", "seasonal_strength"), 5, "seasonal_strength")


@query("seasonal_events", v.sql(
    "SELECT sku, is_seasonal, count, " + r(5, seasonal_strength="seasonal_strength", mean="mean", std="coalesce(std, 0)")
    + ", " + ", ".join(f"coalesce({n}_sales, 0) AS {n}_sales" for n, *_ in v.EVENTS) + " FROM skus LEFT JOIN (SELECT sku, " + ", ".join(
        f"sum(qty) FILTER (ds BETWEEN DATE '{d}' - {b} AND DATE '{d}' + {a}) AS {n}_sales" for n, d, b, a in v.EVENTS)
    + " FROM family GROUP BY 1) USING (sku)", skus=_SKUS, **_S365))
def seasonal_events(spark, sf):
    """Seasonal strength and the units around each event, per SKU."""
    out = seasonal.with_event_sales(seasonal_table(spark, sf), promo.event_sales(v.family(spark, sf), v.EVENTS))
    return rounded(out, 5, "seasonal_strength", "mean", "std")


_OWN_GAPS = ("SELECT i.item_id, c.ds, d.y FROM (SELECT item_id, min(ds) AS lo, max(ds) AS hi FROM sku_daily GROUP BY 1) i "
             "JOIN day_list c ON c.ds BETWEEN i.lo AND i.hi LEFT JOIN sku_daily d ON d.item_id = i.item_id AND d.ds = c.ds")


@query("gap_fill_method", v.sql(
    "SELECT item_id, ds, coalesce(y, 0) AS zero, " + r(6, interpolate="CASE WHEN y IS NOT NULL THEN y ELSE py + (ny - py) * "
    "(date_diff('day', pd, ds) / CAST(date_diff('day', pd, nd) AS DOUBLE)) END", ffill="coalesce(py, ny)")
    + " FROM (SELECT *, last_value(y IGNORE NULLS) OVER b AS py, last_value(CASE WHEN y IS NOT NULL THEN ds END IGNORE NULLS) OVER b AS pd, "
      "first_value(y IGNORE NULLS) OVER f AS ny, first_value(CASE WHEN y IS NOT NULL THEN ds END IGNORE NULLS) OVER f AS nd FROM gaps "
      "WINDOW b AS (PARTITION BY item_id ORDER BY ds ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), "
      "f AS (PARTITION BY item_id ORDER BY ds ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))", gaps=_OWN_GAPS))
def gap_fill_method(spark, sf):
    """The three fills side by side, from one dense pass."""
    daily = v.family(spark, sf).groupBy(F.col("sku").alias("item_id"), "ds").agg(F.sum("qty").alias("zero"))
    daily = daily.withColumns({"interpolate": F.col("zero"), "ffill": F.col("zero")})
    out = grid.dense_panel(daily, fills={"zero": "zero", "interpolate": "interpolate_back", "ffill": "ffill"})
    return rounded(out, 6, "interpolate", "ffill")


# ---- promotions ---------------------------------------------------------------------------

_START, _END, _BEFORE = v.PROMO
_LEN = (_END - _START).days + 1
_GROWTH = f"""SELECT k.sku, qb / {_BEFORE} AS avg_daily_sales_before, qp / {_LEN} AS avg_daily_sales_promo,
  CASE WHEN qb > 0 THEN (qp / {_LEN} - qb / {_BEFORE}) / (qb / {_BEFORE}) * 100 ELSE 0 END AS growth_pct,
  qp - qb / {_BEFORE} * {_LEN} AS sales_lift_units, rp - rb / {_BEFORE} * {_LEN} AS revenue_lift, avg_discount,
  CASE WHEN avg_discount > 0 AND gross * avg_discount / 100 > 0 THEN (rp - rb / {_BEFORE} * {_LEN}) / (gross * avg_discount / 100) * 100 ELSE 0 END AS discount_roi_pct
 FROM (SELECT DISTINCT sku FROM sales) k JOIN (SELECT sku, coalesce(sum(qty) FILTER (b), 0) AS qb, coalesce(sum(qty) FILTER (p), 0) AS qp,
   coalesce(sum(revenue) FILTER (b), 0) AS rb, coalesce(sum(revenue) FILTER (p), 0) AS rp, avg(disc) FILTER (p) AS avg_discount,
   coalesce(sum(qty * coalesce(revenue / nullif(qty * (1 - disc / 100), 0), 0)) FILTER (p), 0) AS gross
  FROM (SELECT *, ds BETWEEN DATE '{_START}' - {_BEFORE} AND DATE '{_START}' - 1 AS b, ds BETWEEN DATE '{_START}' AND DATE '{_END}' AS p FROM sales) GROUP BY 1) t USING (sku)"""
_G4 = ("avg_daily_sales_before", "avg_daily_sales_promo", "growth_pct", "sales_lift_units", "discount_roi_pct", "avg_discount")


def growth(spark, sf):
    s = v.sales(spark, sf)
    return promo.sku_growth(s, s.select("sku").distinct(), *v.PROMO)


@query("promo_growth", v.sql("SELECT sku, " + r(5, **{c: c for c in _G4}) + ", " + r(3, revenue_lift="revenue_lift") + " FROM growth", growth=_GROWTH))
def promo_growth(spark, sf):
    return rounded(rounded(growth(spark, sf), 5, *_G4), 3, "revenue_lift")


@query("melt_periods", v.sql(
    "SELECT sku, period, round(avg_daily_sales, 5) AS avg_daily_sales FROM growth UNPIVOT (avg_daily_sales FOR period IN "
    "(avg_daily_sales_before, avg_daily_sales_promo))", growth=_GROWTH))
def melt_periods(spark, sf):
    return rounded(promo.growth_periods(growth(spark, sf)), 5, "avg_daily_sales")


@query("promo_counterfactual", v.sql(
    "SELECT item_id, ds, y AS target, 0 AS is_on_promotion, 0 AS is_high_discount, round(base, 6) AS forecast_no_promo FROM flagged", flagged=_FLAGGED))
def promo_counterfactual(spark, sf):
    """History scored with promotions off: the in-sample baseline with both flags cleared."""
    out = promo.without_promotion(promo.baseline(promo_panel(spark, sf)))
    return rounded(out, 6, "forecast_no_promo").drop("disc")


@query("promo_lift", v.sql(
    "SELECT item_id, sum(y) AS total_actual_sales, " + r(5, total_forecast_no_promo="sum(base)", total_lift_units="sum(y - base)",
    percentage_lift="sum(y - base) / CASE WHEN sum(base) = 0 THEN 1 ELSE sum(base) END * 100")
    + " FROM flagged WHERE promo AND ds >= (SELECT max(ds) FROM flagged) - 183 GROUP BY 1", flagged=_FLAGGED))
def promo_lift(spark, sf):
    out = promo.lift_in_sample(promo_panel(spark, sf))
    return rounded(out, 5, "total_forecast_no_promo", "total_lift_units", "percentage_lift")


_EFFECTS = {
    "flagged": _FLAGGED,
    "leveled": "SELECT *, coalesce(y, 0) AS target, promo::INTEGER AS flag, coalesce(avg(coalesce(y, 0)) OVER (PARTITION BY item_id ORDER BY ds "
               "ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING), 0) AS level FROM flagged",
    "effects": "SELECT item_id, CASE WHEN var_pop(flag) > 0 THEN covar_pop(target - level, flag) / var_pop(flag) ELSE 0 END AS slope, "
               "avg(target - level) AS gap, avg(flag) AS share FROM leveled GROUP BY 1",
    "effect_rows": "SELECT l.*, greatest(level + gap - slope * share, 0) AS plain, greatest(level + gap - slope * share + slope * flag, 0) AS fitted "
                   "FROM leveled l JOIN effects USING (item_id)",
}


@query("promo_counterfactual_model", v.sql(
    "SELECT item_id, ds, " + r(5, with_flags="fitted", without_flags="plain") + " FROM effect_rows", **_EFFECTS))
def promo_counterfactual_model(spark, sf):
    """History scored by a model that uses the flags: as they were, and cleared before scoring."""
    rows = promo.flag_effects(promo_panel(spark, sf))
    seen = promo.scored_by_flag(rows).withColumnRenamed("forecast", "with_flags")
    cleared = promo.scored_by_flag(promo.without_promotion(seen)).withColumnRenamed("forecast", "without_flags")
    return rounded(cleared.select("item_id", "ds", "with_flags", "without_flags"), 5, "with_flags", "without_flags")


@query("promo_lift_model", v.sql(
    "SELECT item_id, sum(target) AS total_actual_sales, " + r(4, total_forecast_no_promo="sum(plain)", total_lift_units="sum(target - plain)")
    + " FROM effect_rows WHERE promo GROUP BY 1", **_EFFECTS))
def promo_lift_model(spark, sf):
    """Units above the model's forecast without promotions, on promoted days."""
    actual = promo_panel(spark, sf)
    cleared = promo.scored_by_flag(promo.without_promotion(promo.flag_effects(actual)))
    out = promo.lift(actual.withColumn("target", F.coalesce("target", F.lit(0.0))),
                     cleared.withColumnRenamed("forecast", "forecast_no_promo"))
    return rounded(out.drop("percentage_lift"), 4, "total_forecast_no_promo", "total_lift_units")


# Out of fold: two slopes in closed form from the days of all other folds.
_FOLDS = {
    "flagged": _FLAGGED,
    "folded": "SELECT item_id, ds, coalesce(y, 0) AS y, promo::INTEGER AS f, date_diff('day', max(ds) OVER (), ds) AS t FROM flagged",
    "dealt": "SELECT *, (-t // 7) % 5 AS fold FROM folded",
    "fits": "SELECT item_id, k AS fold, avg(y) AS my, avg(t) AS mt, avg(f) AS mf, covar_pop(y, f) AS yf, covar_pop(y, t) AS yt, covar_pop(t, f) AS tf, "
            "var_pop(t) AS tt, var_pop(f) AS ff FROM dealt, (SELECT unnest(generate_series(0, 4)) AS k) WHERE fold <> k GROUP BY 1, 2",
    "slopes": "SELECT *, (yf * tt - yt * tf) / (tt * ff - tf * tf) AS bf, (yt * ff - yf * tf) / (tt * ff - tf * tf) AS bt FROM fits",
    "no_promo": "SELECT d.*, greatest(my - bt * mt - bf * mf + bt * t, 0) AS plain FROM dealt d JOIN slopes USING (item_id, fold)",
}


@query("promo_lift_cross_fitted", v.sql(
    "SELECT item_id, sum(y) AS total_actual_sales, " + r(3, total_forecast_no_promo="sum(plain)", total_lift_units="sum(y - plain)")
    + " FROM no_promo WHERE f = 1 AND ds >= (SELECT max(ds) FROM dealt) - 183 GROUP BY 1", **_FOLDS))
def promo_lift_cross_fitted(spark, sf):
    """Lift against a baseline that never saw the day it judges, here of trend and promotion alone."""
    design = regression.Design(waves=(), ridge=0.0, regressors=("is_on_promotion",))
    out = promo.lift_cross_fitted(stage(promo_panel(spark, sf), "promo-panel"), design=design)
    return rounded(out.drop("percentage_lift"), 3, "total_forecast_no_promo", "total_lift_units")


# ---- runs and reports ---------------------------------------------------------------------

_CHAMPION = """SELECT r.*, c.run_id AS champion, c.mase AS cm, c.rmse AS cr FROM model_runs r
 LEFT JOIN model_runs c ON c.run_id = (SELECT max_by(x.run_id, (x.trained_date, x.run_id)) FROM model_runs x
  WHERE (x.trained_date, x.run_id) < (r.trained_date, r.run_id) AND x.decision = 'promote')"""
_COMPARED = """SELECT run_id, coalesce(champion, 'None') AS champion_id, metric_name, o AS champion_metric, n AS new_metric,
  CASE WHEN reason IN ('first_run', 'no_common_metric', 'better') THEN true ELSE false END AS is_better, reason,
  CASE WHEN champion IS NOT NULL AND metric_name IS NOT NULL AND n < o THEN abs((n - o) / o) END AS gain FROM
 (SELECT *, CASE WHEN champion IS NULL THEN 'first_run' WHEN metric_name IS NULL THEN 'no_common_metric'
   WHEN n < o AND abs((n - o) / nullif(o, 0)) >= 0.02::DOUBLE THEN 'better' WHEN n < o THEN 'gain_below_threshold' ELSE 'not_better' END AS reason FROM
 (SELECT *, CASE WHEN mase IS NOT NULL AND cm IS NOT NULL THEN 'MASE' WHEN rmse IS NOT NULL AND cr IS NOT NULL THEN 'RMSE' END AS metric_name,
   CASE WHEN mase IS NOT NULL AND cm IS NOT NULL THEN mase ELSE rmse END AS n, CASE WHEN mase IS NOT NULL AND cm IS NOT NULL THEN cm ELSE cr END AS o FROM champ))"""


@query("compare_models", v.sql(
    "SELECT run_id, champion_id, metric_name, CASE WHEN metric_name IS NOT NULL THEN champion_metric END AS champion_metric, "
    "CASE WHEN metric_name IS NOT NULL THEN new_metric END AS new_metric, is_better, reason, round(gain, 6) AS gain FROM compared", champ=_CHAMPION, compared=_COMPARED))
def compare_models(spark, sf):
    out = monitor.compare_runs(v.model_runs(spark, sf))
    return rounded(out.select("run_id", "champion_id", "metric_name", "champion_metric", "new_metric", "is_better",
                              "reason", "gain"), 6, "gain")


@query("promotion_decision", v.sql(
    "SELECT run_id, champion_id, 'promote' AS always_policy, CASE WHEN is_better THEN 'promote' ELSE 'reject' END AS threshold_policy FROM compared",
    champ=_CHAMPION, compared=_COMPARED))
def promotion_decision(spark, sf):
    runs = v.model_runs(spark, sf)
    always = monitor.compare_runs(runs, "always").select("run_id", "champion_id", F.col("new_decision").alias("always_policy"))
    gated = monitor.compare_runs(runs, "threshold").select("run_id", F.col("new_decision").alias("threshold_policy"))
    return always.join(gated, "run_id")


@query("latest_run_metrics", v.sql(
    "SELECT run_id, mase, rmse, mape, trained_date AS last_trained FROM model_runs ORDER BY trained_date DESC, run_id DESC LIMIT 1"))
def latest_run_metrics(spark, sf):
    return monitor.latest_metrics(v.model_runs(spark, sf))


@query("run_log", v.sql(
    "SELECT 'inventory_recommendations_check' AS run_id, (SELECT max(ds) FROM sku_series) AS trained_date, 'promote' AS decision, "
    + r(4, rmse="min(rmse)", wape="min(wape)") + " FROM (SELECT sqrt(avg((y - yhat) ** 2)) AS rmse, sum(abs(y - yhat)) / sum(abs(y)) * 100 AS wape "
    "FROM bt GROUP BY model)", **BT))
def run_log(spark, sf):
    """One run appended to the log and read back."""
    series = plan.sku_series(v.family(spark, sf))
    errors = ev.metrics(ev.backtest(series), ("model",)).agg(
        F.min("rmse").alias("rmse"), F.min("wape").alias("wape"))
    record = monitor.run_record(
        "inventory_recommendations_check", series.agg(F.max("ds")).scalar(), errors, "promote",
        ["always"], "None", {"table": "sku_series"}, "scheduled", [])
    path = new_path(spark, "runs")
    sinks.append(record, path)
    return spark.read.parquet(path).select(
        "run_id", "trained_date", "decision", F.round(F.col("metrics")["rmse"], 4).alias("rmse"),
        F.round(F.col("metrics")["wape"], 4).alias("wape"))


@query("record_feedback", v.sql(
    "SELECT f.selected_sku, f.feedback, r.horizon, r.channel, r.total_forecasted_demand, r.safety_stock, r.reorder_point, r.eoq, count(*) AS n "
    "FROM feedback f JOIN recommendations r ON r.item_id = f.selected_sku GROUP BY ALL"))
def record_feedback(spark, sf):
    """Feedback events joined to the current recommendations of their SKU."""
    events = v.feedback(spark, sf).select("timestamp", "selected_sku", "feedback")
    rows = monitor.feedback_rows(events, plan.recommend(v.family(spark, sf)))
    return rows.groupBy(*[c for c in rows.columns if c != "timestamp"]).agg(F.count(F.lit(1)).alias("n"))


@query("executive_summary", v.sql(
    "SELECT (SELECT sum(qty) FROM family WHERE ds >= last - INTERVAL 1 MONTH) AS units_1m, (SELECT sum(qty) FROM family WHERE ds >= last - INTERVAL 3 MONTH) AS units_3m, "
    "(SELECT sum(qty) FROM family WHERE ds >= last - INTERVAL 6 MONTH) AS units_6m, f.* FROM (SELECT max(ds) AS last FROM family), (SELECT "
    + ", ".join(f"round(sum(total_forecasted_demand) FILTER (horizon = '{m}-Month'), 4) AS forecast_{m}m" for m in (1, 3, 6))
    + ", count(DISTINCT item_id) AS total_skus, count(*) AS total_records FROM recommendations) f"))
def executive_summary(spark, sf):
    daily = plan.daily_units(v.family(spark, sf))
    return rounded(monitor.executive_summary(daily, plan.recommend(daily)), 4, "forecast_1m", "forecast_3m", "forecast_6m")
