"""Inventory metrics, recommendations and what-if scenarios."""

from pyspark.sql import functions as F

from catalog import views as v
from catalog.base import query, r, rounded
from catalog.forecasting import _LEVELS, _MASTER, _quantile_sql
from larder import config
from larder.operators import forecast as fc
from larder.operators import inventory
from larder.plans import batch
from larder.plans import forecasting as plan
from larder.session import new_path

_METRICS = ("mu", "sigma", "lead_time_demand", "safety_stock", "reorder_point", "eoq")


@query("inventory_metrics", v.sql(
    "SELECT item_id, horizon, class, " + r(5, mu="mu", sigma="sigma", lead_time_demand="lead_time_demand", safety_stock="safety_stock",
                                           reorder_point="lead_time_demand + safety_stock", eoq="eoq") + " FROM stock_metrics"))
def inventory_metrics(spark, sf):
    s = v.family(spark, sf)
    table = inventory.forecast_by_horizon(fc.seasonal_naive(plan.item_lines(s)))
    out = inventory.inventory_metrics(table, plan.volume_classes(s))
    return rounded(out.select("item_id", "horizon", "class", *_METRICS), 5, *_METRICS)


_Z95 = repr(config.z_score(0.95))
_PRICED = {
    "lead_time_demand": "f * 21", "safety_stock": f"{_Z95}::DOUBLE * d * sqrt(21.0::DOUBLE)",
    "reorder_point": f"f * 21 + {_Z95}::DOUBLE * d * sqrt(21.0::DOUBLE)",
    "eoq": "greatest(20, CASE WHEN 0.1::DOUBLE * p > 0 THEN sqrt(2.0::DOUBLE * f * 365 * (0.3::DOUBLE * p) / (0.1::DOUBLE * p)) ELSE 0 END)"}


@query("inventory_metrics_priced", v.sql(
    "SELECT item_id, " + r(4, **_PRICED) + ", " + r(1, holding_cost="0.1::DOUBLE * p * f * 365", ordering_cost="0.3::DOUBLE * p")
    + " FROM (SELECT item_id, avg(mean) AS f FROM naive_sku GROUP BY 1) JOIN (SELECT item_id, stddev_samp(y) AS d FROM sku_series GROUP BY 1) USING (item_id) "
      "JOIN (SELECT sku AS item_id, avg(revenue / qty) AS p FROM family GROUP BY 1) USING (item_id)",
    naive_sku="SELECT h.item_id, h.y AS mean FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY ds DESC) AS age FROM sku_series) h "
              "JOIN (SELECT unnest(generate_series(1, 183)) AS step) s ON h.age = 7 - (s.step - 1) % 7"))
def inventory_metrics_priced(spark, sf):
    """Price-based variant at SKU grain: forecast mean, history spread, mean unit price."""
    s = v.family(spark, sf)
    lines = s.select(F.col("sku").alias("item_id"), "ds", F.col("qty").alias("y"))
    fcst = fc.seasonal_naive(lines).groupBy("item_id").agg(F.avg("mean").alias("avg_forecast"))
    spread = plan.sku_series(s).groupBy("item_id").agg(F.stddev_samp("y").alias("demand_std"))
    price = s.groupBy(F.col("sku").alias("item_id")).agg(F.avg(F.try_divide("revenue", "qty")).alias("price"))
    out = inventory.priced_metrics(fcst.join(spread, "item_id").join(price, "item_id"))
    out = rounded(out, 4, *_PRICED)
    return rounded(out, 1, "holding_cost", "ordering_cost").drop("avg_forecast", "demand_std", "price")


@query("recommendations", v.sql("SELECT * FROM recommendations"))
def recommendations(spark, sf):
    return plan.recommend(v.family(spark, sf))


# The same chain at part grain, from sparse lines.
_PARTS = {
    "item_lines": "SELECT sku || '_' || channel AS item_id, ds, qty AS y FROM sales",
    "part_tail": "SELECT item_id, date_diff('day', ds, last) + 1 AS age, sum(y) AS y FROM item_lines, (SELECT max(ds) AS last FROM item_lines) "
                 "WHERE ds > last - 7 GROUP BY 1, 2",
    "naive": "SELECT i.item_id, s.step, coalesce(t.y, 0) AS mean FROM (SELECT DISTINCT item_id FROM item_lines) i "
             "CROSS JOIN (SELECT CAST(unnest(generate_series(1, 183)) AS INTEGER) AS step) s "
             "LEFT JOIN part_tail t ON t.item_id = i.item_id AND t.age = 7 - (s.step - 1) % 7",
    "volume": "SELECT sku, sum(qty) AS units FROM sales GROUP BY sku",
}


@query("recommendations_parts", v.sql("SELECT * FROM recommendations", **_PARTS))
def recommendations_parts(spark, sf):
    """The flagship: every part and channel, three horizons, with class, stock and order sizes."""
    return plan.recommend(v.sales(spark, sf))


@query("service_level_z", v.sql("SELECT sku, class, " + v.z_sql("class") + " AS z FROM abc"))
def service_level_z(spark, sf):
    return plan.volume_classes(v.family(spark, sf)).select("sku", "class").withColumn("z", inventory.service_level_z())


SCENARIOS = [("base", 50.0, 5.0, 14), ("cheap_orders", 10.0, 5.0, 14), ("slow_supplier", 50.0, 5.0, 60)]


@query("eoq_what_if", v.sql(
    "SELECT sku, annual_demand, scenario, order_cost, hold_cost, lead_days, " + r(
        6, eoq="sqrt(2.0::DOUBLE * annual_demand * order_cost / hold_cost)", reorder_point="annual_demand / 365.0::DOUBLE * lead_days")
    + " FROM (SELECT sku, sum(qty) AS annual_demand FROM sales GROUP BY 1), (VALUES "
    + ", ".join(f"('{n}', {s}::DOUBLE, {h}::DOUBLE, {t})" for n, s, h, t in SCENARIOS) + ") c(scenario, order_cost, hold_cost, lead_days)"))
def eoq_what_if(spark, sf):
    demand = v.sales(spark, sf).groupBy("sku").agg(F.sum("qty").alias("annual_demand"))
    return rounded(inventory.eoq_what_if(demand, SCENARIOS), 6, "eoq", "reorder_point")


# The contest on item series, and the winner's or the blend's forecast in place of the naive one.
_BATCH = {**_MASTER, "sku_series": "SELECT * FROM item_series",
          "naive": "SELECT item_id, step, mean FROM m_models JOIN m_pick USING (item_id) WHERE model = champion"}


@query("batch_run", v.sql("SELECT * FROM recommendations", **_BATCH))
def batch_run(spark, sf):
    """Two runs of the batch: the second finds nothing new, is promoted by policy and keeps the first one's rows."""
    folder = new_path(spark, "batch")
    batch.batch_run(v.family(spark, sf), folder, "run_1")
    return batch.batch_run(v.family(spark, sf), folder, "run_2", "always")


@query("batch_log", v.sql(
    "SELECT * FROM (VALUES ('run_1', 'promote', 'first_run', 'None'), ('run_2', 'reject', 'not_better', 'run_1'), "
    "('run_10', 'promote', 'not_better', 'run_1')) l(run_id, decision, reason, champion_id), "
    "(SELECT " + r(4, mase="min(mase)", rmse="min(rmse)") + " FROM (SELECT model, avg(mase) AS mase, avg(rmse) AS rmse FROM errors "
    "JOIN (SELECT model, item_id, mase FROM mase_rows) USING (model, item_id) GROUP BY 1))", **_BATCH))
def batch_log(spark, sf):
    """The log of three runs over the same sales: first, rejected by the gate, promoted by policy."""
    folder, lines = new_path(spark, "batch"), v.family(spark, sf)
    for run_id, policy in (("run_1", "threshold"), ("run_2", "threshold"), ("run_10", "always")):
        batch.batch_run(lines, folder, run_id, policy)
    return spark.read.parquet(f"{folder}/log").select(
        "run_id", "decision", F.col("reasons")[0].alias("reason"), "champion_id", F.round(F.col("metrics")["mase"], 4).alias("mase"),
        F.round(F.col("metrics")["rmse"], 4).alias("rmse"))


@query("batch_forecasts", v.sql(
    "SELECT item_id, champion AS model, count(*) AS days, " + r(4, mean="sum(mean)", **{n: f"sum({n})" for n in _LEVELS}) + " FROM quantiled GROUP BY 1, 2",
    **_BATCH, **{
        "bt_all": "SELECT item_id, win, step, ds, y, model, yhat FROM bt UNION ALL SELECT item_id, win, step, ds, y, 'Ensemble', sum(weight * yhat) FROM bt "
                  "JOIN bt_weights USING (item_id, model) GROUP BY item_id, win, step, ds, y",
        "all_scale": "SELECT model, item_id, avg(abs(y - yhat)) AS scale FROM bt_all GROUP BY 1, 2",
        "all_scaled": "SELECT * FROM bt_all JOIN all_scale USING (model, item_id)",
        "all_q": _quantile_sql("all_scaled"),
        "quantiled": "SELECT m.item_id, p.champion, m.mean, " + ", ".join(f"greatest(mean + coalesce(scale * r{n}, 0), 0) AS {n}" for n in _LEVELS)
                     + " FROM m_models m JOIN m_pick p ON p.item_id = m.item_id AND p.champion = m.model LEFT JOIN all_q q ON q.model = m.model "
                       "AND q.bucket = (m.step - 1) // 30 LEFT JOIN all_scale i ON i.model = m.model AND i.item_id = m.item_id"}))
def batch_forecasts(spark, sf):
    """The days that a run publishes: each item's champion or blend, with quantiles of its own backtest."""
    folder = new_path(spark, "batch")
    batch.batch_run(v.family(spark, sf), folder, "run_1")
    days = spark.read.parquet(f"{folder}/forecasts/run_id=run_1")
    return rounded(days.groupBy("item_id", "model").agg(F.count(F.lit(1)).alias("days"), *[F.sum(c).alias(c) for c in ("mean", *_LEVELS)]),
                   4, "mean", *_LEVELS)
