"""Joins of sales with stock, calendar, dimensions, classes and feedback."""

from pyspark.sql import functions as F

from catalog import views as v
from catalog.base import query, r, rounded
from larder.functions import cleaning as cl
from larder.operators import features as ft
from larder.operators import grid, inventory, promo
from larder.operators import sales as sl
from larder.plans import forecasting as plan
from larder.plans import prepare
from larder.sources import orders as od


def item_daily(lines):
    return lines.groupBy(cl.item_id().alias("item_id"), "sku", "channel", "ds").agg(F.sum("qty").alias("y"))


def item_grid(spark, sf):
    daily = item_daily(v.family(spark, sf))
    return grid.dense_panel(daily, "item_id", ("sku", "channel"), grid.day_span(v.family(spark, sf)))


def sku_grid(spark, sf):
    """Dense days of the family SKUs, nulls on empty days."""
    lines = v.family(spark, sf)
    daily = lines.groupBy(F.col("sku").alias("item_id"), "ds").agg(F.sum("qty").alias("y"))
    return grid.dense_panel(daily, span=grid.day_span(lines))


@query("join_inventory", v.sql(
    "SELECT sku, channel, ds, target, coalesce(warehouse_qty, 1) AS warehouse_qty FROM "
    "(SELECT sku, channel, ds, sum(qty) AS target FROM sales GROUP BY ALL) LEFT JOIN "
    "stock USING (sku, ds)"))
def join_inventory(spark, sf):
    """Daily sales with daily stock; a day without stock rows counts as in stock."""
    s = v.sales(spark, sf)
    daily = s.groupBy("sku", "channel", "ds").agg(F.sum("qty").alias("target"))
    return sl.join_stock(daily, v.stock(s)).select(
        "sku", "channel", "ds", "target", "warehouse_qty")


@query("calendar_grid", v.sql("SELECT item_id, sku, channel, ds, y FROM grid"))
def calendar_grid(spark, sf):
    return item_grid(spark, sf)


@query("join_static", v.sql(
    "SELECT g.item_id, g.sku, g.channel, s.category, s.gender, count(*) AS days, count(y) AS sale_days FROM grid g JOIN "
    "(SELECT sku, channel, min(category) AS category, min(gender) AS gender FROM family GROUP BY 1, 2) s "
    "ON s.sku = g.sku AND s.channel = g.channel GROUP BY ALL"))
def join_static(spark, sf):
    """Attributes travel with the item into the grid, so no join is needed afterwards."""
    lines = v.family(spark, sf)
    daily = lines.groupBy(cl.item_id().alias("item_id"), "sku", "channel", "ds").agg(F.sum("qty").alias("y"))
    items = sl.distinct_items(lines).select("item_id", "category", "gender")
    g = grid.dense_panel(daily.join(items, "item_id"), "item_id", ("sku", "channel", "category", "gender"),
                         grid.day_span(lines))
    return g.groupBy("item_id", "sku", "channel", "category", "gender").agg(
        F.count(F.lit(1)).alias("days"), F.count("y").alias("sale_days"))


@query("join_holidays", v.sql(
    "SELECT item_id, ds, y, coalesce(is_holiday, 0) AS is_holiday FROM item_daily LEFT JOIN holiday_days USING (ds)"))
def join_holidays(spark, sf):
    daily = item_daily(v.family(spark, sf)).select("item_id", "ds", "y")
    return sl.join_days(daily, sl.holiday_days(v.holidays(spark, sf)), {"is_holiday": 0})


@query("join_store_count", v.sql(
    "SELECT item_id, ds, y, " + r(6, store_count="coalesce(store_count, CASE WHEN ds > (SELECT max(ds) FROM store_days) "
    "THEN (SELECT max_by(store_count, ds) FROM store_days) ELSE (SELECT min_by(store_count, ds) FROM store_days) END)")
    + " FROM sku_daily LEFT JOIN store_days USING (ds)"))
def join_store_count(spark, sf):
    daily = v.family(spark, sf).groupBy(F.col("sku").alias("item_id"), "ds").agg(F.sum("qty").alias("y"))
    return rounded(sl.join_stores(daily, sl.store_days(v.store_count(spark, sf))), 6, "store_count")


_METAL = ("silver_price_change", "silver_price_ma_7", "gold_price_change", "gold_price_ma_7")


@query("join_metal_prices", v.sql(
    "SELECT item_id, ds, " + r(4, **{c: f"coalesce({c}, 0)" for c in _METAL})
    + " FROM sku_daily LEFT JOIN metal_features USING (ds)"))
def join_metal_prices(spark, sf):
    daily = v.family(spark, sf).select(F.col("sku").alias("item_id"), "ds").distinct()
    days = ft.metal_features(ft.metal_inr(v.metal_rates(spark, sf)))
    return rounded(sl.join_days(daily, days, ft.METAL_FILL), 4, *_METAL)


@query("join_feedback", v.sql(
    "SELECT item_id, ds, " + r(6, feedback_score_30d_avg="coalesce(last_value(avg30 IGNORE NULLS) OVER "
    "(PARTITION BY item_id ORDER BY ds ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0)")
    + " FROM grid LEFT JOIN feedback_days USING (item_id, ds)"))
def join_feedback(spark, sf):
    panel = item_grid(spark, sf).select("item_id", "ds")
    out = ft.join_feedback(panel, ft.feedback_daily(v.feedback(spark, sf)))
    return rounded(out, 6, "feedback_score_30d_avg")


@query("semi_top_skus", v.sql(
    "SELECT kind, sku, count(*) AS n, sum(amount) AS amount FROM (SELECT 'sales' AS kind, sku, qty AS amount FROM sales "
    "UNION ALL SELECT 'stock', sku, wh FROM inventory) WHERE sku IN (SELECT sku FROM "
    "(SELECT sku, sum(qty) AS units FROM sales GROUP BY 1) ORDER BY units DESC, sku LIMIT 50) GROUP BY 1, 2"))
def semi_top_skus(spark, sf):
    s = v.sales(spark, sf)
    top = sl.top_skus(s, 50)
    both = s.select(F.lit("sales").alias("kind"), "sku", F.col("qty").alias("amount")).unionByName(
        v.inventory(s).select(F.lit("stock").alias("kind"), "sku", F.col("wh").alias("amount")))
    return sl.keep_skus(both, top).groupBy("kind", "sku").agg(
        F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount"))


@query("join_class_map", v.sql(
    "SELECT i.sku, coalesce(c.class, 'C') AS class, " + v.z_sql("coalesce(c.class, 'C')") + " AS z FROM (SELECT DISTINCT sku FROM sales) i LEFT JOIN ("
    "SELECT sku, CASE WHEN position <= floor(n * 0.2::DOUBLE) THEN 'A' WHEN position <= floor(n * 0.2::DOUBLE) + floor(n * 0.3::DOUBLE) "
    "THEN 'B' ELSE 'C' END AS class FROM (SELECT sku, row_number() OVER (ORDER BY sum(qty) DESC, sku) AS position, count(*) OVER () AS n "
    "FROM sales GROUP BY sku)) c ON c.sku = i.sku"))
def join_class_map(spark, sf):
    """Classes by units; a SKU without a class defaults to C."""
    s = v.sales(spark, sf)
    classes = plan.volume_classes(s)
    out = s.select("sku").distinct().join(classes.select("sku", "class"), "sku", "left")
    return out.select("sku", F.coalesce("class", F.lit("C")).alias("class")).withColumn(
        "z", inventory.service_level_z())


@query("join_warehouse_map", v.sql(
    "SELECT channel, CASE channel WHEN 'Web' THEN 'central_online_wh' WHEN 'App' THEN 'central_online_wh' WHEN 'Offline' "
    "THEN 'central_offline_wh' WHEN 'Unknown' THEN 'main_wh' ELSE 'unknown_wh' END AS warehouse, sum(qty) AS units FROM "
    "(SELECT channel, qty FROM clean_sales UNION ALL SELECT 'Store', qty FROM sales) GROUP BY 1, 2"))
def join_warehouse_map(spark, sf):
    lines = sl.clean_sales(v.raw_sales(spark, sf)).select("channel", "qty").unionByName(
        v.sales(spark, sf).select(F.lit("Store").alias("channel"), "qty"))
    return lines.groupBy("channel", cl.warehouse_of().alias("warehouse")).agg(F.sum("qty").alias("units"))


@query("incremental_skus", v.sql(
    "SELECT item_id, latest, last_trained FROM (SELECT item_id, max(ds) AS latest FROM item_daily GROUP BY 1) "
    "LEFT JOIN training_status USING (item_id) WHERE last_trained IS NULL OR latest > last_trained"))
def incremental_skus(spark, sf):
    daily = v.family(spark, sf).select(cl.item_id().alias("item_id"), "ds")
    return sl.incremental(daily, v.training_status(spark, sf))


@query("event_window_sales", v.sql("SELECT sku, " + ", ".join(
    f"coalesce(sum(qty) FILTER (ds BETWEEN DATE '{d}' - {b} AND DATE '{d}' + {a}), 0) AS {n}_sales"
    for n, d, b, a in v.EVENTS) + " FROM sales GROUP BY 1"))
def event_window_sales(spark, sf):
    return promo.event_sales(v.sales(spark, sf), v.EVENTS)


_FLAGGED = """SELECT g.item_id, g.ds, g.y, coalesce(d.disc > 0, false) AS promo,
  coalesce(avg(CASE WHEN NOT coalesce(d.disc > 0, false) THEN coalesce(g.y, 0) END) OVER (PARTITION BY g.item_id ORDER BY g.ds
   ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING), 0) AS base FROM grid g
 LEFT JOIN (SELECT sku || '_' || channel AS item_id, ds, avg(disc) AS disc FROM family GROUP BY 1, 2) d ON d.item_id = g.item_id AND d.ds = g.ds"""


def promo_panel(spark, sf):
    lines = v.family(spark, sf)
    daily = lines.groupBy(cl.item_id().alias("item_id"), "ds").agg(
        F.sum("qty").alias("target"), F.avg("disc").alias("disc"))
    panel = grid.dense_panel(daily, span=grid.day_span(lines))
    return panel.withColumn("is_on_promotion", F.coalesce((F.col("disc") > 0).cast("int"), F.lit(0)))


@query("join_actual_forecast", v.sql(
    "SELECT item_id, ds, y AS actual, round(base, 6) AS forecast_no_promo, round(y - base, 6) AS lift_units FROM flagged WHERE promo",
    flagged=_FLAGGED))
def join_actual_forecast(spark, sf):
    """Promoted days with their no-promotion forecast, both sides keyed by item and day."""
    panel = promo_panel(spark, sf)
    forecast = promo.baseline(panel).select("item_id", "ds", "forecast_no_promo")
    actual = panel.where(F.col("is_on_promotion") == 1).select("item_id", "ds", F.col("target").alias("actual"))
    out = actual.join(forecast, ["item_id", "ds"])
    out = out.withColumn("lift_units", F.col("actual") - F.col("forecast_no_promo"))
    return rounded(out, 6, "forecast_no_promo", "lift_units")


@query("store_lookup", v.sql(
    "SELECT n_name AS channel, count(*) AS documents, sum(total_price) AS total FROM order_lines "
    "LEFT JOIN nation ON location_id = n_nationkey GROUP BY 1"))
def store_lookup(spark, sf):
    docs = od.store_channel(v.orders_nested(spark, sf), v.stores(spark, sf))
    return docs.groupBy("channel").agg(F.count(F.lit(1)).alias("documents"), F.sum("total_price").alias("total"))


@query("future_frame", v.sql(
    "SELECT item_id, step, ds, month(ds)::INTEGER AS month, (isodow(ds) - 1)::INTEGER AS day_of_week, "
    "(isodow(ds) >= 6)::INTEGER AS is_weekend, (month(ds) IN (10, 11, 12, 1, 2))::INTEGER AS is_wedding_season, "
    "(month(ds) IN (10, 11))::INTEGER AS is_diwali_period, (month(ds) = 2)::INTEGER AS is_valentine_month, "
    "coalesce(is_holiday, 0) AS is_holiday FROM sma LEFT JOIN holiday_days USING (ds)"))
def future_frame(spark, sf):
    lines = v.family(spark, sf)
    items = lines.select(cl.item_id().alias("item_id")).distinct()
    return prepare.future_covariates(items, grid.day_span(lines)[1], v.holidays(spark, sf))


@query("carry_last_covariates", v.sql(
    "SELECT f.item_id, f.step, coalesce(l.disc, (SELECT avg(disc) FROM lines)) AS disc, "
    "coalesce(l.qty, (SELECT avg(qty) FROM lines)) AS qty FROM sma f LEFT JOIN "
    "(SELECT item_id, max_by(disc, ds) AS disc, max_by(qty, ds) AS qty FROM lines GROUP BY 1) l USING (item_id)",
    lines="SELECT sku || '_' || channel AS item_id, ds, max(disc) AS disc, sum(qty) AS qty FROM family "
          "GROUP BY 1, 2"))
def carry_last_covariates(spark, sf):
    """The last known covariates of each item; an item without any takes the overall mean."""
    lines = v.family(spark, sf)
    items = lines.select(cl.item_id().alias("item_id")).distinct()
    future = grid.future_days(items, grid.day_span(lines)[1]).select("item_id", "step")
    panel = lines.groupBy(cl.item_id().alias("item_id"), "ds").agg(
        F.max("disc").alias("disc"), F.sum("qty").alias("qty"))
    return sl.carry_last(panel, ["disc", "qty"], future)
