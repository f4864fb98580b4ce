"""Aggregations: daily sales, classes, statistics, months, warehouse sales."""

from pyspark.sql import functions as F

from catalog import views as v
from catalog.base import query, r, rounded
from catalog.forecasting import _INTERVALS, BT, intervals
from larder import config
from larder.functions import cleaning as cl
from larder.operators import features as ft
from larder.operators import forecast as fc
from larder.operators import monitor, segment
from larder.operators import sales as sl
from larder.plans import forecasting as plan
from larder.sources import orders as od


@query("daily_sales_agg", v.sql(
    "SELECT sku || '_' || channel AS item_id, sku, channel, ds, sum(qty) AS target, avg(disc) AS disc, "
    "max(category) AS category, max(gender) AS gender FROM clean_sales WHERE sku IS NOT NULL GROUP BY ALL"))
def daily_sales_agg(spark, sf):
    return sl.daily_sales(sl.clean_sales(v.raw_sales(spark, sf)))


@query("daily_sales_agg_analysis", v.sql(
    "SELECT sku || '_' || channel AS item_id, sku, ds, sum(qty) AS target, avg(disc) AS disc, "
    "max((disc > 0)::INTEGER) AS is_on_promotion, max((disc > coalesce(threshold, 0))::INTEGER) AS is_high_discount FROM sales LEFT JOIN "
    "(SELECT sku, quantile_cont(disc, 0.75) AS threshold FROM sales WHERE disc > 0 GROUP BY 1) USING (sku) GROUP BY ALL"))
def daily_sales_agg_analysis(spark, sf):
    s = v.sales(spark, sf)
    flagged = s.join(ft.discount_thresholds(s), "sku", "left").withColumns(ft.promo_flags())
    return flagged.groupBy(cl.item_id().alias("item_id"), "sku", "ds").agg(
        F.sum("qty").alias("target"), F.avg("disc").alias("disc"),
        F.max("is_on_promotion").alias("is_on_promotion"), F.max("is_high_discount").alias("is_high_discount"))


@query("inventory_daily", v.sql("SELECT sku, ds, warehouse_qty FROM stock"))
def inventory_daily(spark, sf):
    raw = v.inventory(v.sales(spark, sf))
    return sl.daily_stock(raw.select(cl.any_day("date").alias("ds"), "sku", "wh"))


def sku_frame(spark, sf):
    lines = v.family(spark, sf)
    return sl.sku_frame(lines, sl.store_days(v.store_count(spark, sf)), v.stock(lines))


@query("sku_model_frame", v.sql(
    "SELECT sku, ds, " + r(6, y="y", store_count="store_count") + ", disc, revenue, was_stocked_out FROM sku_frame"))
def sku_model_frame(spark, sf):
    return rounded(sku_frame(spark, sf), 6, "y", "store_count")


def part_totals(spark, sf, c, name):
    return v.sales(spark, sf).groupBy("sku").agg(F.sum(c).alias(name))


_ABC = """SELECT sku, units, position, CASE WHEN position <= floor(n * 0.2::DOUBLE) THEN 'A'
  WHEN position <= floor(n * 0.2::DOUBLE) + floor(n * 0.3::DOUBLE) THEN 'B' ELSE 'C' END AS class FROM
 (SELECT sku, sum(qty) AS units, row_number() OVER (ORDER BY sum(qty) DESC, sku) AS position, count(*) OVER () AS n FROM sales GROUP BY sku)"""


@query("abc_by_volume", v.sql(_ABC))
def abc_by_volume(spark, sf):
    return segment.abc_by_volume(part_totals(spark, sf, "qty", "units"))


_SHARES = """SELECT sku, revenue, sum(revenue) OVER w AS cumulative_revenue,
  sum(revenue) OVER w / sum(revenue) OVER () * 100 AS cumulative_pct FROM (SELECT sku, sum(revenue) AS revenue FROM sales GROUP BY 1)
  WINDOW w AS (ORDER BY revenue DESC, sku ROWS UNBOUNDED PRECEDING)"""


@query("abc_pareto", v.sql(
    "SELECT *, CASE WHEN cumulative_pct <= 80 THEN 'A' WHEN cumulative_pct <= 95 THEN 'B' ELSE 'C' END AS class FROM shares",
    shares=_SHARES))
def abc_pareto(spark, sf):
    return segment.abc_pareto(part_totals(spark, sf, "revenue", "revenue"))


@query("cumulative_share", v.sql(_SHARES))
def cumulative_share(spark, sf):
    return segment.revenue_shares(part_totals(spark, sf, "revenue", "revenue"))


@query("class_counts", v.sql("SELECT class, count(*) AS skus FROM abc_parts GROUP BY 1", abc_parts=_ABC))
def class_counts(spark, sf):
    return abc_by_volume(spark, sf).groupBy("class").agg(F.count(F.lit(1)).alias("skus"))


@query("sku_stats", v.sql("SELECT sku, count(qty) AS count, avg(qty) AS mean, " + r(6, std="stddev_samp(qty)")
                          + " FROM sales GROUP BY 1"))
def sku_stats(spark, sf):
    return rounded(segment.sku_stats(v.sales(spark, sf)), 6, "std")


@query("sku_attributes", v.sql(
    "SELECT sku, " + r(4, avg_sales="avg(y)", std_sales="stddev_samp(y)", max_sales="max(y)",
                       coefficient_of_variation="CASE WHEN avg(y) > 0 THEN stddev_samp(y) / avg(y) ELSE 0 END",
                       zero_sales_ratio="avg((y = 0)::INTEGER)",
                       acf_lag_7="coalesce(sum((y - m) * (y7 - m)), 0) / nullif(sum((y - m) * (y - m)), 0)")
    + ", count(*) AS days FROM (SELECT *, avg(y) OVER (PARTITION BY sku) AS m, "
      "lag(y, 7) OVER (PARTITION BY sku ORDER BY ds) AS y7 FROM sku_frame) GROUP BY 1"))
def sku_attributes(spark, sf):
    out = segment.sku_attributes(sku_frame(spark, sf))
    return rounded(out, 4, *[c for c in out.columns if c not in ("sku", "days")])


@query("sporadic_flag", v.sql(
    "SELECT item_id, " + r(6, zero_ratio="avg((y = 0)::INTEGER)")
    + ", (avg((y = 0)::INTEGER) > 0.6::DOUBLE)::INTEGER AS is_sporadic FROM item_series GROUP BY 1"))
def sporadic_flag(spark, sf):
    return rounded(segment.sporadic(plan.item_series(v.family(spark, sf)), "y", "item_id"), 6, "zero_ratio")


@query("discount_threshold", v.sql(
    "SELECT sku, " + r(6, threshold="quantile_cont(disc, 0.75)") + " FROM (SELECT sku, channel, ds, avg(disc) AS disc FROM sales "
    "GROUP BY ALL) WHERE disc > 0 GROUP BY 1"))
def discount_threshold(spark, sf):
    daily = v.sales(spark, sf).groupBy("sku", "channel", "ds").agg(F.avg("disc").alias("disc"))
    return rounded(ft.discount_thresholds(daily), 6, "threshold")


@query("last_n_months_sales", v.sql("SELECT sku, " + ", ".join(
    f"coalesce(sum(qty) FILTER (ds >= last - INTERVAL {m} MONTH), 0) AS units_{m}m, "
    f"count(*) FILTER (ds >= last - INTERVAL {m} MONTH) AS records_{m}m" for m in (1, 3, 6))
    + " FROM sales, (SELECT max(ds) AS last FROM sales) WHERE ds >= last - INTERVAL 6 MONTH GROUP BY 1"))
def last_n_months_sales(spark, sf):
    return sl.last_months(v.sales(spark, sf))


_ROLL = {f"forecast_next_{m}_months": f"sum(mean) FILTER (step <= {d})" for m, d in ((1, 30), (3, 90), (6, 183))}
_WIDTH = {f"interval_width_{m}_months": f"avg(greatest(q90 - q10, 0)) FILTER (step <= {d})" for m, d in ((1, 30), (3, 90))}


@query("forecast_rollup", v.sql(
    "SELECT item_id, " + r(5, **_ROLL, **_WIDTH) + " FROM intervals WHERE model = 'SeasonalNaive' GROUP BY 1", **_INTERVALS, **BT))
def forecast_rollup(spark, sf):
    """Sums of the naive forecast and the widths of its residual intervals."""
    out = fc.rollup(intervals(spark, sf).where("model = 'SeasonalNaive'"))
    return rounded(out, 5, *[c for c in out.columns if c != "item_id"])


@query("horizon_totals", v.sql(
    "SELECT horizon, " + r(4, forecast_units="sum(total_forecasted_demand)") + " FROM recommendations GROUP BY 1"))
def horizon_totals(spark, sf):
    return rounded(monitor.horizon_totals(plan.recommend(v.family(spark, sf))), 4, "forecast_units")


@query("sku_reorder_total", v.sql(
    "SELECT item_id, CAST(sum(reorder_point) AS BIGINT) AS reorder_point FROM recommendations WHERE horizon = '1-Month' GROUP BY 1"))
def sku_reorder_total(spark, sf):
    return monitor.reorder_totals(plan.recommend(v.family(spark, sf)))


def _sales_sql(name):
    return v.sql(f"SELECT ds, sku, channel, quantity, round(revenue, 2) AS revenue FROM {name}")


@query("sales_by_channel_pos", _sales_sql("pos_sales"))
def sales_by_channel_pos(spark, sf):
    return rounded(od.pos_sales(od.genuine(v.orders_nested(spark, sf)), v.stores(spark, sf)), 2, "revenue")


@query("sales_by_channel_web", _sales_sql("web_sales"))
def sales_by_channel_web(spark, sf):
    return rounded(od.web_sales(od.genuine(v.orders_nested(spark, sf))), 2, "revenue")


@query("sales_by_channel_app", _sales_sql("app_sales"))
def sales_by_channel_app(spark, sf):
    return rounded(od.app_sales(od.genuine(v.orders_nested(spark, sf))), 2, "revenue")


@query("sales_all_channels", v.sql(
    "SELECT ds, sku, channel, sum(quantity) AS quantity, round(sum(revenue), 2) AS revenue FROM (SELECT * FROM pos_sales "
    "UNION ALL SELECT * FROM app_sales UNION ALL SELECT * FROM web_sales) WHERE " + " AND ".join(
        f"sku NOT LIKE '{p}%'" for p in config.EXCLUDED_SKU_PREFIXES) + " GROUP BY 1, 2, 3 ORDER BY ds DESC, sku"))
def sales_all_channels(spark, sf):
    out = od.all_sales(v.orders_nested(spark, sf), v.stores(spark, sf))
    return rounded(out, 2, "revenue").orderBy(F.desc("ds"), "sku")


@query("sales_master", v.sql(
    "SELECT sku, source, sum(q) AS qty, round(sum(rev), 1) AS revenue FROM ("
    "SELECT sku, 'web' AS source, quantity AS q, quantity * price - discount AS rev FROM order_items WHERE source_name = 'web' AND price <> 0 "
    "UNION ALL SELECT sku, 'app', quantity, price / total_price * final_price * quantity - first_discount FROM order_items "
    "WHERE source_name IN ('android', 'ios') AND price <> 0) WHERE " + " AND ".join(
        f"sku NOT LIKE '{p}%'" for p in config.EXCLUDED_SKU_PREFIXES) + " GROUP BY 1, 2"))
def sales_master(spark, sf):
    out = od.master_sales(v.orders_nested(spark, sf))
    return rounded(out, 1, "revenue").orderBy(F.desc("qty"))


@query("category_series", v.sql(
    "SELECT nullif(regexp_extract(sku, '^([A-Z]+)', 1), '') AS category, ds, sum(qty) AS y FROM sales WHERE sku IN "
    "(SELECT sku FROM sales GROUP BY 1 HAVING count(*) >= 30) GROUP BY 1, 2"))
def category_series(spark, sf):
    return sl.category_series(v.sales(spark, sf))
