"""Cleaning, projections and filters."""

from pyspark.sql import functions as F

from catalog import views as v
from catalog.base import query, r, rounded
from larder import config
from larder.functions import cleaning as cl
from larder.operators import forecast as fc
from larder.operators import sales as sl
from larder.plans import forecasting as plan

_COMMA = "coalesce(TRY_CAST(replace(qty, ',', '') AS DOUBLE), 0)"
_STRICT = "TRY_CAST(nullif(regexp_replace({c}, '[^0-9.-]', '', 'g'), '') AS DOUBLE)"


@query("clean_numeric_comma", v.sql(f"SELECT qty AS text, {_COMMA} AS value, count(*) AS n FROM raw_sales GROUP BY 1, 2"))
def clean_numeric_comma(spark, sf):
    return (v.raw_sales(spark, sf).select(F.col("qty").alias("text"), cl.comma_number("qty").alias("value"))
            .groupBy("text", "value").agg(F.count(F.lit(1)).alias("n")))


@query("clean_numeric_strict", v.sql(
    f"SELECT sku, {_STRICT.format(c='revenue')} AS revenue, {_STRICT.format(c='qty')} AS qty FROM raw_sales"))
def clean_numeric_strict(spark, sf):
    return v.raw_sales(spark, sf).select(
        "sku", cl.strict_number("revenue").alias("revenue"), cl.strict_number("qty").alias("qty"))


@query("clean_sales_dates", v.sql(
    f"SELECT created_at, day, count(*) AS n FROM (SELECT created_at, {v._DAY} AS day FROM raw_sales) "
    "WHERE day IS NOT NULL GROUP BY 1, 2"))
def clean_sales_dates(spark, sf):
    return (v.raw_sales(spark, sf).select("created_at", cl.any_day("created_at").alias("day"))
            .dropna(subset=["day"]).groupBy("created_at", "day").agg(F.count(F.lit(1)).alias("n")))


@query("clean_sales", v.sql("SELECT ds, sku, category, gender, channel, qty, disc FROM clean_sales"))
def clean_sales(spark, sf):
    return sl.clean_sales(v.raw_sales(spark, sf))


_REQUIRED = (f"SELECT {v._DAY} AS ds, sku, {_STRICT.format(c='qty')} AS qty, {_STRICT.format(c='revenue')} AS revenue, "
             f"{_STRICT.format(c='disc')} AS disc FROM raw_sales")


@query("clean_required", v.sql(f"SELECT * FROM ({_REQUIRED}) WHERE ds IS NOT NULL AND sku IS NOT NULL "
                               "AND qty IS NOT NULL AND revenue IS NOT NULL"))
def clean_required(spark, sf):
    return sl.clean_required(v.raw_sales(spark, sf))


@query("item_key", v.sql(
    "SELECT item_id, regexp_extract(item_id, '^(.*)_([^_]*)$', 1) AS sku, regexp_extract(item_id, '^(.*)_([^_]*)$', 2) AS channel, "
    "count(*) AS n FROM (SELECT sku || '_' || channel AS item_id FROM sales) GROUP BY 1"))
def item_key(spark, sf):
    ids = v.sales(spark, sf).select(cl.item_id().alias("item_id"))
    return ids.groupBy("item_id").agg(F.count(F.lit(1)).alias("n")).select(
        "item_id", cl.sku_of().alias("sku"), cl.channel_of().alias("channel"), "n")


@query("sku_category", v.sql(
    "SELECT sku, nullif(regexp_extract(sku, '^([A-Z]+)', 1), '') AS category, count(*) AS n FROM "
    "(SELECT sku FROM sales UNION ALL SELECT lower(sku) FROM family) GROUP BY 1, 2"))
def sku_category(spark, sf):
    skus = v.sales(spark, sf).select("sku").unionByName(v.family(spark, sf).select(F.lower("sku").alias("sku")))
    return skus.select("sku", cl.sku_category().alias("category")).groupBy("sku", "category").agg(
        F.count(F.lit(1)).alias("n"))


@query("order_exclusions", v.sql(
    "SELECT '#' || CAST(o_orderkey AS VARCHAR) AS name, email, tags, count(*) AS n FROM genuine_lines GROUP BY ALL"))
def order_exclusions(spark, sf):
    docs = v.orders_nested(spark, sf).where(cl.genuine_order())
    return docs.groupBy("name", "email", "tags").agg(F.count(F.lit(1)).alias("n"))


@query("sku_exclusions", v.sql(
    "SELECT sku, sum(qty) AS units FROM sales WHERE " + " AND ".join(
        f"sku NOT LIKE '{p}%'" for p in config.EXCLUDED_SKU_PREFIXES) + " AND sku NOT LIKE '%+%' GROUP BY 1"))
def sku_exclusions(spark, sf):
    return v.sales(spark, sf).where(cl.sellable_sku()).groupBy("sku").agg(F.sum("qty").alias("units"))


@query("wallet_final_price", v.sql(
    "SELECT '#' || CAST(o_orderkey AS VARCHAR) AS name, tags, total_price, final_price, count(*) AS n FROM order_lines GROUP BY ALL"))
def wallet_final_price(spark, sf):
    return (v.orders_nested(spark, sf).select("name", "tags", "total_price", cl.wallet_price().alias("final_price"))
            .groupBy("name", "tags", "total_price", "final_price").agg(F.count(F.lit(1)).alias("n")))


_ZEROED = "SELECT sku, ds, revenue, CASE WHEN line_no = 1 THEN 0 ELSE qty END AS qty FROM sales"


@query("unit_price_impute", v.sql(
    "SELECT p.sku, ds, revenue, qty, round(coalesce(unit_price, m, (SELECT quantile_cont(unit_price, 0.5) FROM priced)), 4) AS unit_price "
    "FROM priced p LEFT JOIN (SELECT sku, quantile_cont(unit_price, 0.5) AS m FROM priced GROUP BY sku) q ON q.sku = p.sku",
    priced=f"SELECT *, revenue / nullif(qty, 0) AS unit_price FROM ({_ZEROED})"))
def unit_price_impute(spark, sf):
    s = v.sales(spark, sf).select(
        "sku", "ds", "revenue", F.when(F.col("line_no") == 1, 0.0).otherwise(F.col("qty")).alias("qty"))
    return rounded(sl.unit_prices(s), 4, "unit_price")


@query("avg_net_price", v.sql(
    "SELECT sku, " + r(4, avg_price="avg((revenue - disc_amt) / qty)") + " FROM sales WHERE qty > 0 GROUP BY sku"))
def avg_net_price(spark, sf):
    s = v.sales(spark, sf).drop("disc").withColumnRenamed("disc_amt", "disc")
    return rounded(sl.average_net_price(s), 4, "avg_price")


@query("iqr_clip", v.sql(
    "SELECT item_id AS sku, ds, round(least(greatest(y, 0), q3 + 1.5::DOUBLE * (q3 - q1)), 6) AS y FROM sku_daily JOIN "
    "(SELECT item_id, quantile_cont(y, 0.25) AS q1, quantile_cont(y, 0.75) AS q3 FROM sku_daily GROUP BY 1) USING (item_id)"))
def iqr_clip(spark, sf):
    daily = v.family(spark, sf).groupBy("sku", "ds").agg(F.sum("qty").alias("y"))
    return rounded(sl.clip_outliers(daily), 6, "y")


@query("min_history_filter", v.sql(
    "SELECT sku || '_' || channel AS item_id, min(ds) AS first_ds, CAST(date_diff('day', min(ds), (SELECT max(ds) FROM sales)) + 1 AS INTEGER) AS history_days "
    "FROM sales GROUP BY 1 HAVING date_diff('day', min(ds), (SELECT max(ds) FROM sales)) + 1 > 183"))
def min_history_filter(spark, sf):
    return sl.min_history(v.sales(spark, sf).select(cl.item_id().alias("item_id"), "ds"))


@query("holiday_filter", v.sql(
    "SELECT DISTINCT ds, name AS holiday FROM holidays WHERE kind LIKE '%National holiday%' OR kind LIKE '%Optional holiday%'"))
def holiday_filter(spark, sf):
    return sl.named_holidays(v.holidays(spark, sf))


@query("period_slice", v.sql("SELECT sku, ds, qty FROM sales WHERE ds >= (SELECT max(ds) FROM sales) - 183"))
def period_slice(spark, sf):
    return sl.period_slice(v.sales(spark, sf).select("sku", "ds", "qty"), 184)


@query("reconcile_columns", v.sql(
    "SELECT item_id, ds, " + ", ".join("month(ds)::INTEGER AS month" if c == "month" else f"0 AS {c}"
                                       for c in config.KNOWN_COVARIATES) + " FROM item_daily"))
def reconcile_columns(spark, sf):
    daily = v.family(spark, sf).groupBy(cl.item_id().alias("item_id"), "ds").agg(F.sum("qty").alias("y"))
    return sl.reconcile(daily.withColumn("month", F.month("ds")), config.KNOWN_COVARIATES, ("item_id", "ds"))


@query("non_negative_int_forecast", v.sql(
    "SELECT item_id, step, CAST(round_even(greatest(mean - 5, 0), 0) AS INTEGER) AS units FROM sma"))
def non_negative_int_forecast(spark, sf):
    f = fc.sma(plan.item_lines(v.family(spark, sf)))
    return f.select("item_id", "step", cl.units(F.col("mean") - 5).alias("units"))
