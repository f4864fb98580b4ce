"""Windows over the dense panel, scalar features, rankings, set operations and compositions."""

from pyspark.sql import functions as F

from catalog import views as v
from catalog.aggregates import sku_frame
from catalog.base import query, r, rounded
from catalog.forecasting import BT
from catalog.joins import sku_grid
from larder.functions import calendar as cal
from larder.functions import cleaning as cl
from larder.operators import features as ft
from larder.operators import forecast as fc
from larder.operators import grid, monitor, ordered, promo
from larder.operators import sales as sl
from larder.plans import batch, prepare
from larder.plans import forecasting as plan
from larder.session import new_path
from larder.sources import artefacts, snapshots, tables
from larder.streaming import ingest

_W = "(PARTITION BY item_id ORDER BY ds)"


def prev(expr: str, n: int, key: str = "item_id") -> str:
    return f"{expr} OVER (PARTITION BY {key} ORDER BY ds ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"


# ---- windows ------------------------------------------------------------------------------

@query("lag_features", v.sql("SELECT item_id, ds, " + ", ".join(
    f"coalesce(lag(y, {n}) OVER {_W}, 0) AS sales_lag_{n}" for n in (1, 7, 14, 30)) + " FROM sku_grid"))
def lag_features(spark, sf):
    return sku_grid(spark, sf).select("item_id", "ds", *[c.alias(n) for n, c in ft.lags("y").items()])


@query("rolling_mean", v.sql("SELECT item_id, ds, " + r(6, **{
    f"sales_ma_{n}": f"coalesce({prev('avg(y)', n)}, 0)" for n in (7, 14, 30)}) + " FROM sku_grid"))
def rolling_mean(spark, sf):
    out = sku_grid(spark, sf).select("item_id", "ds", *[c.alias(n) for n, c in ft.rolling_means("y").items()])
    return rounded(out, 6, "sales_ma_7", "sales_ma_14", "sales_ma_30")


@query("rolling_std", v.sql("SELECT item_id, ds, " + r(5, **{
    f"sales_std_{n}": f"coalesce({prev('stddev_samp(y)', n)}, 0)" for n in (7, 30)}) + " FROM sku_grid"))
def rolling_std(spark, sf):
    out = sku_grid(spark, sf).select("item_id", "ds", *[c.alias(n) for n, c in ft.rolling_stds("y").items()])
    return rounded(out, 5, "sales_std_7", "sales_std_30")


_STOCK_GRID = ("SELECT g.*, (coalesce(warehouse_qty, 1) <= 0)::INTEGER AS was_stocked_out FROM sku_grid g LEFT JOIN stock_family s "
               "ON s.sku = g.item_id AND s.ds = g.ds AND g.y IS NOT NULL")


def stock_grid(spark, sf):
    lines = v.family(spark, sf)
    daily = lines.groupBy("sku", "ds").agg(F.sum("qty").alias("y"))
    daily = sl.join_stock(daily, v.stock(lines)).withColumnRenamed("sku", "item_id")
    return grid.dense_panel(daily, span=grid.day_span(lines)).withColumn("was_stocked_out", ft.stockout_flag())


@query("rolling_stockouts", v.sql(
    f"SELECT item_id, ds, was_stocked_out, CAST(coalesce({prev('sum(was_stocked_out)', 7)}, 0) AS BIGINT) AS stockout_days_last_7 FROM sg",
    sg=_STOCK_GRID))
def rolling_stockouts(spark, sf):
    return stock_grid(spark, sf).select("item_id", "ds", "was_stocked_out",
                                        ft.rolling_count(F.col("was_stocked_out") == 1).alias("stockout_days_last_7"))


@query("rolling_sale_days", v.sql(
    f"SELECT item_id, ds, CAST(coalesce({prev('sum((coalesce(y, 0) > 0)::INTEGER)', 7)}, 0) AS BIGINT) AS days_with_sales_last_7d FROM sku_grid"))
def rolling_sale_days(spark, sf):
    return sku_grid(spark, sf).select("item_id", "ds", ft.rolling_count(F.col("y") > 0).alias("days_with_sales_last_7d"))


@query("time_since_last_sale", v.sql(
    "SELECT item_id, ds, CAST(coalesce(date_diff('day', max(CASE WHEN y > 0 THEN ds END) OVER (PARTITION BY item_id ORDER BY ds "
    "ROWS UNBOUNDED PRECEDING), ds), 0) AS INTEGER) AS time_since_last_sale FROM sku_grid"))
def time_since_last_sale(spark, sf):
    return sku_grid(spark, sf).select("item_id", "ds", ft.days_since_sale("y").alias("time_since_last_sale"))


_FILL = ("coalesce(last_value(y IGNORE NULLS) OVER (PARTITION BY item_id ORDER BY ds ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), "
         "first_value(y IGNORE NULLS) OVER (PARTITION BY item_id ORDER BY ds ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))")


@query("fill_forward_back", v.sql(f"SELECT item_id, ds, {_FILL} AS y FROM sku_grid"))
def fill_forward_back(spark, sf):
    return sku_grid(spark, sf).withColumn("y", grid.fill_forward_back("y"))


@query("feedback_30d", v.sql("SELECT item_id, epoch_us(ts) AS at, CAST(ts AS DATE) AS ds, "
                             + r(6, feedback_score_30d_avg="avg30") + " FROM feedback_avg"))
def feedback_30d(spark, sf):
    return rounded(ft.feedback_30d(v.feedback(spark, sf)), 6, "feedback_score_30d_avg")


@query("price_change", v.sql("SELECT ds, " + r(6, silver_price_change="silver_price_change", gold_price_change="gold_price_change")
                             + " FROM metal_features"))
def price_change(spark, sf):
    out = ft.metal_features(ft.metal_inr(v.metal_rates(spark, sf))).select("ds", "silver_price_change", "gold_price_change")
    return rounded(out, 6, "silver_price_change", "gold_price_change")


@query("price_ma7", v.sql("SELECT ds, " + r(3, silver_price_ma_7="silver_price_ma_7", gold_price_ma_7="gold_price_ma_7")
                          + " FROM metal_features"))
def price_ma7(spark, sf):
    out = ft.metal_features(ft.metal_inr(v.metal_rates(spark, sf))).select("ds", "silver_price_ma_7", "gold_price_ma_7")
    return rounded(out, 3, "silver_price_ma_7", "gold_price_ma_7")


_LINE = """SELECT item_id, ds, CASE WHEN y IS NOT NULL THEN y WHEN ny IS NULL THEN py
  ELSE py + (ny - py) * (date_diff('day', pd, ds) / CAST(date_diff('day', pd, nd) AS DOUBLE)) END AS y, ny FROM
 (SELECT *, last_value(y IGNORE NULLS) OVER b AS py, last_value(CASE WHEN y IS NOT NULL THEN ds END IGNORE NULLS) OVER b AS pd,
  first_value(y IGNORE NULLS) OVER f AS ny, first_value(CASE WHEN y IS NOT NULL THEN ds END IGNORE NULLS) OVER f AS nd FROM sku_grid
  WINDOW b AS (PARTITION BY item_id ORDER BY ds ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
   f AS (PARTITION BY item_id ORDER BY ds ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


@query("interp_linear", v.sql("SELECT item_id, ds, round(y, 6) AS y FROM line", line=_LINE))
def interp_linear(spark, sf):
    return rounded(grid.interpolate(sku_grid(spark, sf), "y"), 6, "y")


@query("dedup_keep_last", v.sql(
    "SELECT sku, channel, ds, qty, revenue FROM (SELECT *, row_number() OVER (PARTITION BY sku, channel, ds ORDER BY order_key DESC, "
    "line_no DESC, supp_key DESC, list_price DESC) AS rn FROM sales) WHERE rn = 1"))
def dedup_keep_last(spark, sf):
    s = v.sales(spark, sf).select("sku", "channel", "ds", "qty", "revenue", "order_key", "line_no", "supp_key", "list_price")
    last = ordered.newest(s, ["sku", "channel", "ds"], [F.col(c) for c in ("order_key", "line_no", "supp_key", "list_price")])
    return last.select("sku", "channel", "ds", "qty", "revenue")


@query("sliding_sequences", v.sql(
    "SELECT item_id, ds, y, y2 AS first_y, y1 AS last_y, w1 + w2 AS weekday_sum FROM (SELECT *, lag(y, 1) OVER w AS y1, lag(y, 2) OVER w AS y2, "
    "CAST(lag(isodow(ds) - 1, 1) OVER w AS DOUBLE) AS w1, CAST(lag(isodow(ds) - 1, 2) OVER w AS DOUBLE) AS w2 FROM sku_series "
    "WINDOW w AS (PARTITION BY item_id ORDER BY ds)) WHERE y2 IS NOT NULL"))
def sliding_sequences(spark, sf):
    """Two-day windows of (units, weekday) and the next day's units."""
    s = plan.sku_series(v.family(spark, sf)).withColumn("weekday", F.weekday("ds"))
    seq = grid.sliding_sequences(s, ["y", "weekday"], "y", 2)
    return seq.select("item_id", "ds", "y", F.col("steps")[0][0].alias("first_y"), F.col("steps")[1][0].alias("last_y"),
                      (F.col("steps")[0][1] + F.col("steps")[1][1]).alias("weekday_sum"))


@query("temporal_split", v.sql(
    "SELECT item_id, part, count(*) AS days, min(ds) AS first_ds, max(ds) AS last_ds, sum(y) AS units FROM (SELECT *, CASE WHEN pos > n - 7 THEN 'test' "
    "WHEN pos <= floor((n - 7) * 0.8::DOUBLE) THEN 'train' ELSE 'validation' END AS part FROM (SELECT *, row_number() OVER "
    "(PARTITION BY item_id ORDER BY ds) AS pos, count(*) OVER (PARTITION BY item_id) AS n FROM sku_daily)) GROUP BY 1, 2"))
def temporal_split(spark, sf):
    daily = v.family(spark, sf).groupBy(F.col("sku").alias("item_id"), "ds").agg(F.sum("qty").alias("y"))
    return grid.temporal_split(daily).groupBy("item_id", "part").agg(
        F.count(F.lit(1)).alias("days"), F.min("ds").alias("first_ds"), F.max("ds").alias("last_ds"), F.sum("y").alias("units"))


# ---- top-k and order ----------------------------------------------------------------------

@query("top_n_skus", v.sql("SELECT sku, sum(qty) AS units FROM sales GROUP BY 1 ORDER BY units DESC, sku LIMIT 50"))
def top_n_skus(spark, sf):
    return sl.top_skus(v.sales(spark, sf), 50)


@query("top_skus_by_forecast", v.sql(" UNION ALL ".join(
    f"SELECT * FROM (SELECT {m} AS months, item_id, round(sum(total_forecasted_demand), 4) AS forecast_units FROM recommendations "
    f"WHERE horizon = '{m}-Month' GROUP BY 2 ORDER BY sum(total_forecasted_demand) DESC, item_id LIMIT 10)" for m in (1, 3, 6))))
def top_skus_by_forecast(spark, sf):
    reco = plan.recommend(v.family(spark, sf))
    top = monitor.top_skus_by_forecast(reco, 10)
    months = F.regexp_extract("horizon", "^([0-9]+)", 1).cast("int").alias("months")
    return rounded(top.select(months, "item_id", "forecast_units"), 4, "forecast_units")


@query("sku_list", v.sql("SELECT DISTINCT sku FROM sales ORDER BY sku"))
def sku_list(spark, sf):
    return v.sales(spark, sf).select("sku").distinct().orderBy("sku")


@query("event_sales_ranking", v.sql("SELECT sku, " + ", ".join(
    f"coalesce(sum(qty) FILTER (ds BETWEEN DATE '{d}' - {b} AND DATE '{d}' + {a}), 0) AS {n}_sales"
    for n, d, b, a in v.EVENTS) + " FROM family GROUP BY 1 ORDER BY 2 DESC, 3 DESC, 4 DESC"))
def event_sales_ranking(spark, sf):
    out = promo.event_sales(v.family(spark, sf), v.EVENTS)
    return out.orderBy(*[F.desc(c) for c in out.columns if c != "sku"], "sku")


@query("channel_ordered_view", v.sql(
    "SELECT *, CASE channel WHEN 'App' THEN 1 WHEN 'Web' THEN 2 ELSE 3 END AS channel_rank FROM recommendations "
    "WHERE channel IN ('App', 'Web', 'Offline') ORDER BY channel_rank, item_id, forecast_days"))
def channel_ordered_view(spark, sf):
    return monitor.channel_view(plan.recommend(v.family(spark, sf))).withColumn(
        "channel_rank", F.col("channel_rank").cast("int"))


@query("top_revenue_skus", v.sql("SELECT sku, sum(revenue) AS revenue FROM sales GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"))
def top_revenue_skus(spark, sf):
    return (v.sales(spark, sf).groupBy("sku").agg(F.sum("revenue").alias("revenue"))
            .orderBy(F.desc("revenue"), "sku").limit(10))


# ---- sets and reshaping -------------------------------------------------------------------

@query("union_new_sales", v.sql(
    "SELECT sku, channel, ds, qty FROM (SELECT *, row_number() OVER (PARTITION BY sku, channel, ds ORDER BY status = 'O' DESC, order_key DESC, "
    "line_no DESC, supp_key DESC, list_price DESC) AS rn FROM (SELECT * REPLACE (qty + (status = 'O')::INTEGER AS qty) FROM sales)) WHERE rn = 1"))
def union_new_sales(spark, sf):
    """Open lines act as uploads over the finished ones."""
    s = v.sales(spark, sf)
    new = s.where(F.col("status") == "O").withColumn("qty", F.col("qty") + 1)
    out = sl.union_new_sales(s.where(F.col("status") == "F"), new,
                             [F.col(c) for c in ("order_key", "line_no", "supp_key", "list_price")])
    return out.select("sku", "channel", "ds", "qty")


_INGESTED = ["sku", "channel", "ds", "qty", "upload", "order_key", "line_no", "supp_key", "list_price"]


@query("stream_ingest", v.sql(
    "SELECT sku, channel, ds, qty FROM (SELECT *, row_number() OVER (PARTITION BY sku, channel, ds ORDER BY status = 'O' DESC, order_key DESC, "
    "line_no DESC, supp_key DESC, list_price DESC) AS rn FROM (SELECT * REPLACE (qty + (status = 'O')::INTEGER AS qty) FROM sales)) WHERE rn = 1"))
def stream_ingest(spark, sf):
    """The same union, with the uploads arriving as a stream of files that ends up in the history's table."""
    s = v.sales(spark, sf).withColumn("upload", F.col("status") == "O")
    lines = s.withColumn("qty", F.col("qty") + F.col("upload").cast("int")).select(*_INGESTED)
    folder, uploads, checkpoint = (new_path(spark, n) for n in ("ingest-table", "ingest-uploads", "ingest-stream"))
    recency = ["upload", "order_key", "line_no", "supp_key", "list_price"]
    snapshots.create(spark, folder, lines.schema, ["sku", "channel", "ds"], 16)
    snapshots.upsert(folder, ordered.newest(lines.where("NOT upload"), ["sku", "channel", "ds"], [F.col(c) for c in recency]))
    lines.where("upload").repartition(3).write.parquet(uploads)
    ingest.ingest(spark, uploads, lines.schema, folder, checkpoint, recency, files_per_batch=1)
    return snapshots.read(spark, folder).select("sku", "channel", "ds", "qty")


@query("union_predictions", v.sql("SELECT * FROM sma UNION ALL SELECT * FROM naive"))
def union_predictions(spark, sf):
    lines = plan.item_lines(v.family(spark, sf))
    return fc.sma(lines).unionByName(fc.seasonal_naive(lines))


@query("distinct_holidays", v.sql("SELECT ds, is_holiday FROM holiday_days"))
def distinct_holidays(spark, sf):
    return sl.holiday_days(v.holidays(spark, sf))


@query("distinct_items", v.sql(
    "SELECT sku || '_' || channel AS item_id, sku, channel, min(category) AS category, min(gender) AS gender FROM sales GROUP BY ALL"))
def distinct_items(spark, sf):
    return sl.distinct_items(v.sales(spark, sf))


@query("dedup_panel", v.sql(
    "SELECT item_id, ds, min(qty) AS qty FROM (SELECT sku || '_' || channel AS item_id, ds, qty FROM clean_sales) "
    "WHERE item_id IS NOT NULL GROUP BY 1, 2"))
def dedup_panel(spark, sf):
    c = sl.clean_sales(v.raw_sales(spark, sf))
    return grid.dedup_panel(c.select(F.when(F.col("sku").isNotNull(), cl.item_id()).alias("item_id"), "ds", "qty"))


_ONE_HOT = {"category": ("EAR", "RNG"), "gender": ("men",), "brand_category": [v.BRAND_PREFIX + c for c in ("EAR", "RNG")],
            "category_channel": [f"{c}_{ch}" for c in ("EAR", "RNG") for ch in ("App", "Offline", "Web")]}


@query("one_hot_static", v.sql(
    "SELECT item_id, " + ", ".join(f"({c} = '{x}')::INTEGER::DOUBLE AS {c}_{x}" for c, xs in _ONE_HOT.items() for x in xs)
    + f" FROM (SELECT sku || '_' || channel AS item_id, min(category) AS category, min(gender) AS gender, '{v.BRAND_PREFIX}' || min(category) "
      "AS brand_category, min(category) || '_' || channel AS category_channel FROM family GROUP BY sku, channel)"))
def one_hot_static(spark, sf):
    """The vocabulary of a run without necklaces, saved and loaded; necklaces are 0 in every category column."""
    items = sl.static_attributes(sl.distinct_items(v.family(spark, sf)), v.BRAND_PREFIX)
    folder = new_path(spark, "vocabulary-run")
    trained = artefacts.fit_vocabulary(items.where("NOT startswith(item_id, 'NCK')"), sl.STATIC)
    artefacts.save(trained, folder, "run_1", "vocabulary")
    return sl.one_hot(items, artefacts.vocabulary(artefacts.load(spark, folder, "run_1", "vocabulary")))


# ---- scalar features ----------------------------------------------------------------------

@query("calendar_features", v.sql(
    "SELECT DISTINCT ds, month(ds)::INTEGER AS month, (isodow(ds) - 1)::INTEGER AS day_of_week, (isodow(ds) >= 6)::INTEGER AS is_weekend, "
    "(month(ds) IN (10, 11, 12, 1, 2))::INTEGER AS is_wedding_season, (month(ds) IN (10, 11))::INTEGER AS is_diwali_period, "
    "(month(ds) = 2)::INTEGER AS is_valentine_month FROM sales"))
def calendar_features(spark, sf):
    return v.sales(spark, sf).select("ds").distinct().withColumns(cal.calendar_features())


@query("month_boundary", v.sql(
    "SELECT DISTINCT ds, (day(ds) = 1)::INTEGER AS is_month_start, (ds = last_day(ds))::INTEGER AS is_month_end FROM sales"))
def month_boundary(spark, sf):
    return v.sales(spark, sf).select("ds").distinct().withColumns(cal.month_boundary())


_CYCLE = {"day_of_week_sin": "sin(2 * pi() * (isodow(ds) - 1) / 7.0::DOUBLE)", "day_of_week_cos": "cos(2 * pi() * (isodow(ds) - 1) / 7.0::DOUBLE)",
          "month_sin": "sin(2 * pi() * month(ds) / 12.0::DOUBLE)", "month_cos": "cos(2 * pi() * month(ds) / 12.0::DOUBLE)"}


@query("cyclical_encoding", v.sql("SELECT ds, " + r(9, **_CYCLE) + " FROM (SELECT DISTINCT ds FROM sales)"))
def cyclical_encoding(spark, sf):
    return rounded(v.sales(spark, sf).select("ds").distinct().withColumns(cal.cyclical_encoding()), 9, *_CYCLE)


@query("promo_flags", v.sql(
    "SELECT sku, channel, ds, (disc > 0)::INTEGER AS is_on_promotion, (disc > coalesce(threshold, 0))::INTEGER AS is_high_discount FROM d "
    "LEFT JOIN (SELECT sku, quantile_cont(disc, 0.75) AS threshold FROM d WHERE disc > 0 GROUP BY 1) USING (sku)",
    d="SELECT sku, channel, ds, avg(disc) AS disc FROM sales GROUP BY ALL"))
def promo_flags(spark, sf):
    d = v.sales(spark, sf).groupBy("sku", "channel", "ds").agg(F.avg("disc").alias("disc"))
    return (d.join(ft.discount_thresholds(d), "sku", "left").withColumns(ft.promo_flags())
            .select("sku", "channel", "ds", "is_on_promotion", "is_high_discount"))


@query("discount_share", v.sql(
    "SELECT sku, ds, " + r(9, discount_percentage="coalesce(disc_amt / nullif(revenue + disc_amt, 0), 0)") + ", count(*) AS n FROM sales GROUP BY ALL"))
def discount_share(spark, sf):
    s = v.sales(spark, sf).select("sku", "ds", ft.discount_share("disc_amt", "revenue").alias("discount_percentage"))
    return rounded(s, 9, "discount_percentage").groupBy("sku", "ds", "discount_percentage").agg(F.count(F.lit(1)).alias("n"))


@query("stockout_flag", v.sql(
    "SELECT sku, ds, (coalesce(warehouse_qty, 1) <= 0)::INTEGER AS was_stocked_out FROM (SELECT DISTINCT sku, ds FROM sales) LEFT JOIN "
    "stock USING (sku, ds)"))
def stockout_flag(spark, sf):
    s = v.sales(spark, sf)
    j = s.select("sku", "ds").distinct().join(v.stock(s), ["sku", "ds"], "left")
    return j.select("sku", "ds", ft.stockout_flag().alias("was_stocked_out"))


@query("potential_lost_sales", v.sql(
    f"SELECT item_id, ds, round(coalesce({prev('sum(was_stocked_out)', 7)}, 0) * coalesce({prev('avg(y)', 30)}, 0), 6) AS potential_lost_sales FROM sg",
    sg=_STOCK_GRID))
def potential_lost_sales(spark, sf):
    g = stock_grid(spark, sf).withColumns({"s": ft.rolling_count(F.col("was_stocked_out") == 1), **ft.rolling_means("y", (30,))})
    return rounded(g.select("item_id", "ds", (F.col("s") * F.col("sales_ma_30")).alias("potential_lost_sales")), 6, "potential_lost_sales")


@query("feedback_score", v.sql("SELECT item_id, sum(score) AS score, count(*) AS n FROM scores GROUP BY 1"))
def feedback_score(spark, sf):
    f = v.feedback(spark, sf).select(cl.item_id("selected_sku").alias("item_id"), cl.feedback_score("feedback").alias("s"))
    return f.groupBy("item_id").agg(F.sum("s").alias("score"), F.count(F.lit(1)).alias("n"))


@query("metal_price_inr", v.sql("SELECT ds, " + r(4, silver_price_inr="silver_price_inr", gold_price_inr="gold_price_inr") + " FROM metal_days"))
def metal_price_inr(spark, sf):
    return rounded(ft.metal_inr(v.metal_rates(spark, sf)), 4, "silver_price_inr", "gold_price_inr")


@query("iso_date_part", v.sql("SELECT name, ds FROM holidays"))
def iso_date_part(spark, sf):
    return v.holidays(spark, sf).select(F.col("Name").alias("name"), cl.iso_day("Date").alias("ds"))


# ---- compositions -------------------------------------------------------------------------

_OBSERVED = """SELECT d.*, coalesce(s.warehouse_qty, 1) AS warehouse_qty, (d.disc > 0)::INTEGER AS is_on_promotion,
  (d.disc > coalesce(t.threshold, 0))::INTEGER AS is_high_discount FROM agg d
 LEFT JOIN stock_family s ON s.sku = d.sku AND s.ds = d.ds
 LEFT JOIN (SELECT sku, quantile_cont(disc, 0.75) AS threshold FROM agg WHERE disc > 0 GROUP BY 1) t ON t.sku = d.sku"""
_AGG = """SELECT sku || '_' || channel AS item_id, sku, channel, ds, sum(qty) AS target, avg(disc) AS disc
 FROM clean_family WHERE sku IS NOT NULL GROUP BY ALL"""
_PANEL = """SELECT i.item_id, i.sku, i.channel, c.ds, o.target, o.disc, o.warehouse_qty, coalesce(o.is_on_promotion, 0) AS is_on_promotion,
  coalesce(o.is_high_discount, 0) AS is_high_discount, (coalesce(o.warehouse_qty, 1) <= 0)::INTEGER AS was_stocked_out FROM
 (SELECT DISTINCT item_id, sku, channel FROM agg) i CROSS JOIN (SELECT CAST(unnest(generate_series((SELECT min(ds) FROM agg),
  (SELECT max(ds) FROM agg), INTERVAL 1 DAY)) AS DATE) AS ds) c LEFT JOIN observed o ON o.item_id = i.item_id AND o.ds = c.ds"""
_HIST = {
    **{f"sales_ma_{n}": f"coalesce({prev('avg(target)', n)}, 0)" for n in (7, 14, 30)},
    **{f"sales_lag_{n}": f"coalesce(lag(target, {n}) OVER {_W}, 0)" for n in (1, 7, 14, 30)},
    **{f"sales_std_{n}": f"coalesce({prev('stddev_samp(target)', n)}, 0)" for n in (7, 30)},
    "potential_lost_sales": f"coalesce({prev('sum(was_stocked_out)', 7)}, 0) * coalesce({prev('avg(target)', 30)}, 0)",
}
_ROUNDED = [*_HIST, "disc"]
_CAL = ("month(ds)::INTEGER AS month, (isodow(ds) - 1)::INTEGER AS day_of_week, (isodow(ds) >= 6)::INTEGER AS is_weekend, "
        "(month(ds) IN (10, 11, 12, 1, 2))::INTEGER AS is_wedding_season, (month(ds) IN (10, 11))::INTEGER AS is_diwali_period, "
        "(month(ds) = 2)::INTEGER AS is_valentine_month")


@query("prepare_data", v.sql(
    "SELECT item_id, sku, channel, ds, coalesce(target, 0) AS target, round(coalesce(disc, 0), 5) AS disc, coalesce(warehouse_qty, 0) AS warehouse_qty, "
    "is_on_promotion, is_high_discount, was_stocked_out, " + r(5, **_HIST)
    + f", CAST(coalesce({prev('sum(was_stocked_out)', 7)}, 0) AS BIGINT) AS stockout_days_last_7, "
    f"CAST(coalesce({prev('sum((coalesce(target, 0) > 0)::INTEGER)', 7)}, 0) AS BIGINT) AS days_with_sales_last_7d, "
    "CAST(coalesce(date_diff('day', max(CASE WHEN target > 0 THEN ds END) OVER (PARTITION BY item_id ORDER BY ds ROWS UNBOUNDED PRECEDING), ds), 0) AS INTEGER) "
    f"AS time_since_last_sale, {_CAL}, coalesce(is_holiday, 0) AS is_holiday, "
    + r(3, **{c: f"coalesce({c}, 0)" for c in ft.METAL_FILL})
    + " FROM panel LEFT JOIN holiday_days USING (ds) LEFT JOIN metal_features USING (ds)",
    agg=_AGG, observed=_OBSERVED, panel=_PANEL))
def prepare_data(spark, sf):
    """Raw sales, stock, holidays and metal prices to the dense feature panel."""
    out = prepare.prepare_data(v.raw_family(spark, sf), v.inventory(v.family(spark, sf)), v.holidays(spark, sf),
                               v.metal_rates(spark, sf))
    out = rounded(out, 5, *_ROUNDED)
    return rounded(out, 3, *ft.METAL_FILL).drop("category", "gender")


@query("prepare_data_analysis", v.sql(
    f"SELECT item_id, sku, channel, ds, coalesce(target, 0) AS target, round(coalesce(disc, 0), 6) AS disc, {_CAL}, "
    + ", ".join("coalesce(last_value({0} IGNORE NULLS) OVER (PARTITION BY item_id ORDER BY ds ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), "
                "first_value({0} IGNORE NULLS) OVER (PARTITION BY item_id ORDER BY ds ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS {0}".format(c)
                for c in ("is_on_promotion", "is_high_discount"))
    + ", coalesce(is_holiday, 0) AS is_holiday FROM (SELECT DISTINCT item_id, sku, channel FROM agg) i CROSS JOIN (SELECT CAST(unnest(generate_series("
      "(SELECT min(ds) FROM agg), (SELECT max(ds) FROM agg), INTERVAL 1 DAY)) AS DATE) AS ds) c LEFT JOIN agg USING (item_id, sku, channel, ds) "
      "LEFT JOIN holiday_days USING (ds)",
    agg="SELECT sku || '_' || channel AS item_id, sku, channel, ds, sum(qty) AS target, avg(disc) AS disc, max((disc > 0)::INTEGER) AS is_on_promotion, "
        "max((disc > coalesce(threshold, 0))::INTEGER) AS is_high_discount FROM clean_family LEFT JOIN (SELECT sku, quantile_cont(disc, 0.75) AS threshold "
        "FROM clean_family WHERE disc > 0 GROUP BY 1) USING (sku) WHERE sku IS NOT NULL GROUP BY sku, channel, ds"))
def prepare_data_analysis(spark, sf):
    return rounded(prepare.prepare_for_analysis(v.raw_family(spark, sf), v.holidays(spark, sf)), 6, "disc")


@query("feedback_features", v.sql("SELECT item_id, ds, " + r(6, feedback_score_30d_avg="avg30") + " FROM feedback_days"))
def feedback_features(spark, sf):
    return rounded(ft.feedback_daily(v.feedback(spark, sf)), 6, "feedback_score_30d_avg")


@query("metal_features", v.sql("SELECT ds, " + r(3, **{c: c for c in ft.METAL_FILL}) + " FROM metal_features"))
def metal_features(spark, sf):
    return rounded(ft.metal_features(ft.metal_inr(v.metal_rates(spark, sf))), 3, *ft.METAL_FILL)


@query("store_daily", v.sql("SELECT ds, round(store_count, 6) AS store_count FROM store_days"))
def store_daily(spark, sf):
    return rounded(sl.store_days(v.store_count(spark, sf)), 6, "store_count")


_ADV = {"discount_percentage": "coalesce(disc / nullif(revenue + disc, 0), 0)", "rolling_avg_sales_7d": f"coalesce({prev('avg(y)', 7, 'sku')}, 0)",
        "rolling_std_sales_7d": f"coalesce({prev('stddev_samp(y)', 7, 'sku')}, 0)",
        **{f"sales_lag_{n}d": f"coalesce(lag(y, {n}) OVER (PARTITION BY sku ORDER BY ds), 0)" for n in (1, 7, 14, 30)}, **_CYCLE}


@query("advanced_features", v.sql(
    "SELECT sku, ds, " + r(5, y="y", **_ADV) + ", (disc > 0)::INTEGER AS is_on_promotion, (day(ds) = 1)::INTEGER AS is_month_start, "
    "(ds = last_day(ds))::INTEGER AS is_month_end FROM sku_frame"))
def advanced_features(spark, sf):
    out = prepare.advanced_features(sku_frame(spark, sf)).withColumnsRenamed(
        {"sales_ma_7": "rolling_avg_sales_7d", "sales_std_7": "rolling_std_sales_7d",
         **{f"sales_lag_{n}": f"sales_lag_{n}d" for n in (1, 7, 14, 30)}})
    return rounded(out, 5, "y", *_ADV).drop("store_count", "was_stocked_out", "revenue", "disc")


def upload(spark, sf):
    raw = v.raw_family(spark, sf).select(
        "sku", F.col("created_at").alias("timestamp"), F.col("qty").alias("target"), "disc")
    return prepare.prepare_upload(tables.upload_rows(raw), v.holidays(spark, sf))


_UP = {f"sales_ma_{n}": f"coalesce({prev('avg(target)', n)}, 0)" for n in (7, 14)}


@query("prepare_upload", v.sql(
    "SELECT item_id, sku, ds, target, round(disc, 6) AS disc, " + r(6, **_UP) + f", {_CAL}, coalesce(is_holiday, 0) AS is_holiday FROM up "
    "LEFT JOIN holiday_days USING (ds)",
    up="SELECT sku || '_Online' AS item_id, sku, ds, sum(target) AS target, avg(disc) AS disc FROM (SELECT sku, " + v._DAY
       + " AS ds, TRY_CAST(qty AS DOUBLE) AS target, TRY_CAST(disc AS DOUBLE) AS disc FROM raw_family) WHERE sku IS NOT NULL AND ds IS NOT NULL "
         "AND target IS NOT NULL AND disc IS NOT NULL GROUP BY ALL"))
def prepare_upload(spark, sf):
    out = upload(spark, sf).select("item_id", "sku", "ds", "target", "disc", *_UP, *cal.calendar_features(), "is_holiday")
    return rounded(out, 6, "disc", *_UP)


_UP_DAILY = ("SELECT sku || '_Online' AS item_id, ds, sum(target) AS y FROM (SELECT sku, " + v._DAY + " AS ds, TRY_CAST(qty AS DOUBLE) AS target, "
             "TRY_CAST(disc AS DOUBLE) AS disc FROM raw_family) WHERE sku IS NOT NULL AND ds IS NOT NULL AND target IS NOT NULL AND disc IS NOT NULL GROUP BY 1, 2")


_UP_ERRORS = ("SELECT item_id, avg(abs(y - yhat)) AS mae, CASE WHEN sum(abs(y)) > 0 THEN sum(abs(y - yhat)) / sum(abs(y)) * 100 ELSE 0 END AS wape FROM "
              "(SELECT *, avg(y) FILTER (age > 183 AND age <= 190) OVER (PARTITION BY item_id) AS yhat FROM (SELECT *, row_number() OVER "
              "(PARTITION BY item_id ORDER BY ds DESC) AS age FROM up)) WHERE age <= 183 AND yhat IS NOT NULL GROUP BY 1")


_UP_MODELS = {
    "up": _UP_DAILY, "up_errors": _UP_ERRORS, **BT,
    "up_aged": "SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY ds DESC) AS age, max(ds) OVER (PARTITION BY item_id) AS last_ds FROM up",
    "steps": "SELECT CAST(unnest(generate_series(1, 183)) AS INTEGER) AS step",
    "up_sma": "SELECT 'SMA' AS model, item_id, step, CAST(last_ds + step AS DATE) AS ds, mean FROM (SELECT item_id, last_ds, avg(y) AS mean "
              "FROM up_aged WHERE age <= 7 GROUP BY 1, 2), steps",
    "up_naive": "SELECT 'SeasonalNaive' AS model, a.item_id, step, CAST(last_ds + step AS DATE) AS ds, y AS mean FROM up_aged a JOIN steps "
                "ON a.age = 7 - (step - 1) % 7",
    # The naive model on the last 183 points: from the points before them, which end on their own last day.
    "up_late": "SELECT l.item_id, l.ds, l.y, h.y AS yhat FROM up_aged l JOIN (SELECT item_id, max(ds) AS cut FROM up_aged WHERE age > 183 GROUP BY 1) c "
               "USING (item_id) JOIN up_aged h ON h.item_id = l.item_id AND h.age - 183 = 7 - (date_diff('day', c.cut, l.ds) - 1) % 7 "
               "WHERE l.age <= 183 AND date_diff('day', c.cut, l.ds) <= 183",
    "up_naive_errors": "SELECT item_id, avg(abs(y - yhat)) AS mae, CASE WHEN sum(abs(y)) > 0 THEN sum(abs(y - yhat)) / sum(abs(y)) * 100 ELSE 0 END AS wape "
                       "FROM up_late GROUP BY 1",
    "winner": "SELECT model FROM mase_rows JOIN (SELECT model, item_id FROM errors) USING (model, item_id) GROUP BY 1 ORDER BY avg(mase) NULLS LAST, model LIMIT 1",
    "up_all": "SELECT u.*, e.mae, e.wape FROM up_sma u LEFT JOIN up_errors e USING (item_id) UNION ALL "
              "SELECT u.*, e.mae, e.wape FROM up_naive u LEFT JOIN up_naive_errors e USING (item_id)",
}


@query("upload_forecast", v.sql(
    "SELECT model, item_id, step, ds, round(mean, 6) AS mean, CAST(round_even(greatest(mean, 0), 0) AS INTEGER) AS units, points, "
    "CASE WHEN points <= 183 THEN 'history of ' || points || ' points is not longer than the horizon of 183' END AS backtest_skipped, "
    "round(mae, 6) AS mae, round(wape, 6) AS wape FROM up_all JOIN winner USING (model) "
    "JOIN (SELECT item_id, count(*) AS points FROM up GROUP BY 1) USING (item_id)", sku_series="SELECT * FROM item_series", **_UP_MODELS))
def upload_forecast(spark, sf):
    """An upload scored by the saved model that won the contest of the promoted run."""
    folder = new_path(spark, "upload-run")
    batch.batch_run(v.family(spark, sf), folder, "run_1")
    return rounded(plan.upload_forecast(upload(spark, sf), model=batch.champion_model(spark, folder)), 6, "mean", "mae", "wape")
