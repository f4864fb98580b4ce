"""The library's input tables, derived from the test tables: once for Spark, once as SQL.

Each Spark view has a SQL twin in ``CTES`` with the same name and columns; ``sql(body)`` adds
the twins a query mentions. Money is in minor units and all amounts are whole numbers, so sums
are exact in any order on both engines.
"""

import datetime as dt
import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larder import config
from larder.functions import cleaning as cl
from larder.session import freed_shuffles, stage
from larder.sources import files, tables

FEEDBACK_SHIFT_DAYS = 8122  # moves the event month so that it ends near the last ship date
HOLIDAYS = (
    (1, 26, "Republic Day", "['National holiday']"),
    (3, 8, "Spring Festival", "['Hinduism', 'Optional holiday']"),
    (8, 15, "Independence Day", "['National holiday']"),
    (10, 24, "Diwali", "['Hinduism']"),
    (12, 25, "Christmas", "['National holiday', 'Christian']"),
    (12, 25, "Year End Sale", "['Observance']"),
)
BRAND_PREFIX = "HOUSE_"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return tables.scan(spark, f"{sf}/{name}.parquet")


def _lines(spark, sf):
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    pct = F.round(F.col("l_discount") * 100).cast("bigint")
    revenue = F.floor(cents * (F.lit(100) - pct) / F.lit(100))
    part = table(spark, sf, "part").select("p_partkey", "p_type", "p_brand")
    brand = F.substring("p_brand", 7, 3).cast("int")
    return table(spark, sf, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_shipdate").cast("date").alias("ds"),
        F.concat("p_type", F.col("l_partkey").cast("string")).alias("sku"),
        F.col("p_type").alias("category"),
        F.concat(F.element_at(F.array(F.lit("EAR"), F.lit("RNG"), F.lit("NCK")), brand % 3 + 1),
                 brand.cast("string")).alias("family"),
        F.element_at(F.array(F.lit("women"), F.lit("men"), F.lit("unisex")),
                     (F.col("l_partkey") % 3 + 1).cast("int")).alias("gender"),
        F.when(F.col("l_returnflag") == "A", "App").when(F.col("l_returnflag") == "N", "Web")
        .otherwise("Offline").alias("channel"),
        F.col("l_quantity").alias("qty"),
        pct.cast("double").alias("disc"),
        (cents - revenue).cast("double").alias("disc_amt"),
        revenue.cast("double").alias("revenue"),
        F.col("l_linestatus").alias("status"),
        F.col("l_orderkey").alias("order_key"), F.col("l_linenumber").alias("line_no"),
        F.col("l_suppkey").alias("supp_key"), F.col("l_extendedprice").alias("list_price"))


def sales(spark, sf) -> DataFrame:
    """Typed sales lines, one SKU per part."""
    return _lines(spark, sf).drop("family")


def family(spark, sf) -> DataFrame:
    """The same lines with the brand as SKU: few, dense items."""
    return _lines(spark, sf).drop("sku").withColumnRenamed("family", "sku").withColumn(
        "category", cl.sku_category()).select(*sales(spark, sf).columns)


def raw(lines: DataFrame) -> DataFrame:
    """Lines as raw text, with the defects the cleaning has to handle."""
    kind = F.col("order_key") % 50
    qty = F.col("qty").cast("int").cast("string")
    money = F.col("revenue").cast("bigint").cast("string")
    return lines.select(
        F.when(kind == 3, "not a date").when(kind == 4, F.date_format("ds", "yyyy-MM-dd"))
        .otherwise(F.date_format("ds", "dd/MM/yyyy")).alias("created_at"),
        F.when(kind == 5, F.lit(None)).otherwise(F.col("sku")).alias("sku"),
        F.when(kind == 0, F.concat(F.lit("1,"), F.lpad(qty, 3, "0"))).when(kind == 6, "0")
        .when(kind == 7, F.lit(None)).when(kind == 8, "n/a").otherwise(qty).alias("qty"),
        "category", "gender",
        F.col("disc").cast("int").cast("string").alias("disc"),
        F.when(kind == 9, F.concat(F.lit("₹"), money, F.lit(".50"))).otherwise(money).alias("revenue"),
        F.when(kind == 1, F.lit(None)).when(kind == 2, F.concat(F.lit(" "), F.col("channel"), F.lit(" ")))
        .otherwise(F.col("channel")).alias("Channel"))


_STORED: dict[tuple, DataFrame] = {}


def stored(spark, sf, name: str, lines) -> DataFrame:
    """A raw text table, written once per session and input: a raw table exists before any query.

    Lines that are read in fewer parts than the session has cores are dealt to as many files as cores; others are
    written as they come, without a shuffle of the text. Rewritten inputs have other times and are read anew.
    """
    times = tuple(files.modified(spark, f"{sf}/{t}.parquet") for t in ("lineitem", "part"))
    key = spark.sparkContext.applicationId, sf, name, times
    if key not in _STORED:
        text, cores = raw(lines(spark, sf)), spark.sparkContext.defaultParallelism
        if table(spark, sf, "lineitem").rdd.getNumPartitions() < cores:
            text = text.repartition(cores)
        with freed_shuffles(spark):
            _STORED[key] = stage(text, name, codec="zstd")
    return _STORED[key]


def raw_sales(spark, sf) -> DataFrame:
    """Stored text, as a raw table is: the cleaning then reads plain columns."""
    return stored(spark, sf, "raw-sales", sales)


def raw_family(spark, sf) -> DataFrame:
    return stored(spark, sf, "raw-family", family)


def inventory(lines: DataFrame) -> DataFrame:
    """Raw stock rows, stored as text: one per SKU, day and warehouse, with zeros."""
    return stage(lines.select("sku", "ds", "supp_key").distinct().select(
        F.date_format("ds", "dd/MM/yyyy").alias("date"), "sku",
        ((F.col("supp_key") * 13 + F.dayofmonth("ds") * 7) % 5).cast("double").alias("wh")), "stock")


def stock(lines: DataFrame) -> DataFrame:
    """Daily stock per SKU, typed."""
    return inventory(lines).select(cl.day_first("date").alias("ds"), "sku", "wh").groupBy(
        "sku", "ds").agg(F.sum("wh").alias("warehouse_qty"))


def order_days(spark, sf) -> DataFrame:
    return table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("ds")).distinct()


def holidays(spark, sf) -> DataFrame:
    """Raw holiday rows: the order dates that fall on a listed month and day."""
    listed = F.array(*[F.struct(F.lit(m).alias("m"), F.lit(d).alias("d"), F.lit(n).alias("Name"),
                                F.lit(t).alias("Type")) for m, d, n, t in HOLIDAYS])
    return order_days(spark, sf).select("ds", F.inline(F.filter(
        listed, lambda h: (h["m"] == F.month("ds")) & (h["d"] == F.dayofmonth("ds"))))).select(
        F.concat(F.date_format("ds", "yyyy-MM-dd"), F.lit("T00:00:00")).alias("Date"), "Name", "Type",
        F.lit("India").alias("Country Name"), F.lit("IN").alias("Country Code"))


def store_count(spark, sf) -> DataFrame:
    """Customers with a first order up to each month, as a monthly store count."""
    first = table(spark, sf, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("d"))
    monthly = first.groupBy(F.year("d").alias("year"), F.month("d").alias("month")).agg(
        F.count(F.lit(1)).alias("n"))
    # One row per month.
    w = Window.partitionBy(F.lit(1)).orderBy("year", "month").rowsBetween(Window.unboundedPreceding, 0)
    return monthly.select("year", "month", F.sum("n").over(w).cast("double").alias("stores"))


def feedback(spark, sf) -> DataFrame:
    """Events as planner feedback on the family SKUs."""
    brand = (F.col("user_id") % 25 + 1).cast("int")
    text = F.create_map(*[F.lit(x) for x in (
        "error", "Stockout occurred", "click", "Good forecast", "view", "Forecast too high",
        "signup", "Forecast too low")])
    channel = F.element_at(F.array(F.lit("App"), F.lit("Web"), F.lit("Offline")),
                           (F.col("event_id") % 3 + 1).cast("int"))
    return table(spark, sf, "events").select(
        (F.col("ts").cast("timestamp") - F.make_interval(days=F.lit(FEEDBACK_SHIFT_DAYS))).alias("timestamp"),
        F.concat(F.element_at(F.array(F.lit("EAR"), F.lit("RNG"), F.lit("NCK")), brand % 3 + 1),
                 brand.cast("string")).alias("selected_sku"),
        channel.alias("channel"),
        F.coalesce(F.try_element_at(text, F.col("event_type")), F.lit("Other")).alias("feedback"))


def metal_rates(spark, sf) -> DataFrame:
    """Landed price responses, one per month with a map of date to nested rates (31 at most)."""
    daily = table(spark, sf, "orders").groupBy(F.col("o_orderdate").cast("date").alias("ds")).agg(
        F.max("o_totalprice").alias("hi"), F.min("o_totalprice").alias("lo"))
    day = F.dayofmonth("ds")
    info = F.struct(
        F.struct((F.col("lo") / 1000).alias("silver"), (F.col("hi") / 100).alias("gold")).alias("metals"),
        F.struct(F.when(day == 17, 0.0).otherwise(0.01 + (day % 5) / 1000.0).alias("INR")).alias("currencies"))
    return daily.groupBy(F.trunc("ds", "month").alias("month")).agg(F.map_from_entries(F.collect_list(
        F.struct(F.date_format("ds", "yyyy-MM-dd"), info))).alias("rates")).select("rates")


def orders_nested(spark, sf) -> DataFrame:
    """Order documents with nested line items, one document per shipped line.

    A document holds the line itself, a free gift and a service line, so it is built from its
    own row without gathering an order in one place.
    """
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
                                         "o_orderdate", "o_orderpriority")
    j = sales(spark, sf).join(o, F.col("order_key") == F.col("o_orderkey"))

    def allocations(*amounts):
        return F.array(*[F.struct(a.alias("amount")) for a in amounts])

    alloc = (F.when(F.col("line_no") % 3 == 0, F.array().cast("array<struct<amount:double>>"))
             .when(F.col("line_no") % 3 == 1, allocations(F.col("disc_amt")))
             .otherwise(allocations(F.col("disc_amt"), F.lit(100.0))))
    none = F.array().cast("array<struct<amount:double>>")

    def line(sku, quantity, price, discounts):
        return F.struct(sku.alias("sku"), quantity.alias("quantity"), price.alias("price"),
                        discounts.alias("discount_allocations"))

    source = F.element_at(F.create_map(*[F.lit(x) for x in (
        "1-URGENT", "pos", "2-HIGH", "web", "3-MEDIUM", "5204949", "4-NOT SPECIFIED", "android",
        "5-LOW", "ios")]), F.col("o_orderpriority"))
    tags = (F.when((F.col("o_orderstatus") == "P") & (F.col("line_no") == 7), "warranty")
            .when((F.col("o_orderstatus") == "P") & (F.col("line_no") == 6), "Replacement,vip")
            .when(F.col("o_orderstatus") == "O",
                  "app_wallet_used,app_wallet_used_amount_5000,COD + Wallet").otherwise("vip"))
    return j.select(
        source.alias("source_name"), F.concat(F.lit("#"), F.col("o_orderkey").cast("string")).alias("name"),
        F.col("o_orderdate").cast("date").alias("created_at"),
        F.round(F.col("o_totalprice") * 100).alias("total_price"),
        (F.col("o_custkey") % 26).cast("int").alias("location_id"),
        F.struct(F.lit("MH").alias("province")).alias("billing_address"),
        F.concat(F.when(F.col("line_no") == 5, "Test").otherwise("c"),
                 F.col("o_custkey").cast("string"), F.lit("@shop.example")).alias("email"),
        tags.alias("tags"),
        F.array(line(F.col("sku"), F.col("qty"), F.col("revenue") + F.col("disc_amt"), alloc),
                line(F.concat(F.lit("GW"), F.col("sku")), F.lit(1.0), F.lit(500.0), none),
                line(F.col("sku"), F.lit(1.0), F.lit(0.0), none)).alias("line_items"))


def stores(spark, sf) -> DataFrame:
    return table(spark, sf, "nation").select(F.col("n_nationkey").alias("store_id"),
                                            F.col("n_name").alias("store_name"))


def training_status(spark, sf) -> DataFrame:
    """Items trained on the finished lines; the Offline channel was never trained."""
    return (family(spark, sf).where((F.col("status") == "F") & (F.col("channel") != "Offline"))
            .groupBy(cl.item_id().alias("item_id")).agg(F.max("ds").alias("last_trained")))


def model_runs(spark, sf) -> DataFrame:
    """One run per order month, with metrics computed from that month's orders."""
    o = table(spark, sf, "orders")
    month = F.trunc(F.col("o_orderdate").cast("date"), "month")
    n = F.count(F.lit(1))

    def share(s):
        return F.count(F.when(F.col("o_orderstatus") == s, 1)) / n

    runs = o.groupBy(month.alias("trained_date")).agg(
        share("F").alias("f"), F.max("o_totalprice").alias("hi"), share("P").alias("mape"))
    m = F.month("trained_date")
    return runs.select(
        F.concat(F.lit("inventory_recommendations_"), F.date_format("trained_date", "yyyyMMdd")).alias("run_id"),
        "trained_date", F.when(m != 5, F.col("f")).alias("mase"), (F.col("hi") / 1000).alias("rmse"),
        "mape", F.when(m == 7, "reject").otherwise("promote").alias("decision"))


def versions(spark, sf) -> DataFrame:
    """Published results of every run: units per family SKU and channel of a ship month."""
    return family(spark, sf).groupBy(
        F.concat(F.lit("inventory_recommendations_"), F.date_format(F.trunc("ds", "month"), "yyyyMMdd")).alias("run_id"),
        F.col("sku").alias("item_id"), "channel").agg(F.sum("qty").alias("total_forecasted_demand"))


EVENTS = [("valentines", dt.date(2000, 2, 14), 4, 1), ("diwali", dt.date(2000, 10, 26), 11, 20),
          ("black_friday", dt.date(2000, 11, 24), 4, 6)]
PROMO = (dt.date(2000, 1, 1), dt.date(2000, 4, 30), 90)

_LINES = """SELECT CAST(l.l_shipdate AS DATE) AS ds,
  {sku} AS sku, {category} AS category,
  CASE l.l_partkey % 3 WHEN 0 THEN 'women' WHEN 1 THEN 'men' ELSE 'unisex' END AS gender,
  CASE l.l_returnflag WHEN 'A' THEN 'App' WHEN 'N' THEN 'Web' ELSE 'Offline' END AS channel,
  l.l_quantity AS qty, round(l.l_discount * 100) AS disc,
  CAST(c.cents - c.rev AS DOUBLE) AS disc_amt, CAST(c.rev AS DOUBLE) AS revenue,
  l.l_linestatus AS status, l.l_orderkey AS order_key, l.l_linenumber AS line_no,
  l.l_suppkey AS supp_key, l.l_extendedprice AS list_price
 FROM (SELECT *, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents,
   CAST(round(l_extendedprice * 100) AS BIGINT) * (100 - CAST(round(l_discount * 100) AS BIGINT)) // 100 AS rev
   FROM lineitem) l JOIN part p ON l.l_partkey = p.p_partkey, LATERAL (SELECT l.cents, l.rev) c"""
_FAMILY_SKU = ("(CASE CAST(substr(p.p_brand, 7) AS INTEGER) % 3 WHEN 0 THEN 'EAR' WHEN 1 THEN 'RNG' "
               "ELSE 'NCK' END)")
_RAW = """SELECT CASE k WHEN 3 THEN 'not a date' WHEN 4 THEN strftime(ds, '%Y-%m-%d')
   ELSE strftime(ds, '%d/%m/%Y') END AS created_at,
  CASE WHEN k = 5 THEN NULL ELSE sku END AS sku,
  CASE k WHEN 0 THEN '1,' || lpad(CAST(CAST(qty AS INTEGER) AS VARCHAR), 3, '0') WHEN 6 THEN '0'
   WHEN 7 THEN NULL WHEN 8 THEN 'n/a' ELSE CAST(CAST(qty AS INTEGER) AS VARCHAR) END AS qty,
  category, gender, CAST(CAST(disc AS INTEGER) AS VARCHAR) AS disc,
  CASE WHEN k = 9 THEN '₹' || CAST(CAST(revenue AS BIGINT) AS VARCHAR) || '.50'
   ELSE CAST(CAST(revenue AS BIGINT) AS VARCHAR) END AS revenue,
  CASE k WHEN 1 THEN NULL WHEN 2 THEN ' ' || channel || ' ' ELSE channel END AS channel_text
 FROM (SELECT *, order_key % 50 AS k FROM {base})"""
_DAY = ("coalesce(CAST(try_strptime(created_at, '%d/%m/%Y') AS DATE), "
        "CAST(try_strptime(created_at, '%Y-%m-%d') AS DATE))")
_CLEAN = f"""SELECT * FROM (SELECT {_DAY} AS ds, sku, category, gender,
  coalesce(trim(channel_text), 'Unknown') AS channel, coalesce(TRY_CAST(qty AS DOUBLE), 0) AS qty,
  coalesce(TRY_CAST(disc AS DOUBLE), 0) AS disc FROM {{base}}) WHERE ds IS NOT NULL"""
_INVENTORY = """SELECT sku, ds, CAST((supp_key * 13 + day(ds) * 7) % 5 AS DOUBLE) AS wh
 FROM (SELECT DISTINCT sku, ds, supp_key FROM {base})"""
_STOCK = "SELECT sku, ds, sum(wh) AS warehouse_qty FROM {base} GROUP BY sku, ds"
_DENSE = """SELECT i.item_id, c.ds, coalesce(d.y, 0) AS y
 FROM (SELECT DISTINCT item_id FROM {base}) i
 CROSS JOIN (SELECT CAST(unnest(generate_series((SELECT min(ds) FROM {base}), (SELECT max(ds) FROM {base}),
   INTERVAL 1 DAY)) AS DATE) AS ds) c
 LEFT JOIN {base} d ON d.item_id = i.item_id AND d.ds = c.ds"""

CTES = {
    "sales": _LINES.format(sku="p.p_type || CAST(l.l_partkey AS VARCHAR)", category="p.p_type"),
    "family": _LINES.format(sku=_FAMILY_SKU + " || substr(p.p_brand, 7)", category=_FAMILY_SKU),
    "raw_sales": _RAW.format(base="sales"),
    "raw_family": _RAW.format(base="family"),
    "clean_sales": _CLEAN.format(base="raw_sales"),
    "clean_family": _CLEAN.format(base="raw_family"),
    "inventory": _INVENTORY.format(base="sales"),
    "inventory_family": _INVENTORY.format(base="family"),
    "stock": _STOCK.format(base="inventory"),
    "stock_family": _STOCK.format(base="inventory_family"),
    "holidays": "SELECT d.ds, h.name, h.kind FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS ds FROM orders) d "
                "JOIN (VALUES " + ", ".join(
                    "({}, {}, '{}', '{}')".format(m, d, n, t.replace("'", "''")) for m, d, n, t in HOLIDAYS)
                + ") h(m, d, name, kind) ON month(d.ds) = h.m AND day(d.ds) = h.d",
    "holiday_days": "SELECT DISTINCT ds, 1 AS is_holiday FROM holidays",
    "store_count": """SELECT year, month, CAST(sum(n) OVER (ORDER BY year, month) AS DOUBLE) AS stores
 FROM (SELECT year(d) AS year, month(d) AS month, count(*) AS n FROM
  (SELECT o_custkey, min(o_orderdate) AS d FROM orders GROUP BY o_custkey) GROUP BY 1, 2)""",
    "store_points": "SELECT make_date(year, month, 1) AS ds, stores FROM store_count",
    "store_days": """SELECT c.ds, CASE WHEN p.ds = c.ds OR n.ds IS NULL THEN p.stores
  ELSE p.stores + (n.stores - p.stores) * (date_diff('day', p.ds, c.ds) / CAST(date_diff('day', p.ds, n.ds) AS DOUBLE)) END AS store_count
 FROM (SELECT CAST(unnest(generate_series((SELECT min(ds) FROM store_points), (SELECT max(ds) FROM store_points), INTERVAL 1 DAY)) AS DATE) AS ds) c
 ASOF JOIN store_points p ON c.ds >= p.ds
 ASOF LEFT JOIN store_points n ON c.ds < n.ds""",
    "feedback": f"""SELECT ts - INTERVAL {FEEDBACK_SHIFT_DAYS} DAY AS ts,
  CASE (user_id % 25 + 1) % 3 WHEN 0 THEN 'EAR' WHEN 1 THEN 'RNG' ELSE 'NCK' END || CAST(user_id % 25 + 1 AS VARCHAR) AS selected_sku,
  CASE event_id % 3 WHEN 0 THEN 'App' WHEN 1 THEN 'Web' ELSE 'Offline' END AS channel,
  CASE event_type WHEN 'error' THEN 'Stockout occurred' WHEN 'click' THEN 'Good forecast' WHEN 'view' THEN 'Forecast too high'
   WHEN 'signup' THEN 'Forecast too low' ELSE 'Other' END AS feedback FROM events""",
    "scores": """SELECT selected_sku || '_' || channel AS item_id, ts, CASE feedback WHEN 'Forecast too high' THEN -1.0
  WHEN 'Forecast too low' THEN 1.0 WHEN 'Stockout occurred' THEN 1.5 ELSE 0.0 END::DOUBLE AS score FROM feedback""",
    "feedback_avg": """SELECT DISTINCT item_id, ts, avg(score) OVER (PARTITION BY item_id ORDER BY ts
  RANGE BETWEEN INTERVAL '29 days 23:59:59.999999' PRECEDING AND CURRENT ROW) AS avg30 FROM scores""",
    "feedback_days": """SELECT item_id, CAST(ts AS DATE) AS ds, max_by(avg30, ts) AS avg30
 FROM feedback_avg GROUP BY 1, 2""",
    "metal_days": """SELECT ds, CASE WHEN inr > 0 THEN lo / 1000 / inr ELSE 0 END AS silver_price_inr,
  CASE WHEN inr > 0 THEN hi / 100 / inr ELSE 0 END AS gold_price_inr FROM
  (SELECT *, CASE WHEN day(ds) = 17 THEN 0 ELSE 0.01::DOUBLE + (day(ds) % 5) / 1000.0::DOUBLE END AS inr FROM
   (SELECT CAST(o_orderdate AS DATE) AS ds, max(o_totalprice) AS hi, min(o_totalprice) AS lo FROM orders GROUP BY 1))""",
    "metal_features": """SELECT ds, """ + ", ".join(
        f"coalesce(({m}_price_inr - lag({m}_price_inr) OVER w) / nullif(lag({m}_price_inr) OVER w, 0), 0) AS {m}_price_change, "
        f"avg({m}_price_inr) OVER (ORDER BY ds ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS {m}_price_ma_7"
        for m in ("silver", "gold")) + " FROM metal_days WINDOW w AS (ORDER BY ds)",
    "order_lines": """SELECT s.*, CAST(o.o_orderdate AS DATE) AS order_day, round(o.o_totalprice * 100) AS total_price,
  CAST(o.o_custkey % 26 AS INTEGER) AS location_id, o.o_orderkey, o.o_custkey,
  CASE o.o_orderpriority WHEN '1-URGENT' THEN 'pos' WHEN '2-HIGH' THEN 'web' WHEN '3-MEDIUM' THEN '5204949'
   WHEN '4-NOT SPECIFIED' THEN 'android' ELSE 'ios' END AS source_name,
  CASE WHEN o.o_orderstatus = 'P' AND s.line_no = 7 THEN 'warranty' WHEN o.o_orderstatus = 'P' AND s.line_no = 6 THEN 'Replacement,vip'
   WHEN o.o_orderstatus = 'O' THEN 'app_wallet_used,app_wallet_used_amount_5000,COD + Wallet' ELSE 'vip' END AS tags,
  CASE WHEN o.o_orderstatus = 'O' THEN round(o.o_totalprice * 100) + 5000 ELSE round(o.o_totalprice * 100) END AS final_price,
  CASE WHEN s.line_no = 5 THEN 'Test' ELSE 'c' END || CAST(o.o_custkey AS VARCHAR) || '@shop.example' AS email,
  CASE s.line_no % 3 WHEN 0 THEN 0 WHEN 1 THEN disc_amt ELSE disc_amt + 100 END AS discount,
  CASE s.line_no % 3 WHEN 0 THEN 0 ELSE disc_amt END AS first_discount
 FROM sales s JOIN orders o ON s.order_key = o.o_orderkey""",
    "genuine_lines": """SELECT * FROM order_lines WHERE lower(email) NOT LIKE '%test%' AND lower(tags) NOT LIKE '%replacement%'
  AND lower(tags) NOT LIKE '%warranty%' AND lower(tags) NOT LIKE '%rr%'""",
    "order_items": """SELECT order_day, sku, qty AS quantity, revenue + disc_amt AS price, discount, first_discount,
  source_name, location_id, total_price, final_price, genuine FROM (SELECT *, lower(email) NOT LIKE '%test%'
   AND lower(tags) NOT LIKE '%replacement%' AND lower(tags) NOT LIKE '%warranty%' AND lower(tags) NOT LIKE '%rr%' AS genuine FROM order_lines)
 UNION ALL SELECT order_day, 'GW' || sku, 1, 500, 0, 0, source_name, location_id, total_price, final_price,
  lower(email) NOT LIKE '%test%' AND lower(tags) NOT LIKE '%replacement%' AND lower(tags) NOT LIKE '%warranty%' AND lower(tags) NOT LIKE '%rr%' FROM order_lines""",
    "pos_sales": """SELECT order_day AS ds, sku, n_name AS channel, sum(quantity) AS quantity, sum(quantity * price) AS revenue
 FROM order_items LEFT JOIN nation ON location_id = n_nationkey WHERE source_name = 'pos' AND price <> 0 AND genuine GROUP BY 1, 2, 3""",
    "web_sales": """SELECT order_day AS ds, sku, 'Web' AS channel, sum(quantity) AS quantity, sum(quantity * price - discount) AS revenue
 FROM order_items WHERE source_name NOT IN ('pos', '5204949', '232217378817') AND price <> 0 AND genuine GROUP BY 1, 2""",
    "app_sales": """SELECT order_day AS ds, sku, 'App' AS channel, sum(quantity) AS quantity,
  sum(price / total_price * final_price * quantity - first_discount) AS revenue
 FROM order_items WHERE source_name IN ('5204949', '232217378817') AND price <> 0 AND genuine GROUP BY 1, 2""",
    "training_status": """SELECT sku || '_' || channel AS item_id, max(ds) AS last_trained FROM family
 WHERE status = 'F' AND channel <> 'Offline' GROUP BY 1""",
    "model_runs": """SELECT 'inventory_recommendations_' || strftime(d, '%Y%m%d') AS run_id, d AS trained_date,
  CASE WHEN month(d) <> 5 THEN f END AS mase, hi / 1000 AS rmse, p AS mape,
  CASE WHEN month(d) = 7 THEN 'reject' ELSE 'promote' END AS decision FROM
  (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS d, count(*) FILTER (o_orderstatus = 'F') / CAST(count(*) AS DOUBLE) AS f,
   max(o_totalprice) AS hi, count(*) FILTER (o_orderstatus = 'P') / CAST(count(*) AS DOUBLE) AS p FROM orders GROUP BY 1)""",
    "versions": """SELECT 'inventory_recommendations_' || strftime(date_trunc('month', ds), '%Y%m%d') AS run_id,
  sku AS item_id, channel, sum(qty) AS total_forecasted_demand FROM family GROUP BY 1, 2, 3""",
    # Daily observations and dense series of the family items.
    "item_daily": "SELECT sku || '_' || channel AS item_id, ds, sum(qty) AS y FROM family GROUP BY 1, 2",
    "sku_daily": "SELECT sku AS item_id, ds, sum(qty) AS y FROM family GROUP BY 1, 2",
    "item_series": _DENSE.format(base="item_daily"),
    "sku_series": _DENSE.format(base="sku_daily"),
    "day_list": """SELECT CAST(unnest(generate_series((SELECT min(ds) FROM family), (SELECT max(ds) FROM family), INTERVAL 1 DAY)) AS DATE) AS ds""",
    "grid": """SELECT i.item_id, i.sku, i.channel, c.ds, d.y FROM
  (SELECT DISTINCT sku || '_' || channel AS item_id, sku, channel FROM family) i CROSS JOIN day_list c
  LEFT JOIN item_daily d ON d.item_id = i.item_id AND d.ds = c.ds""",
    "sku_grid": """SELECT i.item_id, c.ds, d.y FROM (SELECT DISTINCT item_id FROM sku_daily) i CROSS JOIN day_list c
  LEFT JOIN sku_daily d ON d.item_id = i.item_id AND d.ds = c.ds""",
    # Dense per-SKU frame of the second preparation: own span, clipped, interpolated.
    "sku_sums": "SELECT sku, ds, sum(qty) AS y, sum(disc) AS disc, sum(revenue) AS revenue FROM family GROUP BY 1, 2",
    "sku_caps": """SELECT sku, quantile_cont(y, 0.75) + 1.5::DOUBLE * (quantile_cont(y, 0.75) - quantile_cont(y, 0.25)) AS cap,
  min(ds) AS lo, max(ds) AS hi FROM sku_sums GROUP BY 1""",
    "sku_points": """SELECT c.sku, c.ds, CASE WHEN s.y IS NOT NULL THEN least(greatest(s.y, 0), c.cap) END AS y, s.disc, s.revenue,
  CASE WHEN st.warehouse_qty = 0 THEN 1 ELSE 0 END AS out_of_stock FROM
  (SELECT sku, cap, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS ds FROM sku_caps) c
  LEFT JOIN sku_sums s ON s.sku = c.sku AND s.ds = c.ds
  LEFT JOIN stock_family st ON st.sku = c.sku AND st.ds = c.ds AND s.y IS NOT NULL""",
    "sku_frame": """SELECT sku, ds, coalesce(CASE WHEN y IS NOT NULL THEN y WHEN ny IS NULL THEN py
   ELSE py + (ny - py) * (date_diff('day', pd, ds) / CAST(date_diff('day', pd, nd) AS DOUBLE)) END, 0) AS y,
  coalesce(disc, 0) AS disc, coalesce(revenue, 0) AS revenue, out_of_stock AS was_stocked_out,
  coalesce(store_count, CASE WHEN ds > (SELECT max(ds) FROM store_days) THEN (SELECT max_by(store_count, ds) FROM store_days)
   ELSE (SELECT min_by(store_count, ds) FROM store_days) END) AS store_count FROM
  (SELECT *, last_value(y IGNORE NULLS) OVER b AS py, last_value(CASE WHEN y IS NOT NULL THEN ds END IGNORE NULLS) OVER b AS pd,
   first_value(y IGNORE NULLS) OVER f AS ny, first_value(CASE WHEN y IS NOT NULL THEN ds END IGNORE NULLS) OVER f AS nd FROM sku_points
   WINDOW b AS (PARTITION BY sku ORDER BY ds ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    f AS (PARTITION BY sku ORDER BY ds ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
  LEFT JOIN store_days USING (ds)""",
    # Moving-average forecast and what follows from it.
    "sma_level": """SELECT item_id, avg(y) AS mean, max(ds) AS last_ds FROM
  (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY ds DESC) AS age FROM item_series) WHERE age <= 7 GROUP BY 1""",
    "sma": """SELECT 'SMA' AS model, item_id, CAST(step AS INTEGER) AS step, CAST(last_ds + CAST(step AS INTEGER) AS DATE) AS ds, mean
 FROM sma_level, (SELECT unnest(generate_series(1, 183)) AS step)""",
    "naive": """SELECT 'SeasonalNaive' AS model, f.item_id, f.step, f.ds, h.y AS mean FROM sma f
 JOIN (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY ds DESC) AS age FROM item_series) h
 ON h.item_id = f.item_id AND h.age = 7 - (f.step - 1) % 7""",
    "volume": "SELECT sku, sum(qty) AS units FROM family GROUP BY sku",
    "abc": """SELECT sku, units, position, CASE WHEN position <= floor(n * 0.2::DOUBLE) THEN 'A'
   WHEN position <= floor(n * 0.2::DOUBLE) + floor(n * 0.3::DOUBLE) THEN 'B' ELSE 'C' END AS class FROM
  (SELECT *, row_number() OVER (ORDER BY units DESC, sku) AS position, count(*) OVER () AS n FROM volume)""",
    "horizons": "SELECT * FROM (VALUES ('1-Month', 30), ('3-Month', 90), ('6-Month', 183)) h(horizon, forecast_days)",
    "by_horizon": """SELECT f.item_id, h.horizon, h.forecast_days, sum(greatest(f.mean, 0)) AS demand,
  avg(greatest(f.mean, 0)) AS mu, stddev_samp(greatest(f.mean, 0)) AS sigma
 FROM {forecast} f JOIN horizons h ON f.step <= h.forecast_days GROUP BY 1, 2, 3""",
    "stock_metrics": """SELECT b.*, regexp_extract(b.item_id, '^(.*)_([^_]*)$', 1) AS sku,
  regexp_extract(b.item_id, '^(.*)_([^_]*)$', 2) AS channel, coalesce(a.class, 'C') AS class,
  greatest(0, mu * 40) AS lead_time_demand,
  {z}
    * coalesce(sigma, 0) * sqrt(40.0::DOUBLE) AS safety_stock,
  greatest(10, CASE WHEN mu > 0 THEN sqrt(2.0::DOUBLE * mu * 365 * 10 / 20) ELSE 0 END) AS eoq
 FROM by_horizon b LEFT JOIN abc a ON a.sku = regexp_extract(b.item_id, '^(.*)_([^_]*)$', 1)""",
    "recommendations": """SELECT sku AS item_id, channel, CASE channel WHEN 'Web' THEN 'central_online_wh' WHEN 'App' THEN 'central_online_wh'
   WHEN 'Offline' THEN 'central_offline_wh' WHEN 'Unknown' THEN 'main_wh' ELSE 'unknown_wh' END AS recommended_warehouse,
  horizon, forecast_days, round_even(demand, 2) AS total_forecasted_demand,
  CAST(round_even(safety_stock, 0) AS INTEGER) AS safety_stock,
  CAST(round_even(lead_time_demand + safety_stock, 0) AS INTEGER) AS reorder_point,
  CAST(round_even(eoq, 0) AS INTEGER) AS eoq FROM stock_metrics""",
}
CTES["by_horizon"] = CTES["by_horizon"].replace("{forecast}", "naive")


def z_sql(cls: str) -> str:
    """The normal quantile of a class's service level as a CASE expression."""
    z = {c: repr(config.z_score(p)) for c, p in config.SERVICE_LEVELS.items()}
    return f"(CASE {cls} WHEN 'A' THEN {z['A']} WHEN 'B' THEN {z['B']} ELSE {z['C']} END)::DOUBLE"


CTES["stock_metrics"] = CTES["stock_metrics"].replace("{z}", z_sql("coalesce(a.class, 'C')"))

_WORD = re.compile(r"[a-z_]+")


def sql(body: str, **extra: str) -> str:
    """``body`` as a full statement: the views it mentions, then ``extra`` ones, before it."""
    known = {**CTES, **extra}
    order: list[str] = []

    def need(text: str, me: str = "") -> None:
        for word in dict.fromkeys(_WORD.findall(text)):
            if word in known and word != me and word not in order:
                need(known[word], word)
                if word not in order:
                    order.append(word)

    need(body)
    head = ",\n".join(f"{n} AS ({known[n]})" for n in order)
    return f"WITH {head}\n{body}" if order else body
