"""Cleaning, daily aggregation and joins of sales, stock and day dimensions."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder import config
from larder.functions import cleaning as cl
from larder.operators import grid
from larder.operators.ordered import newest, quantiles
from larder.session import stage


def clean_sales(raw: DataFrame) -> DataFrame:
    """Typed sales lines: dates parsed, bad dates dropped, bad numbers 0, channel trimmed."""
    return raw.select(
        cl.any_day("created_at").alias("ds"), "sku", "category", "gender",
        cl.channel_name("Channel").alias("channel"),
        cl.number_or_zero("qty").alias("qty"),
        cl.number_or_zero("disc").alias("disc"),
    ).dropna(subset=["ds"])


def clean_required(raw: DataFrame) -> DataFrame:
    """The stricter variant: currency text is accepted, incomplete lines are dropped."""
    return raw.select(
        cl.any_day("created_at").alias("ds"), "sku",
        *[cl.strict_number(c).alias(c) for c in ("qty", "revenue", "disc")],
    ).dropna(subset=["ds", "sku", "qty", "revenue"])


def daily_sales(sales: DataFrame) -> DataFrame:
    """Units and mean discount per item and day, with the item's category and gender.

    Only figures are aggregated over the lines, which hashing does; a maximum of text would sort every line
    first. The attributes come from the items' own small table: an item has one category and gender, the
    greatest where lines disagree.
    """
    lines = sales.where(F.col("sku").isNotNull()).withColumn("item_id", cl.item_id())
    daily = lines.groupBy("item_id", "sku", "channel", "ds").agg(F.sum("qty").alias("target"), F.avg("disc").alias("disc"))
    items = distinct_rows(lines, "item_id", "category", "gender").groupBy("item_id").agg(
        F.max("category").alias("category"), F.max("gender").alias("gender"))
    return daily.join(items, "item_id").select("item_id", "sku", "channel", "ds", "target", "disc", "category", "gender")


def distinct_rows(df: DataFrame, *columns: str) -> DataFrame:
    """Distinct values by hashing, also below a minimum or maximum.

    Spark drops a plain ``distinct`` there as redundant and sorts all rows by the text; the number of rows, which the
    filter needs, keeps the step.
    """
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n")).where("_n > 0").drop("_n")


def daily_stock(inventory: DataFrame) -> DataFrame:
    """Stock per SKU and day, summed over warehouses."""
    return (inventory.where(F.col("sku").isNotNull() & F.col("ds").isNotNull())
            .groupBy("sku", "ds").agg(F.sum("wh").alias("warehouse_qty")))


def join_stock(daily: DataFrame, stock: DataFrame) -> DataFrame:
    """Left join daily stock; an unknown stock counts as 1, i.e. in stock."""
    return (daily.join(stock, ["sku", "ds"], "left")
            .withColumn("warehouse_qty", F.coalesce("warehouse_qty", F.lit(1.0))))


def holiday_days(holidays: DataFrame) -> DataFrame:
    """One flagged row per holiday date."""
    return (holidays.select(cl.iso_day("Date").alias("ds")).dropna().distinct()
            .withColumn("is_holiday", F.lit(1)))


def named_holidays(holidays: DataFrame, types=config.HOLIDAY_TYPES) -> DataFrame:
    """Distinct (date, name) of the holidays whose type list names one of ``types``."""
    return (holidays.where(F.col("Type").rlike("|".join(types)))
            .select(cl.iso_day("Date").alias("ds"), F.col("Name").alias("holiday"))
            .dropDuplicates().dropna())


def join_days(panel: DataFrame, days: DataFrame, fill: dict[str, object]) -> DataFrame:
    """Left join a table with one row per calendar day; missing days take ``fill``.

    ``days`` is reduced to one row per date, so its size is bounded by the calendar and the
    broadcast cannot grow with the sales.
    """
    cols = list(fill)
    one = days.groupBy("ds").agg(*[F.max(c).alias(c) for c in cols])
    out = panel.join(F.broadcast(one), "ds", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in fill.items()})


def store_days(store_count: DataFrame) -> DataFrame:
    """Monthly store counts to a daily, linearly interpolated series."""
    monthly = store_count.dropna().groupBy(
        F.lit("all").alias("series"), F.make_date("year", "month", F.lit(1)).alias("ds")).agg(
        F.max(F.col("stores").cast("double")).alias("store_count"))
    # One row per month: a single group is bounded by the calendar.
    return grid.dense_panel(monthly, "series", fills={"store_count": "interpolate_back"}).drop("series")


def join_stores(panel: DataFrame, days: DataFrame) -> DataFrame:
    """Join the store count; days past its end carry the last one, days before it the first."""
    days = days.groupBy("ds").agg(F.max("store_count").alias("store_count"))  # one row per date
    last = days.agg(F.max_by("store_count", "ds")).scalar()
    first = days.agg(F.min_by("store_count", "ds")).scalar()
    end = days.agg(F.max("ds")).scalar()
    out = panel.join(F.broadcast(days), "ds", "left")
    return out.withColumn("store_count", F.coalesce(
        "store_count", F.when(F.col("ds") > end, last).otherwise(first)))


def top_skus(sales: DataFrame, n: int) -> DataFrame:
    """The ``n`` SKUs with most units; ties go to the smaller SKU."""
    return (sales.where(F.col("sku").isNotNull()).groupBy("sku")
            .agg(F.sum("qty").alias("units")).orderBy(F.desc("units"), "sku").limit(n))


def keep_skus(df: DataFrame, skus: DataFrame) -> DataFrame:
    return df.join(skus.select("sku"), "sku", "left_semi")


def union_new_sales(history: DataFrame, uploads: DataFrame, recency: list[Column],
                    keys=("sku", "channel", "ds")) -> DataFrame:
    """History and uploads stacked, the newest record kept per key; uploads win over history."""
    both = history.withColumn("_gen", F.lit(0)).unionByName(uploads.withColumn("_gen", F.lit(1)))
    return newest(both, list(keys), [F.col("_gen"), *recency]).drop("_gen")


def period_slice(df: DataFrame, days: int) -> DataFrame:
    """The last ``days`` days up to the table's newest date."""
    last = df.agg(F.max("ds")).scalar()
    return df.where(F.col("ds") >= F.date_sub(last, days - 1))


def last_months(sales: DataFrame, months=(1, 3, 6), by: tuple[str, ...] = ("sku",)) -> DataFrame:
    """Units of the last months before the newest date, all horizons in one pass."""
    last = sales.agg(F.max("ds")).scalar()
    recent = sales.where(F.col("ds") >= F.add_months(last, -max(months)))
    return recent.groupBy(*by).agg(
        *[F.coalesce(F.sum(F.when(F.col("ds") >= F.add_months(last, -m), F.col("qty"))),
                     F.lit(0.0)).alias(f"units_{m}m") for m in months],
        *[F.count(F.when(F.col("ds") >= F.add_months(last, -m), 1)).alias(f"records_{m}m")
          for m in months])


def unit_prices(sales: DataFrame) -> DataFrame:
    """Unit price per line; lines without units take the SKU median, else the overall median.

    Medians use the range-partitioned quantiles: a hot SKU may hold a third of all lines. Both
    start from one count of each price per SKU.
    """
    priced = sales.withColumn("unit_price", F.try_divide("revenue", "qty"))
    counted = stage(priced.where("unit_price IS NOT NULL").groupBy("sku", "unit_price")
                    .agg(F.count(F.lit(1)).alias("n")), "prices")
    by_sku = quantiles(counted, "unit_price", {"sku_median": 0.5}, ("sku",), weight="n")
    overall = quantiles(counted, "unit_price", {"m": 0.5}, weight="n").select("m").scalar()
    return (priced.join(by_sku, "sku", "left")
            .withColumn("unit_price", F.coalesce("unit_price", "sku_median", overall))
            .drop("sku_median"))


def average_net_price(sales: DataFrame) -> DataFrame:
    """Mean of (revenue - discount) / qty over lines with units."""
    return (sales.dropna(subset=["revenue", "disc", "qty"]).where(F.col("qty") > 0)
            .groupBy("sku").agg(F.avg((F.col("revenue") - F.col("disc")) / F.col("qty"))
                                .alias("avg_price")))


def clip_outliers(daily: DataFrame, c: str = "y", key: str = "sku") -> DataFrame:
    """Clip to [0, q3 + 1.5 (q3 - q1)] per key; ``daily`` has one row per key and day."""
    q = daily.groupBy(key).agg(
        F.percentile(c, F.array(F.lit(0.25), F.lit(0.75))).alias("_q"))
    cap = F.col("_q")[1] + F.lit(1.5) * (F.col("_q")[1] - F.col("_q")[0])
    return (daily.join(q, key)
            .withColumn(c, F.least(F.greatest(F.col(c), F.lit(0.0)), cap)).drop("_q"))


def min_history(daily: DataFrame, days: int = config.PREDICTION_LENGTH) -> DataFrame:
    """Items whose history, first sale to the newest date of the table, exceeds ``days``."""
    last = daily.agg(F.max("ds")).scalar()
    return (daily.groupBy("item_id").agg(F.min("ds").alias("first_ds"))
            .withColumn("history_days", F.datediff(last, "first_ds") + 1)
            .where(F.col("history_days") > days))


def sku_frame(sales: DataFrame, stores: DataFrame, stock: DataFrame) -> DataFrame:
    """Dense daily frame per SKU: clipped and interpolated units, stores, stock-outs, money."""
    daily = sales.groupBy("sku", "ds").agg(
        F.sum("qty").alias("y"), F.sum("disc").alias("disc"), F.sum("revenue").alias("revenue"))
    daily = daily.join(stock, ["sku", "ds"], "left").withColumn(
        "was_stocked_out", F.coalesce((F.col("warehouse_qty") == 0).cast("int"), F.lit(0))
    ).drop("warehouse_qty")
    panel = grid.dense_panel(clip_outliers(daily), "sku", fills={
        "y": "interpolate", "disc": "zero", "revenue": "zero"}).fillna(0, subset=["was_stocked_out"])
    return join_stores(panel, stores)


def one_hot(items: DataFrame, vocab: dict[str, list[str]]) -> DataFrame:
    """One 0/1 column per known value; the saved vocabulary fixes the column set."""
    return items.select("item_id", *[
        F.coalesce((F.col(c) == v).cast("double"), F.lit(0.0)).alias(f"{c}_{v}")
        for c, values in vocab.items() for v in values])


STATIC = ("category", "gender", "brand_category", "category_channel")


def static_attributes(items: DataFrame, brand_prefix: str) -> DataFrame:
    """Missing attributes defaulted, plus the two combined ones."""
    category = F.coalesce("category", F.lit("unknown"))
    channel = F.coalesce("channel", F.lit("Online"))
    return items.select(
        "item_id", category.alias("category"),
        F.coalesce("gender", F.lit("unknown")).alias("gender"),
        F.concat(F.lit(brand_prefix), category).alias("brand_category"),
        F.concat_ws("_", category, channel).alias("category_channel"))


def distinct_items(sales: DataFrame) -> DataFrame:
    """One row of static attributes per item, whatever their order in the source.

    Lines are reduced to distinct attributes by hashing; only those few rows are sorted for the minima.
    """
    names = ["item_id", "sku", "channel", "category", "gender"]
    return (sales.where(F.col("sku").isNotNull()).withColumn("item_id", cl.item_id())
            .transform(distinct_rows, *names).groupBy("item_id", "sku", "channel")
            .agg(F.min("category").alias("category"), F.min("gender").alias("gender")))


def reconcile(df: DataFrame, columns, keep=()) -> DataFrame:
    """Exactly ``keep`` and ``columns``, missing ones added as 0, in one projection."""
    return df.select(*keep, *[F.col(c) if c in df.columns else F.lit(0).alias(c)
                              for c in columns])


def incremental(daily: DataFrame, status: DataFrame) -> DataFrame:
    """Items never trained, or with data newer than their last training."""
    newest_day = daily.groupBy("item_id").agg(F.max("ds").alias("latest"))
    return (newest_day.join(status, "item_id", "left")
            .where(F.col("last_trained").isNull() | (F.col("latest") > F.col("last_trained"))))


def carry_last(panel: DataFrame, columns: list[str], future: DataFrame) -> DataFrame:
    """Future covariates: the item's last known value, else the column's overall mean."""
    last = panel.groupBy("item_id").agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("ds"))).alias(c) for c in columns])
    means = {c: panel.agg(F.avg(c)).scalar() for c in columns}
    return (future.join(last, "item_id", "left")
            .withColumns({c: F.coalesce(c, means[c]) for c in columns}))


def category_series(sales: DataFrame, min_records: int = config.MIN_SERIES_DAYS) -> DataFrame:
    """Daily units per category, from SKUs with at least ``min_records`` lines.

    ``sales`` holds lines, or days with their number of lines as ``records``.
    """
    number = F.sum("records") if "records" in sales.columns else F.count(F.lit(1))
    by_day = (sales.withColumn("sku_cat", cl.sku_category())
              .where(F.col("sku_cat").isNotNull())
              .groupBy("sku", "sku_cat", "ds")
              .agg(F.sum("qty").alias("qty"), number.alias("n")))
    # Days of one SKU are bounded by the calendar, so the window replaces a second scan.
    rich = by_day.withColumn("records", F.sum("n").over(Window.partitionBy("sku"))).where(
        F.col("records") >= min_records)
    return rich.groupBy(F.col("sku_cat").alias("category"), "ds").agg(F.sum("qty").alias("y"))
