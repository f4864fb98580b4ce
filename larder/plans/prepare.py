"""The composed data preparation: raw tables in, feature panel out."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder import config
from larder.functions import cleaning as cl
from larder.functions.calendar import calendar_features, cyclical_encoding, month_boundary
from larder.operators import features as ft
from larder.operators import grid
from larder.operators import sales as sl
from larder.session import stage


def clean_stock(raw: DataFrame) -> DataFrame:
    return raw.select(cl.any_day("date").alias("ds"), "sku", "wh")


def clean_daily(raw_sales: DataFrame, top: DataFrame | None = None) -> DataFrame:
    """Daily item rows of the cleaned sales, staged: the raw table is scanned once."""
    sales = sl.clean_sales(raw_sales)
    return stage(sl.daily_sales(sl.keep_skus(sales, top) if top is not None else sales), "daily")


def observed_days(daily: DataFrame, stock: DataFrame) -> DataFrame:
    """Daily rows with stock and promotion flags, before the panel is made dense.

    Flags and stock only exist on observed days, so they are joined here, on the small side.
    """
    return (sl.join_stock(daily, sl.daily_stock(stock))
            .join(ft.discount_thresholds(daily), "sku", "left")
            .withColumns(ft.promo_flags()).drop("threshold"))


def prepare_data(raw_sales: DataFrame, raw_inventory: DataFrame, holidays: DataFrame,
                 metal_rates: DataFrame | None = None, max_skus: int | None = None) -> DataFrame:
    """The dense feature panel: every item on every day with all history features.

    The item window's exchange carries the observed days only; the dense rows are made and
    scanned by the windows inside their partitions. Day dimensions join last, by broadcast.
    """
    top = sl.top_skus(sl.clean_sales(raw_sales), max_skus) if max_skus is not None else None
    stock = clean_stock(raw_inventory)
    daily = clean_daily(raw_sales, top)
    observed = observed_days(daily, sl.keep_skus(stock, top) if top is not None else stock)
    panel = grid.dense_panel(observed, "item_id", ("sku", "channel", "category", "gender"),
                             grid.day_span(daily))
    panel = ft.history_features(panel).withColumns(calendar_features())
    panel = sl.join_days(panel, sl.holiday_days(holidays), {"is_holiday": 0})
    if metal_rates is not None:
        panel = sl.join_days(panel, ft.metal_features(ft.metal_inr(metal_rates)), ft.METAL_FILL)
    return panel.fillna(0, subset=["target", "disc", "warehouse_qty", "is_on_promotion",
                                   "is_high_discount", "potential_lost_sales"])


def static_items(raw_sales: DataFrame, brand_prefix: str) -> DataFrame:
    return sl.static_attributes(sl.distinct_items(sl.clean_sales(raw_sales)), brand_prefix)


def prepare_for_analysis(raw_sales: DataFrame, holidays: DataFrame,
                         max_skus: int | None = None) -> DataFrame:
    """The simpler panel for analyses: flags per line, holiday flag, fills inside the item."""
    sales = sl.clean_sales(raw_sales).where(F.col("sku").isNotNull())
    if max_skus is not None:
        sales = sl.keep_skus(sales, sl.top_skus(sales, max_skus))
    flagged = (sales.join(ft.discount_thresholds(sales), "sku", "left")
               .withColumns(ft.promo_flags()).withColumn("item_id", cl.item_id()))
    daily = stage(flagged.groupBy("item_id", "sku", "channel", "ds").agg(
        F.sum("qty").alias("target"), F.avg("disc").alias("disc"),
        F.max("is_on_promotion").alias("is_on_promotion"),
        F.max("is_high_discount").alias("is_high_discount")), "analysis")
    panel = grid.dense_panel(
        daily, "item_id", ("sku", "channel"), grid.day_span(daily),
        {"target": "zero", "disc": "zero", "is_on_promotion": "ffill", "is_high_discount": "ffill"})
    panel = panel.withColumns(calendar_features())
    return sl.join_days(panel, sl.holiday_days(holidays), {"is_holiday": 0})


def advanced_features(frame: DataFrame, key: str = "sku") -> DataFrame:
    """Lags, rolling figures and encodings of the dense per-SKU frame, one window pass."""
    return frame.withColumns({
        "discount_percentage": ft.discount_share(),
        "is_on_promotion": F.coalesce((F.col("disc") > 0).cast("int"), F.lit(0)),
        **month_boundary(),
        **ft.lags("y", (1, 7, 14, 30), key),
        **ft.rolling_means("y", (7,), key),
        **ft.rolling_stds("y", (7,), key),
        **cyclical_encoding()})


def prepare_upload(rows: DataFrame, holidays: DataFrame) -> DataFrame:
    """Enrich a validated upload: one row per SKU and day, calendar, holidays and history."""
    good = rows.where(F.col("reject").isNull()).select(
        F.concat_ws("_", "sku", F.lit("Online")).alias("item_id"), "sku", "ds", "target", "disc")
    daily = good.groupBy("item_id", "sku", "ds").agg(
        F.sum("target").alias("target"), F.avg("disc").alias("disc")
    ).withColumn("warehouse_qty", F.lit(1.0))
    panel = ft.history_features(daily).withColumns(calendar_features())
    panel = sl.join_days(panel, sl.holiday_days(holidays), {"is_holiday": 0})
    return sl.reconcile(panel, config.KNOWN_COVARIATES, ("item_id", "sku", "ds", "target", "disc"))


def future_covariates(items: DataFrame, after, holidays: DataFrame,
                      days: int = config.PREDICTION_LENGTH) -> DataFrame:
    """Known covariates of the forecast horizon: calendar, holidays, the rest 0."""
    future = grid.future_days(items, after, days).withColumns(calendar_features())
    return sl.join_days(future, sl.holiday_days(holidays), {"is_holiday": 0})
