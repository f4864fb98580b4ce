"""Sales from nested order documents: three channels, unioned and regrouped.

Line items are exploded once; discounts are folded inside the array, so a line with several
allocations is counted once. Only the fields used are read from the nested columns.
"""

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder import config
from larder.functions import cleaning as cl


def order_scan(orders: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """Orders of a date range; the filter prunes partitions or row groups on ``created_at``."""
    return orders.where(F.col("created_at").between(F.lit(start), F.lit(end)))


def genuine(orders: DataFrame) -> DataFrame:
    return orders.where(cl.genuine_order())


def lines(orders: DataFrame, *extra) -> DataFrame:
    """One row per line item with a price."""
    return (orders.select(F.col("created_at").alias("ds"), *extra,
                          F.explode("line_items").alias("item"))
            .where(F.col("item.price") != 0))


def _discount():
    return F.aggregate(F.coalesce("item.discount_allocations", F.array().cast("array<struct<amount:double>>")),
                       F.lit(0.0), lambda acc, d: acc + F.coalesce(d["amount"], F.lit(0.0)))


def _totals(rows: DataFrame, keys, revenue) -> DataFrame:
    return rows.groupBy(*keys).agg(F.sum("item.quantity").alias("quantity"),
                                   F.sum(revenue).alias("revenue"))


def _keys(by_day: bool):
    return ([F.col("ds")] if by_day else []) + [F.col("item.sku").alias("sku")]


def store_channel(orders: DataFrame, stores: DataFrame) -> DataFrame:
    """Orders with the store's name as channel, null where the store is unknown."""
    return orders.join(stores.select(F.col("store_id").alias("location_id"),
                                     F.col("store_name").alias("channel")),
                       "location_id", "left")


def pos_sales(orders: DataFrame, stores: DataFrame) -> DataFrame:
    """Store sales at list price by day, SKU and store.

    Totals are taken per location first, so the store lookup joins a small aggregate and one
    busy store does not make a hot join key.
    """
    rows = lines(orders.where(F.col("source_name") == "pos"), "location_id")
    by_location = _totals(rows, [*_keys(True), "location_id"],
                          F.col("item.quantity") * F.col("item.price"))
    return (store_channel(by_location, stores).groupBy("ds", "sku", "channel")
            .agg(F.sum("quantity").alias("quantity"), F.sum("revenue").alias("revenue")))


def web_sales(orders: DataFrame, by_day: bool = True, source: str | None = None) -> DataFrame:
    """Web sales net of discounts; ``source`` names one source, else all but store and app."""
    keep = (F.col("source_name") == source if source
            else ~F.col("source_name").isin("pos", *config.APP_SOURCES))
    rows = lines(orders.where(keep))
    return (_totals(rows, _keys(by_day), F.col("item.quantity") * F.col("item.price") - _discount())
            .withColumn("channel", F.lit("Web")))


def app_sales(orders: DataFrame, by_day: bool = True, sources=config.APP_SOURCES) -> DataFrame:
    """App sales with prices scaled to the total incl. wallet money, minus the first allocation."""
    rows = lines(orders.where(F.col("source_name").isin(*sources)), "total_price",
                 cl.wallet_price().alias("final_price"))
    scaled = (F.try_divide("item.price", "total_price") * F.col("final_price")
              * F.col("item.quantity"))
    first = F.get("item.discount_allocations", F.lit(0))["amount"]
    return (_totals(rows, _keys(by_day), scaled - F.coalesce(first, F.lit(0.0)))
            .withColumn("channel", F.lit("App")))


def _line_revenue(sources) -> Column:
    """The revenue of a line of an order by its source: list price in stores, scaled to the paid total in the app, net on the web."""
    price = F.col("item.quantity") * F.col("item.price")
    scaled = F.try_divide("item.price", "total_price") * F.col("final_price") * F.col("item.quantity")
    first = F.coalesce(F.get("item.discount_allocations", F.lit(0))["amount"], F.lit(0.0))
    return (F.when(F.col("source_name") == "pos", price).when(F.col("source_name").isin(*sources), scaled - first)
            .otherwise(price - _discount()))


def all_sales(orders: DataFrame, stores: DataFrame) -> DataFrame:
    """Units and revenue by day, SKU and channel over the three channels, sellable SKUs only.

    The documents are read and exploded once. Totals are taken per source and location first, so the store
    lookup joins a small aggregate.
    """
    rows = lines(genuine(orders).where("source_name IS NOT NULL"), "source_name", "location_id", "total_price",
                 cl.wallet_price().alias("final_price")).where(cl.sellable_sku("item.sku"))
    source = F.when(F.col("source_name") == "pos", "pos").when(F.col("source_name").isin(*config.APP_SOURCES), "App").otherwise("Web")
    place = F.when(F.col("source_name") == "pos", F.col("location_id"))
    totals = _totals(rows.withColumns({"source": source, "location_id": place}), [*_keys(True), "source", "location_id"],
                     _line_revenue(config.APP_SOURCES))
    named = stores.select(F.col("store_id").alias("location_id"), "store_name")
    channel = F.when(F.col("source") == "pos", F.col("store_name")).otherwise(F.col("source"))
    return (totals.join(named, "location_id", "left").withColumn("channel", channel).groupBy("ds", "sku", "channel")
            .agg(F.sum("quantity").alias("quantity"), F.sum("revenue").alias("revenue")))


def master_sales(orders: DataFrame, app_sources=("android", "ios")) -> DataFrame:
    """Units and revenue by SKU and source over web and app, from one pass over the documents."""
    rows = lines(orders.where(F.col("source_name").isin("web", *app_sources)), "source_name", "total_price",
                 cl.wallet_price().alias("final_price")).where(cl.sellable_sku("item.sku"))
    source = F.when(F.col("source_name") == "web", "web").otherwise("app")
    totals = _totals(rows.withColumn("source", source), [*_keys(False), "source"], _line_revenue(app_sources))
    return totals.select("sku", "source", F.col("quantity").alias("qty"), "revenue")
