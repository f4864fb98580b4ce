"""Declared schemas of the input tables; nothing is inferred from data."""

from pyspark.sql import types as T


def _text(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


SALES = T.StructType(_text("created_at", "sku", "qty", "category", "gender", "disc",
                           "revenue", "Channel"))
INVENTORY = T.StructType([*_text("date", "sku"), T.StructField("wh", T.DoubleType())])
HOLIDAYS = T.StructType(_text("Date", "Name", "Type", "Country Name", "Country Code"))
HOLIDAY_EXPORT = T.StructType([
    T.StructField("timestamp", T.DateType()),
    *_text("Name", "Type", "Country Name", "Country Code"),
    T.StructField("is_holiday", T.IntegerType())])
UPLOAD = T.StructType(_text("sku", "timestamp", "target", "disc"))
STORE_COUNT = T.StructType([
    T.StructField("year", T.IntegerType()), T.StructField("month", T.IntegerType()),
    T.StructField("stores", T.DoubleType())])
FEEDBACK = T.StructType([
    T.StructField("timestamp", T.TimestampType()), *_text("selected_sku", "feedback", "horizon", "channel"),
    T.StructField("total_forecasted_demand", T.DoubleType()),
    T.StructField("safety_stock", T.IntegerType()), T.StructField("reorder_point", T.IntegerType()),
    T.StructField("eoq", T.IntegerType())])
LINE_ITEM = T.StructType([
    T.StructField("sku", T.StringType()), T.StructField("quantity", T.DoubleType()),
    T.StructField("price", T.DoubleType()),
    T.StructField("discount_allocations", T.ArrayType(
        T.StructType([T.StructField("amount", T.DoubleType())])))])
ORDERS = T.StructType([
    *_text("source_name", "name"), T.StructField("created_at", T.DateType()),
    T.StructField("total_price", T.DoubleType()), T.StructField("location_id", T.IntegerType()),
    T.StructField("billing_address", T.StructType(_text("province"))),
    *_text("email", "tags"), T.StructField("line_items", T.ArrayType(LINE_ITEM))])
