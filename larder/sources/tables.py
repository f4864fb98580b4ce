"""Reading tables, imports and uploads."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder import config, schemas
from larder.functions import cleaning as cl


def scan(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A Parquet table with its declared schema; filters and columns reach the scan."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(path)


def scan_skus(df: DataFrame, item_ids: list[str], sku: str = "sku") -> DataFrame:
    """Rows of a short list of SKUs or item ids; the SKU is the text before the first ``_``."""
    return df.where(F.col(sku).isin(sorted({i.split("_")[0] for i in item_ids})))


def scan_items(df: DataFrame, items: DataFrame, sku: str = "sku") -> DataFrame:
    """The same for a list of any length held in a table (``item_id``): a semi join."""
    keys = items.select(F.substring_index("item_id", "_", 1).alias(sku))
    return df.join(keys, sku, "left_semi")


def require(df: DataFrame, columns) -> DataFrame:
    """Fail before any job runs when a column is missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True, quote='"', escape='"')


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines, or files holding one list of records (use ``read_json_documents``)."""
    return spark.read.schema(schema).json(path)


def read_json_documents(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Files that each hold a JSON list of records."""
    return spark.read.schema(schema).json(path, multiLine=True)


def read_json_tables(spark: SparkSession, path: str, tables: dict[str, T.StructType],
                     multi_line: bool = True) -> dict[str, DataFrame]:
    """Objects of table name to list of records, one per file or one per line: a table per name."""
    whole = T.StructType([T.StructField(n, T.ArrayType(s)) for n, s in tables.items()])
    docs = spark.read.schema(whole).json(path, multiLine=multi_line)
    return {n: docs.select(F.inline(n)) for n in tables}


def read_holidays(spark: SparkSession, path: str) -> DataFrame:
    """The exported holiday dimension with its date parsed and its type list split."""
    df = read_csv(spark, path, schemas.HOLIDAY_EXPORT)
    names = F.regexp_extract_all("Type", F.lit(r"'([^']*)'"), F.lit(1))
    return df.withColumnRenamed("timestamp", "ds").withColumn("types", names)


def upload_rows(raw: DataFrame) -> DataFrame:
    """Typed upload rows with a ``reject`` reason, null for good rows."""
    require(raw, config.UPLOAD_COLUMNS)
    typed = raw.select(
        "sku", cl.any_day("timestamp").alias("ds"), cl.number_or_null("target").alias("target"),
        cl.number_or_null("disc").alias("disc"))
    reject = (F.when(F.col("sku").isNull(), "missing sku").when(F.col("ds").isNull(), "bad date")
              .when(F.col("target").isNull(), "bad target").when(F.col("disc").isNull(), "bad disc"))
    return typed.withColumn("reject", reject)
