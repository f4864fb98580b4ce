"""Writing results: overwrite, append, upsert, exports and reports."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def overwrite(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows without a replacement, plus all new rows. Write it to a new snapshot path."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def export_json(tables: dict[str, DataFrame], path: str) -> None:
    """One folder of bzip2 JSON parts per table, dates and timestamps as ISO text."""
    for name, df in tables.items():
        (df.write.mode("overwrite").option("compression", "bzip2")
         .option("dateFormat", "yyyy-MM-dd").option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss")
         .json(f"{path}/{name}"))


def report(df: DataFrame, order: list[str], digits: int = 2) -> DataFrame:
    """Sorted rows with every floating number rounded half to even."""
    floats = {f.name: F.bround(f.name, digits) for f in df.schema.fields
              if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.withColumns(floats).orderBy(*order) if floats else df.orderBy(*order)


def write_report(df: DataFrame, path: str, order: list[str]) -> None:
    """The sorted report as CSV parts; part names follow the sort order."""
    report(df, order).write.mode("overwrite").csv(path, header=True)
