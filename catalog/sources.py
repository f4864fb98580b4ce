"""Sources, sinks and versions."""

import datetime as dt

from pyspark.sql import functions as F

from catalog import views as v
from catalog.base import query, r, rounded
from larder import schemas
from larder.operators import monitor, profile
from larder.plans import forecasting as plan
from larder.session import freed_shuffles, new_path, stage
from larder.sources import orders as od
from larder.sources import sinks, snapshots, tables


@query("src_scan", v.sql("SELECT * EXCLUDE (l_shipdate), CAST(l_shipdate AS DATE) AS l_shipdate FROM lineitem"))
def src_scan(spark, sf):
    df = tables.scan(spark, f"{sf}/lineitem.parquet")
    return df.withColumn("l_shipdate", F.col("l_shipdate").cast("date"))


@query("src_scan_in", v.sql(
    "SELECT sku, ds, qty FROM family WHERE sku IN (SELECT split_part(item_id, '_', 1) "
    "FROM training_status WHERE last_trained >= DATE '2001-11-01')"))
def src_scan_in(spark, sf):
    items = v.training_status(spark, sf).where(F.col("last_trained") >= "2001-11-01")
    return tables.scan_items(v.family(spark, sf), items).select("sku", "ds", "qty")


@query("src_scan_project", v.sql("SELECT sku, revenue, disc, qty FROM sales"))
def src_scan_project(spark, sf):
    return v.sales(spark, sf).select("sku", "revenue", "disc", "qty")


@query("src_csv_json", v.sql(
    "SELECT f AS format, channel_text AS channel, count(*) AS records, count(sku) AS skus, "
    "CAST(sum(length(qty)) AS BIGINT) AS qty_chars FROM raw_sales, (VALUES ('csv'), ('json'), ('json_tables')) t(f) "
    "GROUP BY 1, 2"))
def src_csv_json(spark, sf):
    """Raw sales written as CSV, JSON lines and JSON objects of lists, then read back typed.

    Plain text takes many times the room of the stored lines, so it is written by gzip; a file, which one task reads,
    has a million records at most.
    """
    raw, path = v.raw_sales(spark, sf), new_path(spark, "import")
    packed = {"compression": "gzip", "maxRecordsPerFile": 1_000_000}
    raw.write.options(**packed).csv(f"{path}/csv", header=True, quote='"', escape='"',
                                    ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    raw.write.options(**packed).json(f"{path}/json")
    raw.select(F.array(F.struct(*raw.columns)).alias("sales")).write.options(**packed).json(f"{path}/tables")
    parts = {
        "csv": tables.read_csv(spark, f"{path}/csv", schemas.SALES),
        "json": tables.read_json(spark, f"{path}/json", schemas.SALES),
        "json_tables": tables.read_json_tables(
            spark, f"{path}/tables", {"sales": schemas.SALES}, multi_line=False)["sales"],
    }
    counted = [d.groupBy(F.lit(n).alias("format"), F.col("Channel").alias("channel")).agg(
        F.count(F.lit(1)).alias("records"), F.count("sku").alias("skus"),
        F.sum(F.length("qty")).alias("qty_chars")) for n, d in parts.items()]
    return counted[0].unionByName(counted[1]).unionByName(counted[2])


@query("src_holiday_csv", v.sql(
    "SELECT ds, name, len(regexp_extract_all(kind, '''([^'']*)''', 1)) AS types FROM holidays"))
def src_holiday_csv(spark, sf):
    path = new_path(spark, "holidays")
    h = v.holidays(spark, sf)
    (h.select(F.split_part("Date", F.lit("T"), F.lit(1)).alias("timestamp"), "Name", "Type",
              "Country Name", "Country Code", F.lit(1).alias("is_holiday"))
     .write.csv(path, header=True, quote='"', escape='"'))
    return tables.read_holidays(spark, path).select(
        "ds", F.col("Name").alias("name"), F.size("types").cast("bigint").alias("types"))


_UPLOAD = """SELECT CASE WHEN sku IS NULL THEN 'missing sku' WHEN day IS NULL THEN 'bad date'
  WHEN target IS NULL THEN 'bad target' ELSE 'ok' END AS verdict, count(*) AS records, sum(target) AS units
 FROM (SELECT sku, """ + v._DAY + """ AS day, TRY_CAST(qty AS DOUBLE) AS target FROM raw_family) GROUP BY 1"""


@query("src_upload_validate", v.sql(_UPLOAD))
def src_upload_validate(spark, sf):
    raw = v.raw_family(spark, sf).select(
        "sku", F.col("created_at").alias("timestamp"), F.col("qty").alias("target"), "disc")
    return tables.upload_rows(raw).groupBy(F.coalesce("reject", F.lit("ok")).alias("verdict")).agg(
        F.count(F.lit(1)).alias("records"), F.sum("target").alias("units"))


@query("src_nested_orders", v.sql(
    "SELECT source_name, count(*) AS documents, count(*) * 3 AS lines FROM order_lines "
    "WHERE order_day BETWEEN DATE '1997-01-01' AND DATE '2000-12-31' GROUP BY 1"))
def src_nested_orders(spark, sf):
    """A date-bounded scan of order documents stored as nested Parquet by day."""
    path = new_path(spark, "orders")
    v.orders_nested(spark, sf).write.parquet(path)
    docs = od.order_scan(tables.scan(spark, path, schemas.ORDERS), dt.date(1997, 1, 1), dt.date(2000, 12, 31))
    return docs.groupBy("source_name").agg(
        F.count(F.lit(1)).alias("documents"), F.sum(F.size("line_items")).alias("lines"))


_TOTALS = "SELECT sku, channel, sum(qty) AS units FROM sales {w} GROUP BY 1, 2"


@query("sink_overwrite", v.sql(_TOTALS.format(w="WHERE status = 'O'")))
def sink_overwrite(spark, sf):
    """The second write replaces the first."""
    path, s = new_path(spark, "overwrite"), v.sales(spark, sf)
    for status in ("F", "O"):
        sinks.overwrite(s.where(F.col("status") == status).groupBy("sku", "channel").agg(
            F.sum("qty").alias("units")), path)
    return spark.read.parquet(path)


@query("sink_append", v.sql("SELECT selected_sku, channel, feedback, count(*) AS records FROM feedback GROUP BY ALL"))
def sink_append(spark, sf):
    path, f = new_path(spark, "append"), v.feedback(spark, sf)
    for bad in (True, False):
        sinks.append(f.where((F.col("feedback") == "Other") == bad), path)
    return spark.read.schema(f.schema).parquet(path).groupBy("selected_sku", "channel", "feedback").agg(
        F.count(F.lit(1)).alias("records"))


@query("sink_upsert", v.sql(
    "SELECT coalesce(n.sku, o.sku) AS sku_id, coalesce(n.units, o.units) AS units, "
    "CASE WHEN n.sku IS NULL THEN 'old' ELSE 'new' END AS origin "
    "FROM (SELECT sku, sum(qty) AS units FROM sales WHERE status = 'F' GROUP BY 1) o "
    "FULL JOIN (SELECT sku, sum(qty) AS units FROM sales WHERE status = 'O' GROUP BY 1) n USING (sku)"))
def sink_upsert(spark, sf):
    s = v.sales(spark, sf)

    def totals(cond, origin):
        return s.where(cond).groupBy(F.col("sku").alias("sku_id")).agg(
            F.sum("qty").alias("units")).withColumn("origin", F.lit(origin))

    path = new_path(spark, "upsert")
    old = totals(F.col("status") == "F", "old")
    snapshots.create(spark, path, old.schema, ["sku_id"], 16)
    snapshots.upsert(path, old)
    snapshots.upsert(path, totals(F.col("status") == "O", "new"))
    return snapshots.read(spark, path)


@query("sink_compressed_export", v.sql(
    "SELECT * FROM (SELECT 'sales' AS table_name, count(*) AS records, max(CAST(ds AS VARCHAR)) AS newest FROM sales "
    "UNION ALL SELECT 'training_status', count(*), max(CAST(last_trained AS VARCHAR)) FROM training_status)"))
def sink_compressed_export(spark, sf):
    path = new_path(spark, "export")
    sinks.export_json({"sales": v.sales(spark, sf), "training_status": v.training_status(spark, sf)}, path)
    out = []
    for name, c in (("sales", "ds"), ("training_status", "last_trained")):
        back = spark.read.schema(f"{c} string").json(f"{path}/{name}")
        out.append(back.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("records"),
                            F.max(c).alias("newest")))
    return out[0].unionByName(out[1])


@query("sink_csv_report", v.sql("SELECT * FROM recommendations"))
def sink_csv_report(spark, sf):
    path, table = new_path(spark, "report"), plan.recommend(v.family(spark, sf))
    sinks.write_report(table, path, ["item_id", "forecast_days", "channel"])
    return tables.read_csv(spark, path, table.schema)


@query("version_latest", v.sql("SELECT * FROM versions WHERE run_id = (SELECT max(run_id) FROM versions)"))
def version_latest(spark, sf):
    path = new_path(spark, "versions")
    sinks.overwrite(v.versions(spark, sf), path, ("run_id",))
    return monitor.latest_version(spark.read.parquet(path))


@query("version_retain", v.sql(
    "SELECT * FROM versions WHERE run_id IN (SELECT DISTINCT run_id FROM versions ORDER BY run_id DESC LIMIT 5)"))
def version_retain(spark, sf):
    return monitor.retained_versions(v.versions(spark, sf))


_PROFILED = ("qty", "disc", "revenue", "disc_amt", "list_price")


_PROFILE_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) AS rows, count(*) - count({c}) AS nulls, min({c}) AS min, max({c}) AS max, "
    + r(3, mean=f"avg({c})", std=f"stddev_samp({c})", corr_target=f"corr({c}, qty)") + " FROM sales" for c in _PROFILED)


@query("table_profile", v.sql(_PROFILE_SQL))
def table_profile(spark, sf):
    out = profile.profile(v.sales(spark, sf), list(_PROFILED), "qty")
    return rounded(out.drop("distinct_approx", "median_approx"), 3, "mean", "std", "corr_target")


@query("table_profile_merged", v.sql(f"SELECT *, true AS distinct_near, true AS median_near FROM ({_PROFILE_SQL})"))
def table_profile_merged(spark, sf):
    """The profile from stored rows per day; its estimates are compared with the exact figures of the table."""
    path = new_path(spark, "profile-days")
    with freed_shuffles(spark):
        sales = stage(v.sales(spark, sf).select("ds", *_PROFILED), "profiled")
        profile.daily_profile(sales, list(_PROFILED), "qty").write.parquet(path)
        out = profile.merged_profile(spark.read.parquet(path))
        exact = profile.exact_profile(sales, list(_PROFILED), {"low": 0.45, "high": 0.55})
    d = F.coalesce("distinct", F.lit(0))
    both = out.join(exact, "column_name", "left").withColumns({
        "distinct_near": F.abs(F.col("distinct_approx") - d) <= 0.06 * d + 1,
        "median_near": F.col("median_approx").between(F.col("low"), F.col("high"))})
    return rounded(both.drop("distinct_approx", "median_approx", "distinct", "low", "high"), 3, "mean", "std", "corr_target")
