"""Scans by a short list, JSON files of lists, and queries over written lines."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

import catalog
from catalog import views
from larder import schemas
from larder.operators import profile
from larder.session import shared_dir
from larder.sources import files, tables


@pytest.fixture
def lines(spark, tmp_path):
    """A folder of 600 lines over 7 parts and 30 days; some figures are null, and some lines have no part."""
    rows = [(i % 97, i % 9, i % 5, i % 7, float(i % 50 + 1), None if i % 11 == 0 else 900 + (i * 37 % 400) / 4, (i % 11) / 100,
             "ANR"[i % 3], "FO"[i % 2], dt.datetime(2000, 1, 1 + i % 30)) for i in range(600)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
                          "l_discount double, l_returnflag string, l_linestatus string, l_shipdate timestamp").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(k, f"KIND{k % 2}", f"Brand#{k + 11}") for k in range(7)],
                          "p_partkey long, p_type string, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    return str(tmp_path)


def test_scan_by_a_short_list_reaches_the_files(spark, tmp_path):
    path = str(tmp_path / "sales")
    spark.createDataFrame([("A1", 1), ("A1", 2), ("B2", 3), (None, 4), ("C3_x", 5)], "sku string, qty int").write.parquet(path)
    found = tables.scan_skus(tables.scan(spark, path), ["A1_online", "A1_store", "C3_x", "Z9"])
    assert sorted(r.qty for r in found.collect()) == [1, 2]
    plan = found._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PushedFilters: [In(sku" in plan
    assert tables.scan_skus(tables.scan(spark, path), []).count() == 0


def test_json_files_of_lists(spark, tmp_path):
    columns = schemas.SALES.fieldNames()
    records = [{c: f"{c} {i}" for c in columns} for i in range(5)]
    records[3] = {columns[0]: None, "unknown": [1, {"a": 2}]}
    for name, part in (("one", records[:3]), ("two", records[3:]), ("none", [])):
        (tmp_path / f"{name}.json").write_text(json.dumps(part, indent=1))
    got = tables.read_json_documents(spark, str(tmp_path), schemas.SALES)
    assert got.columns == columns
    want = [tuple(rec.get(c) for c in columns) for rec in records]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_exact_profile_counts_and_sorts_over_all_tasks(spark, lines):
    df = tables.scan(spark, f"{lines}/lineitem.parquet").select("*", F.lit(None).cast("double").alias("none"))
    columns = ["l_quantity", "l_extendedprice", "l_discount", "l_linenumber"]
    got = {r.column_name: r for r in profile.exact_profile(df, [*columns, "none"], {"low": 0.45, "high": 0.55}).collect()}
    assert sorted(got) == sorted(columns)
    for c in columns:
        want = df.agg(F.countDistinct(c), F.percentile(c, F.array(F.lit(0.45), F.lit(0.55)))).first()
        assert got[c].distinct == want[0] and [got[c].low, got[c].high] == pytest.approx(want[1])
    assert profile.exact_profile(df.where("false"), columns, {"low": 0.45}).count() == 0


def test_merged_profile_is_compared_without_whole_columns_in_a_task(spark, lines):
    out = catalog.QUERIES["table_profile_merged"](spark, lines)
    plan = out._jdf.queryExecution().analyzed().toString()
    assert "percentile(" not in plan and "count(distinct" not in plan
    got = {r.column_name: r for r in out.collect()}
    assert len(got) == 5 and all(r.distinct_near and r.median_near for r in got.values())
    sold = [i for i in range(600) if i % 9 < 7]  # lines that have a part
    assert got["list_price"].rows == len(sold) and got["list_price"].nulls == sum(i % 11 == 0 for i in sold) and got["qty"].nulls == 0


def test_imports_are_written_packed_and_read_back_whole(spark, lines):
    folder = shared_dir(spark)
    old = files.children(spark, folder)
    got = {(r.format, r.channel): (r.records, r.skus, r.qty_chars) for r in catalog.QUERIES["src_csv_json"](spark, lines).collect()}
    raw, want = views.raw(views.sales(spark, lines)).collect(), {}
    for c in {r.Channel for r in raw}:
        mine = [r for r in raw if r.Channel == c]
        want |= {(f, c): (len(mine), sum(r.sku is not None for r in mine), sum(len(r.qty or "") for r in mine))
                 for f in ("csv", "json", "json_tables")}
    assert got == want and len(want) == 3 * 7
    path, = (p for p in files.children(spark, folder) if p not in old and "/import-" in p)
    for name in ("csv", "json", "tables"):
        written = files.children(spark, f"{path}/{name}")
        assert written and all(p.endswith(".gz") for p in written)


def test_text_of_lines_in_enough_parts_is_stored_without_a_shuffle(spark, lines, tmp_path, monkeypatch):
    plans = []
    monkeypatch.setattr(views, "stage", lambda df, *a, **b: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or df)
    few = tmp_path / "few"
    for t in ("lineitem", "part"):
        tables.scan(spark, f"{lines}/{t}.parquet").coalesce(1).write.parquet(f"{few}/{t}.parquet")
    assert tables.scan(spark, f"{lines}/lineitem.parquet").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    wide, narrow = (sorted(map(repr, views.raw_sales(spark, d).collect())) for d in (lines, str(few)))
    assert wide == narrow
    assert ["Repartition" in p for p in plans] == [False, True]
