"""Hand-written edge rows and brute-force twins."""

import datetime as dt
import random
import statistics

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from larder import config
from larder.functions import calendar as cal
from larder.functions import cleaning as cl
from larder.operators import evaluate as ev
from larder.operators import features as ft
from larder.operators import forecast as fc
from larder.operators import grid, inventory, monitor, ordered, promo, regression, seasonal, segment
from larder.operators import sales as sl
from larder.plans import forecasting as plan
from larder.session import new_path, stage
from larder.sources import orders as od
from larder.sources import sinks, tables

D = dt.date


def values(df, c):
    return [row[c] for row in df.collect()]


# ---- cleaning -----------------------------------------------------------------------------

def test_numbers(spark):
    df = spark.createDataFrame([("1,234",), ("₹1,234.50",), ("12d",), ("",), (None,), (" 7 ",), ("-3",)], "t string")
    row = df.select(cl.comma_number("t").alias("c"), cl.strict_number("t").alias("s"), cl.number_or_null("t").alias("n"))
    assert values(row, "c") == [1234.0, 0.0, 0.0, 0.0, 0.0, 7.0, -3.0]
    assert values(row, "s") == [1234.0, 1234.5, 12.0, None, None, 7.0, -3.0]
    assert values(row, "n") == [None, None, None, None, None, 7.0, -3.0]


def test_dates(spark):
    df = spark.createDataFrame([("05/02/2000",), ("5/2/2000",), ("2000-02-05",), ("2000-02-05T10:00:00",),
                                ("31/02/2000",), ("2000",), ("x",), (None,)], "t string")
    assert values(df.select(cl.any_day("t").alias("d")), "d") == [D(2000, 2, 5)] * 4 + [None] * 4
    assert values(df.select(cl.day_first("t").alias("d")), "d")[2:4] == [None, None]


def test_item_keys_and_lookups(spark):
    df = spark.createDataFrame([("A_B1", "Web"), ("x9", None)], "sku string, channel string")
    rows = df.select(cl.item_id().alias("i")).select("i", cl.sku_of("i").alias("s"), cl.channel_of("i").alias("c")).collect()
    assert tuple(rows[0]) == ("A_B1_Web", "A_B1", "Web")
    assert tuple(rows[1]) == ("x9_Unknown", "x9", "Unknown")
    odd = spark.createDataFrame([("N1",), (None,)], "i string").select(cl.sku_of("i"), cl.channel_of("i")).collect()
    assert [tuple(r) for r in odd] == [("N1", "Unknown"), (None, None)]
    none = spark.createDataFrame([(None, "Web")], "sku string, channel string").select(cl.item_id().alias("i"))
    assert none.first()["i"] is None
    assert values(df.select(cl.sku_category().alias("k")), "k") == ["A", None]
    assert values(df.select(cl.warehouse_of().alias("w")), "w") == ["central_online_wh", "unknown_wh"]


def test_wallet_price(spark):
    df = spark.createDataFrame([
        ("app_wallet_used,app_wallet_used_amount_50,COD + Wallet", 100.0),
        ("app_wallet_used,COD + Wallet", 100.0), ("vip", 100.0), (None, 100.0)], "tags string, total_price double")
    assert values(df.select(cl.wallet_price().alias("p")), "p") == [150.0, None, 100.0, 100.0]


def test_order_and_sku_filters(spark):
    df = spark.createDataFrame([("a@x", "#1", "vip", "NCK1"), (None, "#2", "vip", "NCK2"), ("a@x", "Test", "vip", "NCK3"),
                                ("a@x", "#4", "WARRANTY", "NCK4"), ("a@x", "#5", "vip", "GW5"), ("a@x", "#6", "vip", "N+6")],
                               "email string, name string, tags string, sku string")
    assert values(df.where(cl.genuine_order() & cl.sellable_sku()), "sku") == ["NCK1"]


def test_units_round_half_to_even(spark):
    df = spark.createDataFrame([(2.5,), (3.5,), (-4.0,)], "x double")
    assert values(df.select(cl.units("x").alias("u")), "u") == [2, 4, 0]


def test_required_columns(spark):
    with pytest.raises(ValueError, match="disc"):
        tables.upload_rows(spark.createDataFrame([("a", "b", "c")], "sku string, timestamp string, target string"))


# ---- ordered operators against brute force, with one group holding most rows ---------------

@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(7)
    rows = [("hot" if rng.random() < 0.7 else f"k{rng.randrange(40)}", rng.choice([1.0, 2.0, 2.0, rng.random() * 9]), i)
            for i in range(6000)]
    # Small partitions must not be merged here: the hot group has to span several of them.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield rows, stage(spark.createDataFrame(rows, "k string, v double, i int").repartition(8), "skewed")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_running_totals(skewed):
    rows, df = skewed
    split = df.orderBy("k", "v", "i").withColumn("p", F.spark_partition_id())
    assert split.where("k = 'hot'").select("p").distinct().count() > 1
    got = {r["i"]: r for r in ordered.running_totals(
        df, [F.col("v"), F.col("i")], {"n": F.lit(1).cast("bigint"), "i2": F.col("i")}, ("k",)).collect()}
    for key in {r[0] for r in rows}:
        total = 0
        group = sorted((v, i) for k, v, i in rows if k == key)
        for pos, (_, i) in enumerate(group, 1):
            total += i
            assert (got[i]["cum_n"], got[i]["total_n"], got[i]["cum_i2"]) == (pos, len(group), total)


def test_ranked_without_group(skewed):
    rows, df = skewed
    got = {r["i"]: r["position"] for r in ordered.ranked(df, [F.desc("v"), F.col("i")]).collect()}
    assert [i for _, _, i in sorted(rows, key=lambda r: (-r[1], r[2]))] == sorted(got, key=got.get)


def test_quantiles(skewed):
    rows, df = skewed
    got = {r["k"]: r for r in ordered.quantiles(df, "v", {"q1": 0.25, "q9": 0.9}, ("k",)).collect()}
    for key in {r[0] for r in rows}:
        group = [v for k, v, _ in rows if k == key]
        assert got[key]["q1"] == pytest.approx(np.quantile(group, 0.25))
        assert got[key]["q9"] == pytest.approx(np.quantile(group, 0.9))
    overall = ordered.quantiles(df, "v", {"m": 0.5}).collect()
    assert overall[0]["m"] == pytest.approx(statistics.median(v for _, v, _ in rows))


def test_newest(skewed):
    rows, df = skewed
    got = {r["k"]: r["i"] for r in ordered.newest(df, ["k"], [F.col("v"), F.col("i")]).collect()}
    for key, i in got.items():
        assert max((v, j) for k, v, j in rows if k == key)[1] == i


def test_feedback_window_against_brute_force(spark):
    rng = random.Random(3)
    start, texts = dt.datetime(2000, 1, 1), list(config.FEEDBACK_SCORES) + ["Other"]
    rows = [("EAR1" if rng.random() < 0.8 else "EAR2", "Web", start + dt.timedelta(hours=rng.randrange(24 * 90)),
             rng.choice(texts)) for _ in range(400)]
    df = spark.createDataFrame(rows, "selected_sku string, channel string, timestamp timestamp, feedback string")
    got = {(r["item_id"], r["at"]): r["feedback_score_30d_avg"] for r in ft.feedback_30d(df).collect()}
    epoch = dt.datetime(1970, 1, 1)
    for sku, ch, t, _ in rows:
        inside = [config.FEEDBACK_SCORES.get(f, 0.0) for s, _, u, f in rows
                  if s == sku and t - dt.timedelta(days=30) < u <= t]
        at = int((t - epoch).total_seconds() * 1_000_000)
        assert got[(f"{sku}_{ch}", at)] == pytest.approx(sum(inside) / len(inside))


# ---- grid and features --------------------------------------------------------------------

def panel_rows(spark):
    return spark.createDataFrame([("a", D(2000, 1, 2), 10.0), ("a", D(2000, 1, 5), 40.0), ("b", D(2000, 1, 1), 5.0),
                                  ("b", D(2000, 1, 7), 0.0)], "item_id string, ds date, y double")


def test_dense_panel_and_fills(spark):
    df = panel_rows(spark)
    span = grid.day_span(df)

    def series(method):
        out = grid.dense_panel(df, span=span, fills={"y": method} if method else None).where("item_id = 'a'")
        return values(out.orderBy("ds"), "y")

    assert grid.dense_panel(df, span=span).count() == 2 * 7
    assert series(None) == [None, 10, None, None, 40, None, None]
    assert series("zero") == [0, 10, 0, 0, 40, 0, 0]
    assert series("ffill") == [10, 10, 10, 10, 40, 40, 40]
    assert series("interpolate") == pytest.approx([None, 10, 20, 30, 40, 40, 40])
    assert series("interpolate_back") == pytest.approx([10, 10, 20, 30, 40, 40, 40])
    assert grid.dense_panel(df).where("item_id = 'a'").count() == 4


def test_duplicate_days_are_refused(spark):
    df = panel_rows(spark)
    with pytest.raises(Exception, match="(?i)sequence"):
        grid.dense_panel(df.unionByName(df)).collect()


def test_window_fills_agree_with_dense_fills(spark):
    df = panel_rows(spark)
    nulls = grid.dense_panel(df, span=grid.day_span(df))
    for method, dense in (("interpolate", "interpolate_back"), ("ffill", "ffill"), ("zero", "zero")):
        want = grid.dense_panel(df, span=grid.day_span(df), fills={"y": dense}).orderBy("item_id", "ds")
        got = grid.fill_gaps(nulls, "y", method).orderBy("item_id", "ds")
        assert values(got, "y") == pytest.approx(values(want, "y"))


def test_history_features_against_pandas(spark):
    rng = np.random.default_rng(1)
    days = pd.date_range("2000-01-01", periods=60)
    pdf = pd.DataFrame({"item_id": "a", "ds": days.date, "target": rng.integers(0, 5, 60).astype(float)})
    pdf.loc[rng.random(60) < 0.3, "target"] = np.nan
    pdf["warehouse_qty"] = rng.integers(0, 3, 60).astype(float)
    df = spark.createDataFrame([tuple(None if x != x else x for x in r) for r in pdf.itertuples(index=False)],
                               "item_id string, ds date, target double, warehouse_qty double")
    got = ft.history_features(df).orderBy("ds").toPandas()
    prev = pdf["target"].shift(1)
    for n in (7, 14, 30):
        assert np.allclose(got[f"sales_ma_{n}"], prev.rolling(n, min_periods=1).mean().fillna(0))
    for n in (7, 30):
        assert np.allclose(got[f"sales_std_{n}"], prev.rolling(n, min_periods=1).std().fillna(0))
    out = (pdf["warehouse_qty"] <= 0).astype(int)
    assert list(got["stockout_days_last_7"]) == list(out.shift(1).rolling(7, min_periods=1).sum().fillna(0).astype(int))
    last = pd.Series(days).where(pdf["target"] > 0).ffill()
    assert list(got["time_since_last_sale"]) == list((pd.Series(days) - last).dt.days.fillna(0).astype(int))


def test_panel_plan_has_one_exchange(spark):
    """The dense rows are produced and scanned by all windows behind one exchange by item."""
    df = stage(panel_rows(spark), "plan")
    span = (F.lit(D(2000, 1, 1)), F.lit(D(2000, 3, 1)))
    out = ft.history_features(grid.dense_panel(df.withColumnRenamed("y", "target").withColumn(
        "warehouse_qty", F.lit(1.0)), span=span)).withColumns(cal.calendar_features())
    text = out._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange") == 1
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_scan_pushes_filter_and_columns(spark):
    df = tables.scan(spark, "/root/testdata/sf0.001/lineitem.parquet").where("l_quantity > 40").select("l_partkey")
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_quantity,40.0)" in text
    assert "ReadSchema: struct<l_partkey:bigint,l_quantity:double>" in text


def test_price_change_after_zero_is_zero(spark):
    df = spark.createDataFrame([(D(2000, 1, 1), 0.0, 1.0), (D(2000, 1, 2), 5.0, 2.0)], "ds date, silver_price_inr double, gold_price_inr double")
    rows = ft.metal_features(df).orderBy("ds").collect()
    assert [r["silver_price_change"] for r in rows] == [0.0, 0.0]
    assert [r["gold_price_change"] for r in rows] == [0.0, 1.0]


# ---- classes, inventory, orders -----------------------------------------------------------

def test_abc_cuts_and_ties(spark):
    df = spark.createDataFrame([(f"s{i}", 10.0 if i < 4 else 1.0) for i in range(11)], "sku string, units double")
    got = {r["sku"]: r["class"] for r in segment.abc_by_volume(df).collect()}
    assert sorted(k for k, c in got.items() if c == "A") == ["s0", "s1"]
    assert sum(c == "B" for c in got.values()) == 3


def test_stock_metrics_invariants(spark):
    steps = [("x_Web", i, float(i % 5)) for i in range(1, 184)] + [("y_App", i, -1.0) for i in range(1, 184)]
    f = spark.createDataFrame(steps, "item_id string, step int, mean double")
    classes = spark.createDataFrame([("x", "A")], "sku string, class string")
    rows = inventory.inventory_metrics(inventory.forecast_by_horizon(f), classes).collect()
    assert len(rows) == 6
    for r in rows:
        assert r["reorder_point"] >= r["safety_stock"] >= 0 and r["eoq"] >= 10
    zero = [r for r in rows if r["sku"] == "y"]
    assert all(r["demand"] == 0 and r["eoq"] == 10 and r["class"] == "C" for r in zero)
    assert config.z_score(0.95) == pytest.approx(1.6448536)


def order_docs(spark):
    rows = [("web", "#1", D(2000, 1, 1), 100.0, 1, "vip", [("N1", 2.0, 50.0, [(5.0,), (7.0,)]), ("N2", 1.0, 0.0, [])]),
            ("5204949", "#2", D(2000, 1, 1), 200.0, 1, "app_wallet_used,app_wallet_used_amount_100,COD + Wallet", [("N1", 1.0, 200.0, [(10.0,), (1.0,)])]),
            ("pos", "#3", D(2000, 1, 1), 60.0, 1, "vip", [("N1", 3.0, 20.0, None)]),
            ("pos", "#4", D(2000, 1, 1), 60.0, 9, "vip", [("N1", 1.0, 20.0, [])])]
    schema = ("source_name string, name string, created_at date, total_price double, location_id int, tags string, "
              "line_items array<struct<sku:string,quantity:double,price:double,discount_allocations:array<struct<amount:double>>>>")
    return spark.createDataFrame(rows, schema).withColumn("email", F.lit("a@x"))


def test_sales_from_orders(spark):
    stores = spark.createDataFrame([(1, "Main")], "store_id int, store_name string")
    got = {(r["sku"], r["channel"]): (r["quantity"], r["revenue"]) for r in od.all_sales(order_docs(spark), stores).collect()}
    assert got == {("N1", "Web"): (2.0, 88.0), ("N1", "App"): (1.0, 290.0), ("N1", "Main"): (3.0, 60.0), ("N1", None): (1.0, 20.0)}


def test_upsert_and_versions(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("b", 3), ("c", 4)], "k string, v int")
    assert sorted(map(tuple, sinks.upserted(old, new, ["k"]).collect())) == [("a", 1), ("b", 3), ("c", 4)]
    runs = spark.createDataFrame([(f"r{i}", i) for i in range(8)], "run_id string, v int")
    assert sorted(values(monitor.retained_versions(runs), "run_id")) == [f"r{i}" for i in range(3, 8)]


def test_json_documents(spark):
    path = new_path(spark, "json")
    spark.createDataFrame([('{"a": [{"x": "1"}, {"x": "2"}], "b": []}',)], "value string").coalesce(1).write.text(path)
    from pyspark.sql import types as T
    out = tables.read_json_tables(spark, path, {"a": T.StructType([T.StructField("x", T.StringType())])})
    assert sorted(values(out["a"], "x")) == ["1", "2"]


def test_unit_price_median_fallbacks(spark):
    df = spark.createDataFrame([("a", 2.0, 10.0), ("a", 1.0, 9.0), ("a", 0.0, 3.0), ("b", 0.0, 1.0)], "sku string, qty double, revenue double")
    got = sorted((r["sku"], r["unit_price"]) for r in sl.unit_prices(df).collect())
    assert got == [("a", 5.0), ("a", 7.0), ("a", 9.0), ("b", 7.0)]


# ---- seasonality, promotions, monitoring --------------------------------------------------

@pytest.mark.parametrize("period", [7, 30])
def test_decomposition_adds_up(spark, period):
    days = pd.date_range("2000-01-01", periods=120)
    rows = [("a", d.date(), 10 + 0.1 * i + 3 * np.sin(2 * np.pi * i / period)) for i, d in enumerate(days)]
    df = spark.createDataFrame([(k, d, float(y)) for k, d, y in rows], "item_id string, ds date, y double")
    out = seasonal.decompose(df, period).toPandas()
    assert len(out) == 120 and not out.isna().any().any()
    assert np.allclose(out["trend"] + out["seasonal"] + out["resid"], out["y"])
    assert seasonal.strength(df, period).collect()[0]["seasonal_strength"] > 0.95


def test_short_and_zero_series_have_no_strength(spark):
    rows = [("short", D(2000, 1, 1) + dt.timedelta(days=i), 1.0 + i) for i in range(10)]
    rows += [("zero", D(2000, 1, 1) + dt.timedelta(days=i), 0.0) for i in range(60)]
    df = spark.createDataFrame(rows, "item_id string, ds date, y double")
    assert values(seasonal.strength(df, 7), "seasonal_strength") == [0.0, 0.0]
    lines = df.where("item_id = 'zero'").withColumnRenamed("y", "qty")
    filled = seasonal.filled_series(lines, model="multiplicative")
    assert values(seasonal.strength(filled, 7, "multiplicative"), "seasonal_strength") == [0.0]


def test_small_values_after_a_burst_keep_their_trend(spark):
    rows = [("a", D(2000, 1, 1) + dt.timedelta(days=i), 1e8 if i < 20 else 1e-6) for i in range(80)]
    df = spark.createDataFrame(rows, "item_id string, ds date, y double")
    out = seasonal.decompose(df, 7, "multiplicative").toPandas()
    assert np.allclose(out.sort_values("ds")["trend"].to_numpy()[30:70], 1e-6, rtol=1e-9)


def test_feedback_without_sku_is_dropped(spark):
    rows = [("s", "Web", "Good forecast"), (None, "Web", "Good forecast")]
    events = spark.createDataFrame(rows, "selected_sku string, channel string, feedback string").selectExpr(
        "*", "timestamp'2000-01-01' AS timestamp")
    assert values(ft.scored_feedback(events), "item_id") == ["s_Web"]


def test_mase_scale_sees_no_test_day(spark):
    days = [D(2000, 1, 1) + dt.timedelta(days=i) for i in range(40)]
    series = spark.createDataFrame([("a", d, float(i % 7 + 100 * (i >= 30))) for i, d in enumerate(days)],
                                   "item_id string, ds date, y double")
    scale = ev.naive_scale(series, windows=1, horizon=10).first()
    assert scale["window"] == 0 and scale["scale"] == 0


def test_growth_of_sku_without_sales(spark):
    sales = spark.createDataFrame([("a", D(2000, 1, 10), 4.0, 20.0, 80.0), ("a", D(2000, 1, 1), 2.0, 0.0, 50.0)],
                                  "sku string, ds date, qty double, disc double, revenue double")
    skus = spark.createDataFrame([("a",), ("none",)], "sku string")
    got = {r["sku"]: r for r in promo.sku_growth(sales, skus, D(2000, 1, 6), D(2000, 1, 10), 5).collect()}
    assert got["a"]["avg_daily_sales_before"] == pytest.approx(0.4) and got["a"]["growth_pct"] == pytest.approx(100)
    assert got["a"]["discount_roi_pct"] == pytest.approx(30 / 20 * 100)
    assert got["none"]["growth_pct"] == 0 and got["none"]["avg_discount"] is None


def test_clearing_the_flags_changes_the_score(spark):
    rows = [("a", D(2000, 1, 1) + dt.timedelta(days=i), 10.0 + 5 * (i % 10 == 0), int(i % 10 == 0)) for i in range(100)]
    rows += [("never", D(2000, 1, 1) + dt.timedelta(days=i), 3.0, 0) for i in range(50)]
    panel = spark.createDataFrame(rows, "item_id string, ds date, target double, is_on_promotion int")
    fitted = promo.flag_effects(panel)
    seen = {(r["item_id"], r["ds"]): r["forecast"] for r in promo.scored_by_flag(fitted).collect()}
    plain = {(r["item_id"], r["ds"]): r["forecast"] for r in promo.scored_by_flag(promo.without_promotion(fitted)).collect()}
    day = D(2000, 1, 1) + dt.timedelta(days=90)
    assert seen["a", day] - plain["a", day] == pytest.approx(5, abs=1.5)
    assert all(seen[k] == plain[k] for k in seen if k[0] == "never")


def test_compare_runs(spark):
    runs = spark.createDataFrame([
        ("r1", D(2000, 1, 1), 1.0, 5.0, "promote"), ("r2", D(2000, 2, 1), 0.9, 5.0, "promote"),
        ("r3", D(2000, 3, 1), 0.89, 5.0, "reject"), ("r4", D(2000, 4, 1), None, 4.0, "promote"),
        ("r5", D(2000, 5, 1), None, None, "promote")],
        "run_id string, trained_date date, mase double, rmse double, decision string")
    got = {r["run_id"]: r for r in monitor.compare_runs(runs, "threshold").collect()}
    assert [got[f"r{i}"]["new_decision"] for i in range(1, 6)] == ["promote", "promote", "reject", "promote", "promote"]
    assert got["r4"]["metric_name"] == "RMSE" and got["r4"]["champion_id"] == "r2"
    assert [got[f"r{i}"]["reason"] for i in range(1, 6)] == [
        "first_run", "better", "gain_below_threshold", "better", "no_common_metric"]
    assert got["r2"]["gain"] == pytest.approx(0.1) and got["r5"]["gain"] is None


def test_runs_of_one_date_follow_by_id(spark):
    runs = spark.createDataFrame([("b", D(2000, 1, 1), 0.5, "promote"), ("a", D(2000, 1, 1), 1.0, "promote"),
                                  ("c", D(2000, 1, 1), 2.0, "reject")],
                                 "run_id string, trained_date date, mase double, decision string").selectExpr(
        "*", "mase AS rmse", "mase AS mape")
    got = {r["run_id"]: r["champion_id"] for r in monitor.compare_runs(runs).collect()}
    assert got == {"a": "None", "b": "a", "c": "b"}
    assert monitor.latest_metrics(runs).first()["run_id"] == "c"
    assert monitor.champion_run(runs).first()["run_id"] == "b"


# ---- forecasts ----------------------------------------------------------------------------

def seasonal_sales(spark, days=800):
    rows = [(f"EAR{k}", "Web", D(2000, 1, 1) + dt.timedelta(days=i), float(20 + 10 * np.sin(2 * np.pi * i / 365.25) + k))
            for k in range(4) for i in range(days)]
    return spark.createDataFrame(rows, "sku string, channel string, ds date, qty double")


def test_models_beat_the_average_on_a_yearly_wave(spark):
    sales = seasonal_sales(spark, 1100)
    cut = D(2000, 1, 1) + dt.timedelta(days=900)
    series = stage(plan.item_series(sales).withColumns({"is_holiday": F.lit(0), "is_on_promotion": F.lit(0)}), "wave")
    past, actual = series.where(F.col("ds") < cut), series.where(F.col("ds") >= cut)
    future = grid.future_days(past.select("item_id").distinct(), F.lit(D(2000, 1, 1) + dt.timedelta(days=899)), 183).withColumns(
        {"is_holiday": F.lit(0), "is_on_promotion": F.lit(0)})
    forecasts = fc.sma(past).unionByName(regression.forecast(past, future)).unionByName(fc.gbt(past, future))
    scored = forecasts.join(actual.select("item_id", "ds", "y"), ["item_id", "ds"]).withColumnRenamed("mean", "yhat")
    mae = {r["model"]: r["mae"] for r in ev.metrics(scored, ("model",)).collect()}
    assert forecasts.where("mean IS NULL").count() == 0
    assert mae["Harmonic"] < 0.5 * mae["SMA"] and mae["GBT"] < mae["SMA"]


def test_fitted_models_win_the_contest_on_a_yearly_wave(spark):
    sales = seasonal_sales(spark, 1100)
    series = plan.item_series(sales).withColumns({"is_holiday": F.lit(0), "is_on_promotion": F.lit(0)})
    series, scored = plan.backtested(series, fitted=True, windows=1)
    board = ev.leaderboard(plan.model_errors(series, scored)).collect()
    assert {r["model"] for r in board} == {"SMA", "SeasonalNaive", "Harmonic", "GBT"}
    assert min(board, key=lambda r: r["rank"])["model"] in ("Harmonic", "GBT")
    assert {r["best_model"] for r in ev.champions(ev.metrics(scored)).collect()} <= {"Harmonic", "GBT"}


def test_tails_of_sparse_and_dense_agree(spark):
    sales = seasonal_sales(spark, 40).where("day(ds) <> 3")
    a = fc.seasonal_naive(plan.item_lines(sales)).orderBy("item_id", "step").collect()
    b = fc.seasonal_naive(plan.item_series(sales)).orderBy("item_id", "step").collect()
    assert a == b and len(a) == 4 * 183


def test_weights_and_champions(spark):
    m = spark.createDataFrame([("a", "m1", 10.0), ("a", "m2", 40.0), ("b", "m1", 60.0), ("b", "m2", 40.0), ("c", "m1", None), ("c", "m2", 70.0)],
                              "item_id string, model string, wape double")
    w = {(r["item_id"], r["model"]): r["weight"] for r in fc.ensemble_weights(m).collect()}
    assert w[("a", "m1")] == pytest.approx(0.8) and w[("a", "m1")] + w[("a", "m2")] == pytest.approx(1)
    got = {r["item_id"]: r["champion"] for r in ev.champions(m).collect()}
    assert got == {"a": "Ensemble", "b": "m2", "c": "m2"}


def test_metrics_of_zero_actuals(spark):
    df = spark.createDataFrame([("m", "a", 0.0, 1.0), ("m", "a", 0.0, 3.0)], "model string, item_id string, y double, yhat double")
    r = ev.metrics(df).collect()[0]
    assert (r["wape"], r["mape"], r["mae"], r["r2"]) == (0.0, 0.0, 2.0, None)


def test_short_uploads_name_their_reason(spark):
    raw = spark.createDataFrame([("A1", "2025-07-04", "4", "0"), ("A1", "05/07/2025", "6", "10"), ("A1", "x", "1", "0")],
                                "sku string, timestamp string, target string, disc string")
    from larder.plans import prepare
    holidays = spark.createDataFrame([("2025-07-05T00:00:00",)], "Date string")
    panel = prepare.prepare_upload(tables.upload_rows(raw), holidays)
    assert sorted(values(panel, "is_holiday")) == [0, 1]
    rows = plan.upload_forecast(panel).collect()
    assert len(rows) == 183 and rows[0]["units"] == 5
    assert "2 points" in rows[0]["backtest_skipped"]


def test_demand_clusters_need_enough_skus(spark):
    df = spark.createDataFrame([("a", 0.1, 0.2)], "sku string, w0 double, w1 double")
    assert values(segment.demand_clusters(df, 2), "cluster") == [-1]
