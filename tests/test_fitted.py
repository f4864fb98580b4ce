"""The fitted models: sums of blocks against direct fits, the search of the trees, and the contests that use them."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalog import forecasting
from larder.operators import forecast as fc
from larder.operators import profile, promo, sales
from larder.operators import regression as rg
from larder.plans import forecasting as plan
from larder.schemas import ORDERS
from larder.session import stage
from larder.sources import orders

START, HORIZON = dt.date(2000, 1, 1), 30


def noisy_series(spark, items=3, days=400, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(items):
        for i in range(days - 40 * k):
            flag, share = int(rng.random() < 0.1), float(rng.random() * 0.3)
            y = max(0.0, 10 + 0.02 * i + 4 * np.sin(2 * np.pi * i / 365.25) + 3 * flag + 9 * share + rng.normal())
            rows.append((f"i{k}", START + dt.timedelta(days=days - 1 - i), float(y), flag, share))
    return spark.createDataFrame(rows, "item_id string, ds date, y double, is_holiday int, discount_percentage double")


DESIGN = rg.Design(waves=((365.25, 4), (7.0, 3)), regressors=("is_holiday", "discount_percentage"))


def direct(pdf, ahead, last, ridge=1.0):
    """One fit on the days of ``pdf``, by the normal equations of its whole matrix."""
    def x(p):
        day = np.array([(d - last).days for d in p["ds"]], float)
        return DESIGN.matrix(day, [p["is_holiday"].to_numpy(float), p["discount_percentage"].to_numpy(float)])
    penalty = np.full(DESIGN.width, ridge)
    penalty[:2] = 1e-8
    a = x(pdf)
    coef = np.linalg.solve(a.T @ a + np.diag(penalty), a.T @ pdf["y"].to_numpy(float))
    return np.maximum(x(ahead) @ coef, 0)


def test_windows_of_one_pass_equal_direct_fits(spark):
    series = stage(noisy_series(spark).repartition(5), "noisy")
    got = rg.backtest(series, 3, HORIZON, DESIGN).toPandas()
    rows = series.toPandas()
    last = rows["ds"].max()
    n = 0
    for item, own in rows.groupby("item_id"):
        for window in range(3):
            cutoff = last - dt.timedelta(days=(window + 1) * HORIZON)
            test = own[(own["ds"] > cutoff) & (own["ds"] <= cutoff + dt.timedelta(days=HORIZON))].sort_values("ds")
            mine = got[(got["item_id"] == item) & (got["window"] == window)].sort_values("ds")
            assert mine["ds"].tolist() == test["ds"].tolist()
            assert mine["step"].tolist() == [(d - cutoff).days for d in test["ds"]]
            np.testing.assert_allclose(mine["yhat"], direct(own[own["ds"] <= cutoff], test, last), atol=1e-8)
            n += len(mine)
    assert n == len(got) == 3 * 3 * HORIZON


def test_final_fit_and_item_without_history(spark):
    series = stage(noisy_series(spark), "noisy")
    last = series.agg(F.max("ds")).first()[0]
    future = spark.createDataFrame([(i, k, last + dt.timedelta(days=k), 0, 0.1) for i in ("i0", "new", None) for k in range(1, 10)],
                                   "item_id string, step int, ds date, is_holiday int, discount_percentage double")
    got = rg.forecast(series, future, DESIGN).toPandas().sort_values("step")
    assert set(got["item_id"]) == {"i0"} and set(got["model"]) == {"Harmonic"}
    own = series.where("item_id = 'i0'").toPandas()
    np.testing.assert_allclose(got["mean"], direct(own, future.where("item_id = 'i0'").toPandas(), last), atol=1e-8)
    assert rg.forecast(series.limit(0), future, DESIGN).collect() == []


def test_history_is_neither_multiplied_nor_shuffled(spark):
    series = stage(noisy_series(spark), "noisy")
    plan = rg.fitted(series, DESIGN, 5, HORIZON, F.lit(START + dt.timedelta(days=399)))._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and plan.count("Exchange") == 1 and plan.count("FileScan") == 1


def test_regressors_are_learnt(spark):
    series = stage(noisy_series(spark, days=1200), "noisy")
    coef = np.array(rg.fitted(series, DESIGN).where("item_id = 'i0' AND block = -1").first()["coef"])
    assert coef[-2] == pytest.approx(3, abs=0.5) and coef[-1] == pytest.approx(9, abs=1)


def test_search_keeps_the_order_of_time(spark):
    series = noisy_series(spark, days=300).withColumn("is_on_promotion", F.lit(0))
    rows = stage(fc.gbt_training_rows(series, HORIZON), "rows")
    trials = fc.search_gbt(rows, ((2, 0.3), (3, 0.3)), 25, HORIZON)
    assert len(trials) == 2 and trials[0].rmse <= trials[1].rmse
    assert all(1 <= t.settings.rounds <= 25 for t in trials)
    assert fc.fit_gbt(rows, trials[0].settings).getNumTrees == trials[0].settings.rounds
    late = rows.where(F.col("ds") > F.date_sub(rows.agg(F.max("ds")).scalar(), HORIZON))
    changed = rows.withColumn("y", F.when(F.col("ds") > F.date_sub(rows.agg(F.max("ds")).scalar(), HORIZON), 0.0).otherwise(F.col("y")))
    assert late.count() and fc.search_gbt(changed, ((2, 0.3),), 25, HORIZON)[0].rmse != trials[0].rmse
    assert fc.search_gbt(late, ((2, 0.3),), 25, HORIZON)[0].rmse == float("inf")


@pytest.fixture()
def small_catalog(spark, monkeypatch):
    series = stage(noisy_series(spark, items=2, days=1300).withColumn("is_on_promotion", F.lit(0)), "small")
    monkeypatch.setattr(forecasting, "flagged_series", lambda *_: series)
    last = series.agg(F.max("ds")).first()[0]
    future = spark.createDataFrame([(f"i{k}", s, last + dt.timedelta(days=s)) for k in range(2) for s in range(1, 184)],
                                   "item_id string, step int, ds date")
    monkeypatch.setattr(forecasting, "item_future", lambda *_: future)


def test_contests_with_fitted_models(spark, small_catalog):
    board = forecasting.leaderboard_fitted(spark, "").collect()
    assert sorted(r.model for r in board) == ["GBT", "Harmonic", "SMA", "SeasonalNaive"]
    assert {r["items"] for r in board} == {2}
    assert min(board, key=lambda r: r["rank"])["model"] in ("Harmonic", "GBT")
    champions = forecasting.champion_fitted(spark, "").collect()
    assert sorted(r.item_id for r in champions) == ["i0", "i1"] and {r.days for r in champions} == {183}


def planted(spark, effect, days=700, items=3):
    """Wavy demand with a promotion every sixth week, which adds ``effect`` units a day."""
    rng = np.random.default_rng(11)
    rows = []
    for k in range(items):
        for i in range(days):
            flag = int((i // 7 + k) % 6 == 0)
            rows.append((f"i{k}", START + dt.timedelta(days=i), float(30 + 5 * np.sin(2 * np.pi * i / 365.25) + effect * flag + rng.normal()), flag, 0))
    return stage(spark.createDataFrame(rows, "item_id string, ds date, target double, is_on_promotion int, is_high_discount int"), "planted")


@pytest.mark.parametrize("effect", [0.0, 12.0])
def test_lift_of_a_planted_promotion(spark, effect):
    panel = planted(spark, effect)
    for r in promo.lift_cross_fitted(panel, lookback=700).collect():
        promoted = panel.where(f"item_id = '{r.item_id}' AND is_on_promotion = 1").count()
        assert r.total_lift_units / promoted == pytest.approx(effect, abs=max(0.1 * effect, 0.4))


def test_no_day_is_judged_by_a_fit_that_saw_it(spark):
    panel = planted(spark, 5.0, 210, 1)
    changed = panel.withColumn("target", F.when(F.col("ds") == START + dt.timedelta(days=209), 9999.0).otherwise(F.col("target")))
    a, b = ({r.ds: r.forecast_no_promo for r in promo.cross_fitted_baseline(p).collect()} for p in (panel, changed))
    same_fold = [d for d in a if ((START + dt.timedelta(days=209) - d).days // 7) % 5 == 0]
    assert len(same_fold) >= 40 and all(a[d] == pytest.approx(b[d], abs=1e-9) for d in same_fold)
    assert any(abs(a[d] - b[d]) > 1 for d in a if d not in same_fold)


def test_quantiles_follow_the_items_size(spark):
    rng = np.random.default_rng(4)
    rows = [("m", f"i{k}", w, s, START, float(10 ** k * max(0, 5 + rng.normal())), 5.0 * 10 ** k)
            for k in range(3) for w in range(4) for s in range(1, 61)] + [("m", "zero", 1, 1, START, 0.0, 0.0)]
    scored = stage(spark.createDataFrame(rows, "model string, item_id string, window int, step int, ds date, y double, yhat double"), "scored")
    scales = fc.item_scales(scored)
    ahead = scored.where("window = 0").drop("y").withColumnRenamed("yhat", "mean").unionByName(
        scored.where("item_id = 'zero'").drop("y").withColumnRenamed("yhat", "mean"))
    out = fc.with_intervals(ahead, fc.residual_quantiles(scored, scales), scales).toPandas()
    assert (out[["q10", "q25", "q50", "q75", "q90"]].diff(axis=1).iloc[:, 1:] >= 0).all().all() and (out["q10"] >= 0).all()
    width = out.assign(w=out["q90"] - out["q10"]).groupby("item_id")["w"].mean()
    assert width["i1"] / width["i0"] == pytest.approx(10, rel=0.3) and width["zero"] == 0
    cover = {(r.level): (r.below, r.at_or_below) for r in fc.interval_coverage(scored.where("item_id <> 'zero'")).collect()}
    assert all(lo - 0.08 <= p <= hi + 0.08 for p, (lo, hi) in cover.items())


def test_skus_add_up_to_the_champion_of_their_category(spark):
    rng = np.random.default_rng(6)
    rows = [(f"{c}{k}", START + dt.timedelta(days=i), float(rng.integers(1, 9)))
            for c in ("EAR", "RNG") for k in range(3) for i in range(400)] + [("EAR9", START, 5.0), ("x1", START, 5.0)]
    sales = stage(spark.createDataFrame(rows, "sku string, ds date, qty double"), "category-sales")
    level = plan.category_level(sales, windows=1)
    parts = plan.category_forecast(sales, level)
    whole = {(r.category, r.step): r["mean"] for r in level.collect()}
    sums = {(r.category, r.step): r["total"] for r in parts.groupBy("category", "step").agg(F.sum("mean").alias("total")).collect()}
    assert whole.keys() == sums.keys() and len(whole) == 2 * 183
    assert all(sums[k] == pytest.approx(whole[k]) for k in whole)
    assert {r.sku for r in parts.select("sku").distinct().collect()} == {f"{c}{k}" for c in ("EAR", "RNG") for k in range(3)} | {"EAR9"}


def test_a_planted_feature_is_the_most_important(spark):
    rng = np.random.default_rng(8)
    rows = [(f"i{k}", START + dt.timedelta(days=i), float(5 + 20 * f + rng.normal() * 0.3), f, float(rng.random()))
            for k in range(3) for i in range(240) for f in [int(rng.random() < 0.3)]]
    series = spark.createDataFrame(rows, "item_id string, ds date, y double, is_on_promotion int, discount_percentage double").withColumn(
        "is_holiday", F.lit(0))
    early, late = fc.split_late(stage(fc.gbt_training_rows(series, HORIZON), "rows"), HORIZON)
    model = fc.fit_gbt(early, fc.Boosting(3, 0.3, 8))
    found = {r.feature: r.importance for r in fc.permutation_importance(model, late).collect()}
    again = {r.feature: r.importance for r in fc.permutation_importance(model, late.repartition(7)).collect()}
    assert set(found) == set(fc.GBT_FEATURES) and max(found, key=found.get) == "is_on_promotion"
    assert found["is_on_promotion"] > 3 and abs(found["discount_percentage"]) < 0.3 and found["store_count"] == 0
    assert all(found[c] == pytest.approx(again[c], abs=1e-9) for c in found)


def test_profiles_of_days_merge_to_that_of_the_table(spark):
    rng = np.random.default_rng(3)
    rows = [(START + dt.timedelta(days=int(d)), float(round(x, 2)), None if x > 60 else float(x + rng.normal()))
            for d, x in zip(rng.integers(0, 20, 4000), rng.normal(50, 10, 4000))]
    df = stage(spark.createDataFrame(rows, "ds date, a double, b double"), "profiled")
    days = stage(profile.daily_profile(df.where("ds < '2000-01-11'"), ["a", "b"], "a"), "first")
    more = stage(profile.daily_profile(df.where("ds >= '2000-01-11'"), ["a", "b"], "a"), "second")
    got = {r.column_name: r for r in profile.merged_profile(days.unionByName(more)).collect()}
    for want in profile.profile(df, ["a", "b"], "a").collect():
        mine = got[want.column_name]
        for c in ("rows", "nulls", "min", "max", "mean", "std", "corr_target"):
            assert mine[c] == pytest.approx(want[c], abs=1e-9), c
        exact = df.agg(F.countDistinct(want.column_name), F.percentile(want.column_name, F.array(F.lit(0.47), F.lit(0.53)))).first()
        assert mine.distinct_approx == pytest.approx(exact[0], rel=0.06) and exact[1][0] <= mine.median_approx <= exact[1][1]


def test_lines_are_aggregated_by_hashing(spark):
    lines = stage(spark.createDataFrame([("E1", "Web", START, 2.0, 1.0, "EAR", "men"), ("E1", "Web", START, 3.0, 2.0, None, "men")],
                                        "sku string, channel string, ds date, qty double, disc double, category string, gender string"), "lines")
    out = sales.daily_sales(lines)
    plan_text = out._jdf.queryExecution().executedPlan().toString()
    assert plan_text.count("SortAggregate") <= 2 and plan_text.count("HashAggregate") >= 4  # text only among distinct items
    assert [tuple(r) for r in out.collect()] == [("E1_Web", "E1", "Web", START, 5.0, 1.5, "EAR", "men")]
    docs = orders.all_sales(stage(spark.createDataFrame([], ORDERS), "docs"), spark.createDataFrame([], "store_id int, store_name string"))
    assert docs._jdf.queryExecution().executedPlan().toString().count("Generate") == 1
