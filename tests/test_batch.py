"""The batch run: gate, champion, retention, saved models and vocabularies."""

import datetime as dt

import numpy as np
import pytest
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from larder.operators import forecast as fc
from larder.operators import regression
from larder.operators import sales as sl
from larder.plans import batch
from larder.plans import forecasting as plan
from larder.session import new_path, stage
from larder.sources import artefacts, files

START = dt.date(2000, 1, 1)


def sales_of(spark, days=500, noise=0.0, skus=4, extra=()):
    rng = np.random.default_rng(5)
    rows = [(f"EAR{k}", "Web", START + dt.timedelta(days=i), float(round(max(0, 20 + k + 5 * (i % 7 == 0) + noise * rng.normal()), 3)))
            for k in range(skus) for i in range(days)]
    return stage(spark.createDataFrame(rows + list(extra), "sku string, channel string, ds date, qty double"), "batch-sales")


def table(spark, folder, name, run_id):
    return sorted(map(tuple, spark.read.parquet(f"{folder}/{name}/run_id={run_id}").collect()))


def test_a_rejected_run_publishes_nothing(spark):
    folder = new_path(spark, "batch-test")
    first = batch.batch_run(sales_of(spark), folder, "run_9").collect()
    results, status = table(spark, folder, "results", "run_9"), table(spark, folder, "status", "run_9")
    second = batch.batch_run(sales_of(spark, 520, noise=15.0), folder, "run_10").collect()
    assert sorted(second) == sorted(first)
    assert table(spark, folder, "results", "run_9") == results and table(spark, folder, "status", "run_9") == status
    assert [c.rpartition("/")[2] for c in files.children(spark, f"{folder}/results")] == ["run_id=run_9"]
    log = batch.runs_of(spark, folder)
    assert [(r.run_id, r.decision) for r in log] == [("run_9", "promote"), ("run_10", "reject")]
    # The rejected run is not the next one's champion, and text order of the ids plays no part.
    batch.batch_run(sales_of(spark, 521), folder, "run_11", "always")
    assert [r.run_id for r in batch.runs_of(spark, folder)] == ["run_9", "run_10", "run_11"]
    assert batch.champion_of(batch.runs_of(spark, folder)).run_id == "run_11"
    with pytest.raises(ValueError, match="run_9"):
        batch.batch_run(sales_of(spark), folder, "run_9")


def test_only_changed_items_are_forecast_again(spark):
    folder = new_path(spark, "batch-test")
    lines = sales_of(spark)
    before = {tuple(r)[:1] + (r.horizon,): r for r in batch.batch_run(lines, folder, "a").collect()}
    more = [("EAR1", "Web", START + dt.timedelta(days=500 + i), 60.0) for i in range(20)] + [("EAR9", "Web", START + dt.timedelta(days=519), 1.0)]
    after = {tuple(r)[:1] + (r.horizon,): r for r in batch.batch_run(sales_of(spark, extra=more), folder, "b", "always").collect()}
    assert before.keys() == after.keys()  # EAR9 has no history yet
    assert {k[0] for k in before if before[k] != after[k]} == {"EAR1"}
    days = spark.read.parquet(f"{folder}/forecasts/run_id=b")
    assert days.count() == 4 * 183 and days.where("q10 < 0 OR q10 > q50 OR q50 > q90").count() == 0


def test_the_sixth_version_goes(spark):
    folder = new_path(spark, "batch-test")
    for i in range(4):
        batch.batch_run(sales_of(spark, 400 + i, skus=1), folder, f"r{i}", "always", keep=3)
    for name in ("results", "forecasts", "status", "artefacts"):
        assert [c[-2:] for c in files.children(spark, f"{folder}/{name}")] == ["r1", "r2", "r3"]
    assert len(batch.runs_of(spark, folder)) == 4 and batch.published(spark, folder).select("run_id").distinct().count() == 3


@pytest.fixture(scope="module")
def trained(spark):
    """A run with all kinds of models, and the series they were fitted on."""
    rng = np.random.default_rng(2)
    rows = [(f"i{k}", START + dt.timedelta(days=i), float(max(0, 20 + 8 * np.sin(2 * np.pi * i / 7) + rng.normal())))
            for k in range(3) for i in range(500)]
    series = stage(spark.createDataFrame(rows, "item_id string, ds date, y double").withColumns(
        {c: F.lit(0.0) for c in fc.KNOWN_DAYS}), "trained")
    folder = new_path(spark, "models-test")
    artefacts.fit_and_save(series, folder, "one", ("SMA", "SeasonalNaive", "Trend", "Harmonic", "GBT"))
    return series, folder


@pytest.mark.parametrize("name", ["SMA", "SeasonalNaive", "Trend", "Harmonic", "GBT"])
def test_uploads_are_scored_without_a_fit(spark, trained, monkeypatch, name):
    series, folder = trained

    def refuse(*_, **__):
        raise AssertionError("a fit at scoring")

    for owner, fit in ((GBTRegressor, "fit"), (fc, "fit_gbt"), (fc, "search_gbt"), (regression, "fitted"), (regression, "statistics")):
        monkeypatch.setattr(owner, fit, refuse)
    model = artefacts.saved_model(spark, folder, "one", name)
    known = series.where("item_id = 'i1'").select("item_id", "ds", F.col("y").alias("target"))
    new = spark.createDataFrame([("new", START + dt.timedelta(days=900 + i), float(i % 7)) for i in range(250)], known.schema)
    rows = plan.upload_forecast(known.unionByName(new), 100, model).toPandas()
    assert rows.groupby("item_id").size().to_dict() == {"i1": 100, "new": 100}
    used = dict(zip(rows["item_id"], rows["model"]))
    assert used == {"i1": name, "new": name if name in ("SMA", "SeasonalNaive", "GBT") else "SMA"}
    assert rows["mae"].notna().all() and (rows["mean"] >= 0).all() and rows["backtest_skipped"].isna().all()
    if name in ("SeasonalNaive", "Harmonic", "GBT"):
        assert rows[rows["item_id"] == "i1"]["mae"].iloc[0] < 3
    assert rows[rows["item_id"] == "new"]["ds"].min() == START + dt.timedelta(days=1150)


def test_saved_forecast_equals_the_fitted_one(spark, trained):
    series, folder = trained
    model = artefacts.saved_model(spark, folder, "one", "Trend")
    a = {(r.item_id, r.step): r["mean"] for r in model.score(series, 20).collect()}
    items = series.select("item_id").distinct()
    future = fc.future_days(items, F.lit(START + dt.timedelta(days=499)), 20)
    b = {(r.item_id, r.step): r["mean"] for r in regression.forecast(series, future, regression.TREND).collect()}
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], abs=1e-9) for k in a)
    settings = artefacts.saved_model(spark, folder, "one", "GBT").settings
    assert 1 <= settings["rounds"] <= 200 and settings["rmse"] > 0
    with pytest.raises(ValueError, match="no model"):
        artefacts.saved_model(spark, folder, "one", "Other")


def test_vocabulary_is_fitted_and_bounded(spark):
    items = spark.createDataFrame([("a", "x", None), ("b", "y", "u"), ("c", "x", "u")], "item_id string, category string, gender string")
    folder = new_path(spark, "vocabulary-test")
    artefacts.save(artefacts.fit_vocabulary(items, ("category", "gender")), folder, "r", "vocabulary")
    words = artefacts.vocabulary(artefacts.load(spark, folder, "r", "vocabulary"))
    assert words == {"category": ["x", "y"], "gender": ["u"]}
    later = spark.createDataFrame([("d", "z", "u")], items.schema)
    assert sl.one_hot(later, words).first().asDict() == {"item_id": "d", "category_x": 0.0, "category_y": 0.0, "gender_u": 1.0}
    with pytest.raises(ValueError, match="category"):
        artefacts.fit_vocabulary(items, ("category",), 1)
