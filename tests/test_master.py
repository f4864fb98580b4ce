"""The SKU master row, and the route of SKUs that neither a contest nor a category can forecast."""

import datetime as dt

import pytest

from larder.plans import forecasting as plan

LAST = dt.date(2023, 12, 31)


def lines(spark, units):
    """Sales lines of {sku: function of the day's number, 0 or None for no sale} over 1,200 days up to ``LAST``."""
    rows = [(sku, LAST - dt.timedelta(days=1199 - i), float(n), 10.0 * n)
            for sku, of_day in units.items() for i in range(1200) if (n := of_day(i))]
    return spark.createDataFrame(rows, "sku string, ds date, qty double, revenue double")


@pytest.fixture(scope="module")
def master(spark):
    sales = lines(spark, {
        "RING1": lambda i: 10 + i % 7,               # the same week again and again
        "RING2": lambda i: 100 if i % 7 == 0 else 1,  # the mean of a week says nothing of its days
        "RING3": lambda i: 20 + i * 37 % 11})        # errors of both models are alike and small
    return {r.sku_id: r for r in plan.sku_master(sales).collect()}


def test_exact_weeks(master):
    row = master["RING1"]
    assert row.champion == "Ensemble" and row.rmse_seasonalnaive == 0 and row.r2_seasonalnaive == 1
    assert row.champion_rmse == pytest.approx(0, abs=1e-9)
    assert row.ci_width_30d == pytest.approx(0, abs=1e-6) and row.last_processed_date == LAST


def test_single_champion_has_its_models_errors(master):
    row = master["RING2"]
    assert row.champion == "SeasonalNaive"
    for e in plan.MASTER_ERRORS:
        assert row[f"champion_{e}"] == row[f"{e}_seasonalnaive"]
    assert row.mae_sma > 20 > row.champion_mae == 0


def test_blend_is_judged_as_a_blend(master):
    row = master["RING3"]
    assert row.champion == "Ensemble"
    assert 0 < row.champion_rmse < max(row.rmse_sma, row.rmse_seasonalnaive)
    assert row.champion_mae <= max(row.mae_sma, row.mae_seasonalnaive)
    assert row.ci_width_30d > 0 and row.ci_width_90d > 0


def test_moving_average_where_no_category_has_a_forecast(spark):
    """``GEM1`` is sparse and its category has too few records for a series; ``RING2`` is sparse in a category with one."""
    sales = lines(spark, {
        "RING1": lambda i: 10 + i % 7, "RING2": lambda i: 5 if i % 30 == 0 else None,
        "GEM1": lambda i: 14 if i in (3, 1195) else None})
    rows = plan.routed_forecast(sales).collect()
    models = {r.item_id: r.model for r in rows}
    assert models["GEM1"] == "SMA" and models["RING2"] == "Category" and models["RING1"] in ("SMA", "SeasonalNaive", "Ensemble")
    days = [r["mean"] for r in rows if r.item_id == "GEM1"]
    assert len(days) == 183 and days == [pytest.approx(2.0)] * 183  # 14 units within the last seven days
