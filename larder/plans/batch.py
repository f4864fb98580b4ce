"""The batch run as one flow: what changed, contest, gate, forecast, recommendations, models, log, versions."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder import config
from larder.functions import cleaning as cl
from larder.operators import evaluate as ev
from larder.operators import forecast as fc
from larder.operators import inventory, monitor
from larder.operators import sales as sl
from larder.plans import forecasting as plan
from larder.session import stage
from larder.sources import artefacts, files, sinks

MODELS = ("SMA", "SeasonalNaive")


def read_or_none(spark, path: str) -> DataFrame | None:
    """A table that an earlier run left, if any."""
    return spark.read.parquet(path) if files.exists(spark, path) else None


def runs_of(spark, folder: str) -> list:
    """The log's rows (run_id, sequence, decision, mase, rmse, model), oldest first; one row per run."""
    log = read_or_none(spark, f"{folder}/log")
    if log is None:
        return []
    number = F.col("snapshot")["sequence"].cast("int")
    return log.select("run_id", number.alias("sequence"), "decision", F.col("metrics")["mase"].alias("mase"),
                      F.col("metrics")["rmse"].alias("rmse"), F.col("snapshot")["model"].alias("model")).orderBy("sequence").collect()


def champion_of(runs: list):
    """The newest promoted run, if any."""
    return next((r for r in reversed(runs) if r.decision == "promote"), None)


def gate(figures: DataFrame, champion, policy: str, threshold: float = config.IMPROVEMENT_THRESHOLD):
    """(decision, reason) of a run with the one-row ``figures`` (mase, rmse) against the champion's log row."""
    old = {k: F.lit(champion[k] if champion else None).cast("double") for k in ("mase", "rmse")}
    verdict = monitor.compare({k: F.col(k) for k in ("mase", "rmse")}, old, F.lit(champion is None), threshold)
    row = figures.select(verdict["is_better"].alias("is_better"), verdict["reason"].alias("reason")).first()
    return ("promote" if policy == "always" or row.is_better else "reject"), row.reason


def batch_run(sales: DataFrame, folder: str, run_id: str, policy: str = "threshold",
              models: tuple[str, ...] = MODELS, keep: int = config.VERSIONS_TO_KEEP) -> DataFrame:
    """Run the batch over ``sales`` and return the published recommendations: this run's, or the champion's if it is rejected.

    The models compete on the items whose history is longer than the horizon. The run is compared with the newest promoted run
    before anything is published; a rejected run leaves only its row in the log. A promoted run publishes, under
    its id, ``results`` (recommendations from each item's champion or blend), ``forecasts`` (its days with
    quantiles), ``status`` (item and last trained day) and ``artefacts`` (the fitted models). Only items with
    sales after their last training are forecast; the others keep their rows of the champion run. The log row comes
    last and commits the run; a run that dies before it may be repeated. Of the published versions the
    newest ``keep`` stay.
    """
    spark = sales.sparkSession
    runs = runs_of(spark, folder)
    if run_id in {r.run_id for r in runs}:
        raise ValueError(f"run {run_id} is in the log already")
    champion = champion_of(runs)

    daily = sales.where(F.col("sku").isNotNull()).groupBy("sku", "channel", "ds").agg(F.sum("qty").alias("qty"))
    daily = stage(daily.withColumn("item_id", cl.item_id()), "daily-units")
    newest = daily.groupBy("item_id").agg(F.max("ds").alias("last_trained"))
    long = stage(sl.min_history(daily).select("item_id"), "long-items")
    panel = plan.dense_units(daily.select("item_id", "ds", F.col("qty").alias("y")).join(long, "item_id", "left_semi"), daily)
    series, scored = plan.backtested(panel)
    scored = scored.where(F.col("model").isin(*models))
    errors = stage(plan.model_errors(series, scored), "run-errors")
    board = stage(errors.groupBy("model").agg(F.avg("mase").alias("mase"), F.avg("rmse").alias("rmse"), F.avg("wape").alias("wape")), "run-board")
    # Rounded, so that a repeated run over the same sales is no better or worse by the order of its sums.
    figures = board.agg(*[F.round(F.min(c), 9).alias(c) for c in ("mase", "rmse", "wape")])
    decision, reason = gate(figures, champion, policy)
    best = board.orderBy(F.asc_nulls_last("mase"), "model").select("model").first()

    def logged(snapshot):
        snapshot |= {"sequence": str(len(runs) + 1), "model": best.model if best else "None"}
        sinks.append(monitor.run_record(
            run_id, daily.agg(F.max("ds")).scalar(), figures, decision, [reason], champion.run_id if champion else "None",
            snapshot, "scheduled", []), f"{folder}/log")

    if decision == "reject":
        logged({"results": f"run_id={champion.run_id}"})
        return spark.read.parquet(f"{folder}/results/run_id={champion.run_id}")

    picked = long
    if champion is not None:
        status = spark.read.parquet(f"{folder}/status/run_id={champion.run_id}")
        picked = picked.join(sl.incremental(daily.select("item_id", "ds"), status), "item_id", "left_semi")
    picked = stage(picked, "picked-items")
    ahead = forecasts(series, scored, errors, picked, models)
    table = inventory.forecast_by_horizon(ahead)
    fresh = inventory.recommendations(inventory.inventory_metrics(table, plan.volume_classes(daily)))
    publish(fresh, ["item_id", "channel", "horizon"], folder, "results", run_id, champion)
    publish(ahead, ["item_id", "step"], folder, "forecasts", run_id, champion, picked)
    publish(newest, ["item_id"], folder, "status", run_id, champion)
    artefacts_path = artefacts.place(folder, run_id, "")
    files.delete(spark, artefacts_path)  # what a run that died has left
    artefacts.fit_and_save(series, folder, run_id, models)
    logged({"results": f"run_id={run_id}"})
    kept = [r.run_id for r in runs if r.decision == "promote"][-(keep - 1):] if keep > 1 else []
    retain(spark, folder, [*kept, run_id])
    return spark.read.parquet(f"{folder}/results/run_id={run_id}")


def forecasts(series: DataFrame, scored: DataFrame, errors: DataFrame, picked: DataFrame, models: tuple[str, ...]) -> DataFrame:
    """The champion's or blend's days of the picked items, with quantiles from its own backtest, staged."""
    own = series.join(picked, "item_id", "left_semi")
    end = series.agg(F.max("ds")).scalar()
    made = {"SMA": lambda: fc.sma(own, end=end), "SeasonalNaive": lambda: fc.seasonal_naive(own, end=end)}
    rows = None
    for name in models:
        rows = made[name]() if rows is None else rows.unionByName(made[name]())
    rows = plan.champion_rows(stage(rows, "run-models"), errors)
    all_scored = stage(plan.blended_backtest(scored, errors), "run-blended")
    scales = stage(fc.item_scales(all_scored), "run-scales")
    return stage(fc.with_intervals(rows, fc.residual_quantiles(all_scored, scales), scales), "run-forecasts")


def publish(fresh: DataFrame, keys: list[str], folder: str, name: str, run_id: str, champion, renewed: DataFrame | None = None) -> None:
    """Write a table of the run; rows of the champion run that are not replaced stay.

    With ``renewed`` all rows of its items are replaced.
    """
    if champion is not None:
        before = fresh.sparkSession.read.parquet(f"{folder}/{name}/run_id={champion.run_id}").select(*fresh.columns)
        if renewed is not None:
            merged = before.join(renewed, "item_id", "left_anti").unionByName(fresh)
        else:
            merged = sinks.upserted(before, fresh, keys)
        fresh = merged.select(*fresh.columns)
    sinks.overwrite(fresh, f"{folder}/{name}/run_id={run_id}")


def retain(spark, folder: str, kept: list[str]) -> None:
    """Delete the published tables and models of all other runs; the log keeps every run."""
    for name in ("results", "forecasts", "status", "artefacts"):
        for child in files.children(spark, f"{folder}/{name}"):
            if child.rpartition("/")[2].removeprefix("run_id=") not in kept:
                files.delete(spark, child)


def champion_model(spark, folder: str) -> artefacts.SavedModel | None:
    """The best model of the newest promoted run, loaded; None before the first run."""
    champion = champion_of(runs_of(spark, folder))
    return artefacts.saved_model(spark, folder, champion.run_id, champion.model) if champion else None


def published(spark, folder: str) -> DataFrame:
    """The recommendations of the kept runs, with their ``run_id``."""
    return spark.read.parquet(f"{folder}/results")
