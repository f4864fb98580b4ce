"""Artefacts of a run: fitted models, their settings and vocabularies, kept under the run's id.

An artefact is written once, by the run that fits it, and never changed. Scoring only reads.
"""

import json
from dataclasses import dataclass

from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder import config
from larder.operators import forecast as fc
from larder.operators import grid, regression
from larder.session import stage

DESIGNS = {"Trend": regression.TREND, "Harmonic": regression.REGRESSORS}
MAX_VALUES = 1000


def place(folder: str, run_id: str, name: str) -> str:
    return f"{folder}/artefacts/run_id={run_id}/{name}"


def save(table: DataFrame, folder: str, run_id: str, name: str) -> None:
    table.write.mode("error").parquet(place(folder, run_id, name))


def load(spark: SparkSession, folder: str, run_id: str, name: str) -> DataFrame:
    return spark.read.parquet(place(folder, run_id, name))


# ---- models -------------------------------------------------------------------------------

@dataclass(frozen=True)
class SavedModel:
    """A model of a run with its settings; ``score`` reads what the run has saved and fits nothing."""

    spark: SparkSession
    folder: str
    run_id: str
    name: str
    settings: dict

    def score(self, series: DataFrame, horizon: int = config.PREDICTION_LENGTH, days: DataFrame | None = None) -> DataFrame:
        """(model, item_id, step, ds, mean) of the ``horizon`` days after each item's own last day.

        ``days`` (ds and known columns) tells what is known of the days ahead; unknown columns count as 0. Items
        that the model cannot score, those a regression has no coefficients for, are left out.
        """
        if self.name == "SMA":
            return fc.sma(series, horizon, self.settings["window"], own_end=True)
        if self.name == "SeasonalNaive":
            return fc.seasonal_naive(series, horizon, self.settings["season"], own_end=True)
        future = grid.future_days(series.groupBy("item_id").agg(F.max("ds").alias("last_ds")), "last_ds", horizon).drop("last_ds")
        known = fc.KNOWN_DAYS if self.name == "GBT" else list(DESIGNS[self.name].regressors)
        told = [c for c in known if c in days.columns] if days is not None else []
        if told:
            one = days.groupBy("ds").agg(*[F.max(c).alias(c) for c in told])  # one row a day
            future = future.join(F.broadcast(one), "ds", "left")
        future = future.withColumns({c: F.coalesce(c, F.lit(0)) if c in future.columns else F.lit(0) for c in known})
        if self.name == "GBT":
            model = GBTRegressionModel.load(place(self.folder, self.run_id, "GBT"))
            return fc.score_gbt(model, fc.gbt_future_rows(series, future, own_end=True))
        coefs = load(self.spark, self.folder, self.run_id, self.name)
        return regression.forecast_saved(coefs, F.lit(self.settings["last_day"]).cast("date"), future, DESIGNS[self.name])


def fit_and_save(series: DataFrame, folder: str, run_id: str, names: tuple[str, ...]) -> None:
    """Fit the named models on ``series`` and write them with their settings under the run."""
    spark, rows = series.sparkSession, []
    for name in names:
        if name == "SMA":
            settings = {"window": config.SMA_WINDOW}
        elif name == "SeasonalNaive":
            settings = {"season": config.SEASON_LENGTH}
        elif name == "GBT":
            training = stage(fc.gbt_training_rows(series), "gbt-run")
            best = fc.search_gbt(training)[0]
            fc.fit_gbt(training, best.settings).write().save(place(folder, run_id, name))
            settings = {"depth": best.settings.depth, "rate": best.settings.rate, "rounds": best.settings.rounds, "rmse": best.rmse}
        else:
            settings = {"last_day": str(series.agg(F.max("ds")).first()[0])}
            save(regression.fitted(series, DESIGNS[name]).where("block = -1"), folder, run_id, name)
        rows.append((name, json.dumps(settings)))
    save(spark.createDataFrame(rows, "name string, settings string"), folder, run_id, "models")


def saved_model(spark: SparkSession, folder: str, run_id: str, name: str) -> SavedModel:
    row = load(spark, folder, run_id, "models").where(F.col("name") == name).first()
    if row is None:
        raise ValueError(f"run {run_id} has no model {name}")
    return SavedModel(spark, folder, run_id, name, json.loads(row.settings))


# ---- vocabularies -------------------------------------------------------------------------

def fit_vocabulary(items: DataFrame, columns: tuple[str, ...], limit: int = MAX_VALUES) -> DataFrame:
    """(column, value): the distinct values of each column in training; more than ``limit`` of a column are an error.

    The values become columns, so their number is bounded on purpose.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    found = items.select(F.explode(pairs).alias("p")).select("p.*").where("value IS NOT NULL").distinct()
    sizes = {r["column"]: r["count"] for r in found.groupBy("column").count().collect()}
    wide = {c: n for c, n in sizes.items() if n > limit}
    if wide:
        raise ValueError(f"too many values for one-hot columns: {wide}")
    return found


def vocabulary(saved: DataFrame, limit: int = MAX_VALUES) -> dict[str, list[str]]:
    """A saved vocabulary as sorted lists, ``limit`` values per column at most."""
    out: dict[str, list[str]] = {}
    for row in saved.orderBy("column", "value").collect():
        out.setdefault(row["column"], []).append(row["value"])
    if any(len(values) > limit for values in out.values()):
        raise ValueError("the vocabulary is longer than its bound")
    return out
