"""Regressions of daily series on calendar waves and known regressors, by sufficient statistics.

The design of a day is an intercept, a trend, sine and cosine waves and the regressors. Days are cut into
blocks of one forecast horizon, counted back from the newest day; for each item and block only X'X, X'y and
the number of days are kept. They add up: the fit before a validation window is the sum of the blocks older
than it, so all windows and the final fit come out of one pass over the history, and an item's statistics
are a few rows however long its history is.

Each batch of days is reduced to partial sums where it is read, so a shuffle carries sums, not days. The fit is a
ridge solved by Cholesky factors; intercept and trend are not shrunk. A day of a window is scored with the
coefficients of that window, which it meets by item and block.
"""

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder import config

STATISTICS = pa.schema([("item_id", pa.string()), ("block", pa.int32()), ("days", pa.int64()),
                        ("xtx", pa.list_(pa.float64())), ("xty", pa.list_(pa.float64()))])
COEFFICIENTS = pa.schema([("item_id", pa.string()), ("block", pa.int32()), ("days", pa.int64()),
                          ("coef", pa.list_(pa.float64()))])


@dataclass(frozen=True)
class Design:
    """Waves as (period in days, order), the regressors' columns, and the ridge on both."""

    waves: tuple[tuple[float, int], ...] = ((365.25, 10), (30.5, 5), (7.0, 3))
    regressors: tuple[str, ...] = ("is_holiday",)
    ridge: float = 1.0
    name: str = "Harmonic"

    def matrix(self, day: np.ndarray, columns: list[np.ndarray]) -> np.ndarray:
        """One row per day; ``day`` counts from any fixed date."""
        cols = [np.ones(len(day)), day / 365.25]
        for period, order in self.waves:
            for k in range(1, order + 1):
                angle = 2 * math.pi * k * day / period
                cols += [np.sin(angle), np.cos(angle)]
        return np.column_stack([*cols, *columns]) if len(day) else np.empty((0, self.width))

    @property
    def width(self) -> int:
        return 2 + 2 * sum(order for _, order in self.waves) + len(self.regressors)

    def solve(self, xtx: np.ndarray, xty: np.ndarray) -> np.ndarray:
        """The ridge coefficients of the summed statistics; least norm where days do not determine them."""
        penalty = np.full(self.width, self.ridge)
        penalty[:2] = 1e-8 if self.ridge else 0.0
        try:
            lower = np.linalg.cholesky(xtx + np.diag(penalty))
        except np.linalg.LinAlgError:
            return np.linalg.lstsq(xtx + np.diag(penalty), xty, rcond=None)[0]
        return np.linalg.solve(lower.T, np.linalg.solve(lower, xty))


HARMONIC = Design()
# Shares and flags only, so that the one ridge suits all of them.
REGRESSORS = Design(regressors=("is_holiday", "is_on_promotion", "discount_percentage", "store_growth", "was_stocked_out"))
TREND = Design(waves=(), regressors=(), ridge=0.0, name="Trend")


def day_number(last: Column) -> Column:
    """Days up to the newest day of the history, so that figures stay small: 0 on it, negative before."""
    return F.datediff("ds", last).cast("double")


def _blocks(series: DataFrame, design: Design, windows: int, horizon: int, last: Column) -> DataFrame:
    """item_id, ds, y, day, block (0 newest .. ``windows`` all that is older) and the regressors as doubles."""
    back = F.floor(-day_number(last) / horizon)
    return series.where(F.col("item_id").isNotNull()).select(
        F.col("item_id").cast("string").alias("item_id"), "ds", F.col("y").cast("double").alias("y"),
        day_number(last).alias("day"), F.least(back, F.lit(windows)).cast("int").alias("block"),
        *_regressors(series, design))


def _regressors(rows: DataFrame, design: Design) -> list[Column]:
    """The regressors as doubles; unknown ones, and columns that ``rows`` lacks, are 0."""
    return [(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in rows.columns else F.lit(0.0)).alias(c) for c in design.regressors]


def _floats(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in names]


def statistics(blocks: DataFrame, design: Design) -> DataFrame:
    """(item_id, block, days, xtx, xty): partial sums of each batch, which add up."""
    def run(batches):
        for batch in batches:
            items = batch.column(0).dictionary_encode()
            code = items.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            (block, day, y), extra = _floats(batch, "block", "day", "y"), _floats(batch, *design.regressors)
            known = ~np.isnan(y)
            order = np.lexsort((block[known], code[known]))
            x, target = design.matrix(day[known], [c[known] for c in extra])[order], y[known][order]
            key = np.stack([code[known], block[known].astype(np.int64)])[:, order]
            if not len(target):
                continue
            first = np.flatnonzero(np.r_[True, (key[:, 1:] != key[:, :-1]).any(axis=0)])
            ends = np.r_[first[1:], len(target)]
            names = items.dictionary.to_pylist()
            yield pa.RecordBatch.from_pydict({
                "item_id": [names[c] for c in key[0, first].tolist()], "block": key[1, first].astype(np.int32), "days": ends - first,
                "xtx": [(x[a:b].T @ x[a:b]).ravel() for a, b in zip(first, ends)],
                "xty": [x[a:b].T @ target[a:b] for a, b in zip(first, ends)]}, schema=STATISTICS)

    return blocks.mapInArrow(run, "item_id string, block int, days long, xtx array<double>, xty array<double>")


def coefficients(stats: DataFrame, design: Design, windows: int, older: bool = True) -> DataFrame:
    """(item_id, block, days, coef): for block b the fit on all older blocks; -1 is the fit on the whole history.

    Without ``older`` a block's fit is that on its own sums.

    A task takes its items one after the other; an item is at most its blocks times the batches it came in.
    """
    def solved(item, rows):
        p = design.width
        xtx, xty, days = np.zeros((windows + 1, p, p)), np.zeros((windows + 1, p)), np.zeros(windows + 1, np.int64)
        for block, n, a, b in rows:
            xtx[block] += np.asarray(a).reshape(p, p)
            xty[block] += b
            days[block] += n
        if older:  # sums over a block and all older ones
            xtx, xty, days = (np.cumsum(s[::-1], axis=0)[::-1] for s in (xtx, xty, days))
        for block in range(windows + 1):
            if days[block]:
                yield item, block - older, int(days[block]), design.solve(xtx[block], xty[block])

    def run(batches):
        held, item, out = [], None, []
        for batch in batches:
            for name, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if name != item:
                    out += solved(item, held)
                    held, item = [], name
                held.append(row)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), COEFFICIENTS)], schema=COEFFICIENTS)
                out = []
        out += solved(item, held)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), COEFFICIENTS)], schema=COEFFICIENTS)

    dealt = stats.repartition("item_id").sortWithinPartitions("item_id")
    return dealt.mapInArrow(run, "item_id string, block int, days long, coef array<double>")


def _out_of_fold(stats: DataFrame, design: Design, folds: int) -> DataFrame:
    """(item_id, block, days, coef): for each fold the fit on the days of all other folds."""
    others = F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), lambda k: k != F.col("block"))
    rest = stats.select("item_id", F.explode(others).alias("block"), "days", "xtx", "xty")
    # With every row in the folds it does not belong to, a block's own sum is the fit without its days.
    return coefficients(rest, design, folds - 1, older=False)


def cross_fitted(rows: DataFrame, design: Design, folds: int = 5, fold_days: int = 7, cleared: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` (item_id, ds, y, regressors and others) with ``mean``, from a fit that saw neither the day nor those around it.

    Runs of ``fold_days`` days are dealt to the folds in turn. Regressors named in ``cleared`` are 0 when the days are
    scored, which makes the counterfactual without them. Days of an item that has days in one fold only are left out.
    """
    last = rows.agg(F.max("ds")).scalar()
    kept = [c for c in rows.columns if c not in ("item_id", "ds", "y", *design.regressors)]
    fold = F.pmod(F.floor(-day_number(last) / fold_days), F.lit(folds)).cast("int")
    placed = rows.where(F.col("item_id").isNotNull()).select(
        F.col("item_id").cast("string").alias("item_id"), "ds", F.col("y").cast("double").alias("y"), day_number(last).alias("day"),
        fold.alias("block"), *_regressors(rows, design), *kept)
    coefs = _out_of_fold(statistics(placed.select("item_id", "ds", "y", "day", "block", *design.regressors), design), design, folds)
    values = {c: F.lit(0.0) for c in cleared}
    out = scored(placed.withColumns(values) if values else placed, coefs, design)
    return out.drop("day", "block", *cleared)


def fitted(series: DataFrame, design: Design = HARMONIC, windows: int = 0, horizon: int = config.PREDICTION_LENGTH,
           last: Column | None = None) -> DataFrame:
    """The coefficients of every item: of the whole history and, with ``windows``, before each of them."""
    last = last if last is not None else series.agg(F.max("ds")).scalar()
    return coefficients(statistics(_blocks(series, design, windows, horizon, last), design), design, windows)


def scored(rows: DataFrame, coefs: DataFrame, design: Design) -> DataFrame:
    """``rows`` (item_id, block, day, regressors and others) with ``mean``, never below 0; items without a fit are left out."""
    joined = rows.join(coefs.select("item_id", "block", "coef"), ["item_id", "block"])

    @F.arrow_udf("double")
    def value(coef: pa.Array, day: pa.Array, *extra: pa.Array) -> pa.Array:
        x = design.matrix(day.to_numpy(zero_copy_only=False), [c.to_numpy(zero_copy_only=False) for c in extra])
        found = np.einsum("ij,ij->i", x, coef.flatten().to_numpy().reshape(len(x), design.width))
        return pa.array(np.maximum(found, 0.0))

    return joined.withColumn("mean", value("coef", "day", *design.regressors)).drop("coef")


def forecast(series: DataFrame, future: DataFrame, design: Design = HARMONIC) -> DataFrame:
    """(model, item_id, step, ds, mean) on the rows of ``future`` (item_id, ds, step and the regressors)."""
    last = series.agg(F.max("ds")).scalar()
    return forecast_saved(fitted(series, design, last=last), last, future, design)


def forecast_saved(coefs: DataFrame, last: Column, future: DataFrame, design: Design) -> DataFrame:
    """The same from coefficients whose fit ended on the day ``last``."""
    ahead = future.select(
        F.col("item_id").cast("string").alias("item_id"), "step", "ds", F.lit(-1).alias("block"), day_number(last).alias("day"),
        *_regressors(future, design))
    out = scored(ahead, coefs, design)
    return out.select(F.lit(design.name).alias("model"), "item_id", "step", "ds", "mean")


def backtest(series: DataFrame, windows: int = config.VALIDATION_WINDOWS, horizon: int = config.PREDICTION_LENGTH,
             design: Design = HARMONIC) -> DataFrame:
    """(item_id, window, step, ds, y, model, yhat): every window's days under the fit on the days before it."""
    last = series.agg(F.max("ds")).scalar()
    blocks = _blocks(series, design, windows, horizon, last)
    coefs = coefficients(statistics(blocks, design), design, windows)
    out = scored(blocks.where(F.col("block") < windows), coefs, design)
    step = (F.lit(horizon) - F.pmod(-F.col("day").cast("int"), F.lit(horizon))).cast("int")
    return out.select("item_id", F.col("block").alias("window"), step.alias("step"), "ds", "y",
                      F.lit(design.name).alias("model"), F.col("mean").alias("yhat"))
