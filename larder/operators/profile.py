"""Column profile of a table against a target."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.operators import ordered


def profile(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """Count, nulls, distinct estimate, range, moments, median estimate and correlation.

    All columns come out of one aggregation; the wide row is then turned into one row each.
    """
    def stats(c):
        v = F.col(c).cast("double")
        return F.struct(
            F.lit(c).alias("column_name"), F.count(F.lit(1)).alias("rows"),
            F.count(F.when(v.isNull(), 1)).alias("nulls"), F.approx_count_distinct(v).alias("distinct_approx"),
            F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"),
            F.stddev_samp(v).alias("std"), F.percentile_approx(v, 0.5).alias("median_approx"),
            F.corr(v, F.col(target).cast("double")).alias("corr_target"))
    return df.agg(F.array(*[stats(c) for c in columns]).alias("_p")).select(F.inline("_p"))


# Sizes of the sketches: standard errors of about 1.04 / sqrt(2**12) = 1.6 % in counts and 1.3 % in ranks.
DISTINCT_BITS, QUANTILE_SIZE = 12, 200
SUMS = ("rows", "nulls", "n", "sx", "sxx", "pairs", "px", "py", "pxx", "pyy", "pxy")


def daily_profile(df: DataFrame, columns: list[str], target: str, by: str = "ds") -> DataFrame:
    """One row per day and column with what can be added up: counts, sums of powers, range and two sketches.

    The sketches hold the distinct values (about 2**DISTINCT_BITS bytes) and the quantiles (a few kB), whatever
    the number of rows. Stored by day, a new day is profiled alone.
    """
    def stats(c):
        v, t = F.col(c).cast("double"), F.col(target).cast("double")
        x, y = F.when(t.isNotNull(), v), F.when(v.isNotNull(), t)
        return F.struct(
            F.lit(c).alias("column_name"), F.count(F.lit(1)).alias("rows"), F.count(F.when(v.isNull(), 1)).alias("nulls"),
            F.count(v).alias("n"), F.sum(v).alias("sx"), F.sum(v * v).alias("sxx"), F.count(x * y).alias("pairs"),
            F.sum(x).alias("px"), F.sum(y).alias("py"), F.sum(x * x).alias("pxx"), F.sum(y * y).alias("pyy"), F.sum(x * y).alias("pxy"),
            F.min(v).alias("min"), F.max(v).alias("max"), F.hll_sketch_agg(v.cast("string"), DISTINCT_BITS).alias("distinct"),
            F.kll_sketch_agg_double(v, QUANTILE_SIZE).alias("quantiles"))
    return df.groupBy(by).agg(F.array(*[stats(c) for c in columns]).alias("_p")).select(by, F.inline("_p"))


def merged_profile(days: DataFrame) -> DataFrame:
    """The profile of all days together, from their stored rows alone; the columns of ``profile``."""
    total = days.groupBy("column_name").agg(
        *[F.sum(c).alias(c) for c in SUMS], F.min("min").alias("min"), F.max("max").alias("max"),
        F.hll_union_agg("distinct").alias("distinct"), F.kll_merge_agg_double("quantiles").alias("quantiles"))
    mean = F.try_divide("sx", "n")
    spread = F.when(F.col("n") > 1, F.sqrt(F.greatest(F.col("sxx") - F.col("sx") * mean, F.lit(0.0)) / (F.col("n") - 1)))

    def centred(product, a, b):
        return F.col(product) - F.col(a) * F.col(b) / F.col("pairs")

    scale = F.sqrt(centred("pxx", "px", "px")) * F.sqrt(centred("pyy", "py", "py"))
    return total.select(
        "column_name", "rows", "nulls", F.hll_sketch_estimate("distinct").alias("distinct_approx"), "min", "max",
        mean.alias("mean"), spread.alias("std"),
        F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("quantiles", F.lit(0.5))).alias("median_approx"),
        F.when(scale > 0, centred("pxy", "px", "py") / scale).alias("corr_target"))


def exact_profile(df: DataFrame, columns: list[str], probs: dict[str, float]) -> DataFrame:
    """Exact ``distinct`` and quantiles (named by ``probs``), one row for each column that has values.

    Equal values are counted and their counts sorted over all tasks, so no task holds the values of a column.
    """
    values = df.select(F.inline(F.array(*[F.struct(
        F.lit(c).alias("column_name"), F.col(c).cast("double").alias("value")) for c in columns])))
    return ordered.quantiles(values, "value", probs, ("column_name",), distinct="distinct")
