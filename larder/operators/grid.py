"""Dense daily panels, fills and interpolation."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder import config


def days_of(key: str | list[str] = "item_id", ds: str = "ds"):
    """The one window all panel features share: rows of an item in day order.

    An item has at most one row per calendar day, so the partition is bounded by the calendar.
    """
    keys = [key] if isinstance(key, str) else key
    return Window.partitionBy(*keys).orderBy(ds)


def previous(n: int, key: str | list[str] = "item_id"):
    """The ``n`` days before the current one."""
    return days_of(key).rowsBetween(-n, -1)


def day_span(df: DataFrame, ds: str = "ds") -> tuple[Column, Column]:
    """First and last day of ``df`` as scalar subqueries; Spark merges the two into one pass."""
    return df.agg(F.min(ds)).scalar(), df.agg(F.max(ds)).scalar()


def dense_panel(daily: DataFrame, key: str = "item_id", carry: tuple[str, ...] = (),
                span: tuple[Column, Column] | None = None, fills: dict[str, str] | None = None,
                ds: str = "ds") -> DataFrame:
    """One row per item and day; days without an observation hold nulls unless filled.

    ``daily`` has one row per (key, ds). Each observed row emits itself and the empty days up
    to the item's next one, so the panel needs neither a cross join with a calendar nor a join
    back: the only exchange is the one by item, and later windows by item reuse it.
    ``span`` is the common first and last day; without it each item keeps its own.
    ``carry`` columns are constant per item and repeat on empty days. ``fills`` names a method
    per value column: ``zero``, ``ffill`` (last value, before the first the first one),
    ``interpolate`` (straight line, null before the first and held after the last value) or
    ``interpolate_back`` (the same, filled back at the head). Each observed row knows its
    neighbour, so filling needs no window over the dense rows. Two rows for one (key, ds), or a
    row outside ``span``, make the day sequence run backwards, which Spark reports as an error.
    """
    fills = fills or {}
    w = days_of(key, ds)
    first, last = span if span else (F.col(ds), F.col(ds))
    values = [c for c in daily.columns if c not in (key, ds, *carry)]
    lines = [c for c, m in fills.items() if m.startswith("interpolate")]
    spread = daily.withColumns({
        "_next": F.lead(ds).over(w),
        "_from": F.when(F.lag(ds).over(w).isNull(), first).otherwise(F.col(ds)),
        **{f"_next_{c}": F.lead(c).over(w) for c in lines},
    }).withColumn("_to", F.coalesce(F.date_sub("_next", 1), last))
    spread = spread.select(
        key, *carry, F.col(ds).alias("_seen"), "_next", *values, *[f"_next_{c}" for c in lines],
        F.explode(F.sequence("_from", "_to", F.expr("INTERVAL '1' DAY"))).alias(ds))
    seen, share = F.col(ds) == F.col("_seen"), F.try_divide(
        F.datediff(ds, "_seen"), F.datediff("_next", "_seen"))

    def value(c):
        method, v = fills.get(c), F.col(c)
        if method == "zero":
            return F.coalesce(F.when(seen, v), F.lit(0.0))
        if method == "ffill":
            return v
        if method is None:
            return F.when(seen, v)
        head = v if method == "interpolate_back" else F.lit(None)
        return (F.when(seen | F.col("_next").isNull() & (F.col(ds) > F.col("_seen")), v)
                .when(F.col(ds) < F.col("_seen"), head)
                .otherwise(v + (F.col(f"_next_{c}") - v) * share))

    return spread.select(key, *carry, ds, *[value(c).alias(c) for c in values])


def future_days(items: DataFrame, after, days: int = config.PREDICTION_LENGTH) -> DataFrame:
    """Every item on each of the ``days`` days after ``after`` (a date column or subquery)."""
    out = items.withColumn("_after", after if isinstance(after, Column) else F.col(after))
    return out.select(
        *items.columns, "_after",
        F.explode(F.sequence(F.lit(1), F.lit(days))).alias("step")
    ).withColumn("ds", F.date_add("_after", F.col("step"))).drop("_after")


def fill_forward_back(c: str, key: str = "item_id", ds: str = "ds") -> Column:
    """Last known value, else the next known one, inside the item.

    The look-ahead runs over the descending order: a frame that starts at the current row and
    ends at the partition's end would rescan the rest of the item for every row.
    """
    past = Window.unboundedPreceding
    return F.coalesce(
        F.last(c, True).over(days_of(key, ds).rowsBetween(past, 0)),
        F.last(c, True).over(_newest_first(key, ds).rowsBetween(past, 0)))


def _newest_first(key: str, ds: str):
    return Window.partitionBy(key).orderBy(F.desc(ds))


def fill_forward(c: str, key: str = "item_id") -> Column:
    return F.last(c, True).over(days_of(key).rowsBetween(Window.unboundedPreceding, 0))


def interpolate(df: DataFrame, c: str, key: str = "item_id", back_fill: bool = False,
                ds: str = "ds") -> DataFrame:
    """Straight line between known days; after the last known day its value is held.

    Before the first known day the value stays null, or is filled back with ``back_fill``.
    """
    past = days_of(key, ds).rowsBetween(Window.unboundedPreceding, 0)
    ahead = _newest_first(key, ds).rowsBetween(Window.unboundedPreceding, 0)
    point = F.when(F.col(c).isNotNull(), F.struct(F.col(ds).alias("d"), F.col(c).alias("v")))
    out = df.withColumns({"_prev": F.last(point, True).over(past),
                          "_next": F.last(point, True).over(ahead)})
    gap = F.datediff("_next.d", "_prev.d")
    line = F.col("_prev.v") + (F.col("_next.v") - F.col("_prev.v")) * F.try_divide(
        F.datediff(F.col(ds), F.col("_prev.d")), gap)
    head = F.col("_next.v") if back_fill else F.lit(None).cast("double")
    value = (F.when(F.col(c).isNotNull(), F.col(c))
             .when(F.col("_prev").isNull(), head)
             .when(F.col("_next").isNull(), F.col("_prev.v"))
             .otherwise(line))
    return out.withColumn(c, value).drop("_prev", "_next")


def fill_gaps(df: DataFrame, c: str, method: str = "zero", key: str = "item_id") -> DataFrame:
    """Fill the empty days of an existing dense panel: ``zero``, ``interpolate`` or ``ffill``.

    The method sees empty days as unknown, not as zero sales, so it has an effect. Where the
    panel is still to be made, ``dense_panel(fills=...)`` does it without windows.
    """
    if method == "interpolate":
        return interpolate(df, c, key, back_fill=True)
    if method == "ffill":
        return df.withColumn(c, F.coalesce(fill_forward_back(c, key), F.lit(0.0)))
    return df.withColumn(c, F.coalesce(F.col(c), F.lit(0.0)))


def dedup_panel(df: DataFrame, key: str = "item_id", ds: str = "ds") -> DataFrame:
    """Drop null keys and keep one row per (item, day), the smallest by its own values."""
    rest = [c for c in df.columns if c not in (key, ds)]
    kept = (df.dropna(subset=[key, ds]).groupBy(key, ds)
            .agg(F.min(F.struct(*rest)).alias("_row")))
    return kept.select(key, ds, *[F.col(f"_row.{c}").alias(c) for c in rest])


def sliding_sequences(df: DataFrame, features: list[str], target: str, steps: int,
                      key: str = "item_id") -> DataFrame:
    """For every day with ``steps`` days before it: those days' feature rows and the target."""
    w = days_of(key).rowsBetween(-steps, -1)
    row = F.array(*[F.col(c).cast("double") for c in features])
    out = df.select(key, "ds", F.collect_list(row).over(w).alias("steps"), F.col(target))
    return out.where(F.size("steps") == steps)


def temporal_split(df: DataFrame, test_days: int = config.TEST_DAYS, train_share: float = 0.8,
                   key: str = "item_id") -> DataFrame:
    """Label rows ``test`` (the item's last days), else ``train`` or ``validation`` by order."""
    w = days_of(key)
    size = F.count(F.lit(1)).over(Window.partitionBy(*([key] if isinstance(key, str) else key)))
    # Count from a frame of the shared window so no second sort is needed.
    pos, left = F.row_number().over(w), size - test_days
    return df.withColumn(
        "part", F.when(pos > left, "test")
        .when(pos <= F.floor(left * F.lit(train_share)), "train").otherwise("validation"))
