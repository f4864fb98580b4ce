"""Exact running totals, ranks and quantiles for groups of any size.

A window without a partition key, or over one key that holds a third of the rows, runs in a
single task. Here the rows are range-partitioned by the wanted order instead, so one group may
span many partitions. Each partition's totals are summed first (one row per group and
partition), turned into offsets, and added to the running totals inside the partition.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.session import stage


def running_totals(df: DataFrame, order: list[Column], sums: dict[str, Column],
                   group: tuple[str, ...] = ()) -> DataFrame:
    """Add ``cum_<name>`` (inclusive) and ``total_<name>`` for every entry of ``sums``.

    ``order`` must be a total order inside each group. The partition number is taken after
    the sort and staged, so both branches below see the same split.
    """
    keys = [*group, "_part"]
    rows = df.withColumns({f"_v_{n}": c for n, c in sums.items()})
    rows = stage(
        rows.orderBy(*[F.col(g) for g in group], *order)
        .withColumn("_part", F.spark_partition_id()), "ordered")
    parts = rows.groupBy(*keys).agg(*[F.sum(f"_v_{n}").alias(f"_p_{n}") for n in sums])
    # At most one row per (group, partition): bounded by the number of partitions per group.
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(
        Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)
    offsets = parts.select(
        *keys,
        *[F.coalesce(F.sum(f"_p_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums],
        *[F.sum(f"_p_{n}").over(whole).alias(f"total_{n}") for n in sums],
    )
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    out = rows.join(offsets, keys)
    out = out.withColumns(
        {f"cum_{n}": F.col(f"_o_{n}") + F.sum(f"_v_{n}").over(inside) for n in sums})
    return out.drop("_part", *[f"_v_{n}" for n in sums], *[f"_o_{n}" for n in sums])


def ranked(df: DataFrame, order: list[Column], group: tuple[str, ...] = ()) -> DataFrame:
    """Add ``position`` (1-based) and ``size`` in a total order, over the table or per group."""
    out = running_totals(df, order, {"rows": F.lit(1).cast("bigint")}, group)
    return out.withColumnsRenamed({"cum_rows": "position", "total_rows": "size"})


def quantiles(df: DataFrame, value: str, probs: dict[str, float],
              group: tuple[str, ...] = (), weight: str | None = None, distinct: str | None = None) -> DataFrame:
    """Exact linear-interpolated quantiles per group, whatever the group's size.

    Equal values are counted before the sort, so a heavily repeated value is one row. Use
    ``percentile`` instead where a group is bounded, such as days of one item. ``weight`` names a
    column of counts, where equal values are already counted; ``distinct`` one to add, of the different values.
    """
    number = F.sum(weight) if weight else F.count(F.lit(1))
    counted = (df.where(F.col(value).isNotNull())
               .groupBy(*group, value).agg(number.alias("_n")))
    run = running_totals(counted, [F.col(value)], {"n": F.col("_n")}, group)
    first, past = F.col("cum_n") - F.col("_n"), F.col("cum_n")

    def at(rank: Column) -> Column:
        return F.max(F.when((rank >= first) & (rank < past), F.col(value)))

    aggs = [F.max("total_n").alias("_total")]
    for name, p in probs.items():
        pos = (F.col("total_n") - 1) * F.lit(float(p))
        aggs += [at(F.floor(pos)).alias(f"_lo_{name}"), at(F.ceil(pos)).alias(f"_hi_{name}")]
    if distinct:
        aggs.append(F.count(F.lit(1)).alias(distinct))
    found = run.groupBy(*group).agg(*aggs)
    out = [distinct] if distinct else []
    for name, p in probs.items():
        pos = (F.col("_total") - 1) * F.lit(float(p))
        share = pos - F.floor(pos)
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        out.append((lo + (hi - lo) * share).alias(name))
    return found.select(*group, *out)


def newest(df: DataFrame, keys: list[str], recency: list[Column]) -> DataFrame:
    """One row per key, the greatest by ``recency``.

    ``max_by`` combines on the map side, so a hot key never meets in one task as it would
    with ``row_number``.
    """
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), F.struct(*recency)).alias("_row"))
    return picked.select(*[F.col(k) for k in keys], *[F.col(f"_row.`{c}`").alias(c) for c in rest]
                         ).select(*df.columns)
