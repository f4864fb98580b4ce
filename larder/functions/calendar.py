"""Calendar features of a date column."""

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from larder import config
from larder.functions.cleaning import as_column


def calendar_features(ds="ds") -> dict[str, Column]:
    """Month, weekday (Monday 0) and the seasonal 0/1 flags."""
    d = as_column(ds)
    month, weekday = F.month(d), F.weekday(d)
    return {
        "month": month,
        "day_of_week": weekday,
        "is_weekend": (weekday >= 5).cast("int"),
        "is_wedding_season": month.isin(*config.WEDDING_MONTHS).cast("int"),
        "is_diwali_period": month.isin(*config.DIWALI_MONTHS).cast("int"),
        "is_valentine_month": (month == config.VALENTINE_MONTH).cast("int"),
    }


def month_boundary(ds="ds") -> dict[str, Column]:
    d = as_column(ds)
    return {
        "is_month_start": (F.dayofmonth(d) == 1).cast("int"),
        "is_month_end": (d == F.last_day(d)).cast("int"),
    }


def cyclical_encoding(ds="ds") -> dict[str, Column]:
    """Weekday and month on the unit circle."""
    d = as_column(ds)
    day_angle = F.lit(2 * math.pi) * F.weekday(d) / F.lit(7.0)
    month_angle = F.lit(2 * math.pi) * F.month(d) / F.lit(12.0)
    return {
        "day_of_week_sin": F.sin(day_angle),
        "day_of_week_cos": F.cos(day_angle),
        "month_sin": F.sin(month_angle),
        "month_cos": F.cos(month_angle),
    }
