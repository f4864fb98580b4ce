"""Helpers shared by the query sections."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.session import apply_defaults

QUERIES: dict = {}
ORACLE: dict = {}


def query(key: str, oracle: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` with its SQL twin."""
    def add(fn):
        def run(spark, sf_dir):
            return fn(apply_defaults(spark), sf_dir)
        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        QUERIES[key] = run
        if oracle is not None:
            ORACLE[key] = oracle
        return run
    return add


def rounded(df: DataFrame, digits: int, *cols: str) -> DataFrame:
    """Round figures whose last digits depend on summation order."""
    return df.withColumns({c: F.round(c, digits) for c in cols})


def r(digits: int, **exprs: str) -> str:
    """``round(expr, digits) AS name`` for a SELECT list."""
    return ", ".join(f"round({e}, {digits}) AS {n}" for n, e in exprs.items())
