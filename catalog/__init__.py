"""Every operator as a query over the test tables, with a SQL twin where one exists."""

from catalog import (  # noqa: F401
    aggregates, analyses, cleaning, forecasting, inventory, joins, sources, windows)
from catalog.base import ORACLE, QUERIES  # noqa: F401
