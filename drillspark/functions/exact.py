"""Sums and averages that give the same answer whatever the row order.

Adding doubles gives other last digits each time a shuffle delivers rows in another order, or a lost task is run
again. Amounts are therefore counted in whole units of ``10**-places`` and added as integers. The count is split into
a high part and a low part of 20 bits, so that neither sum overflows below 8 * 10**12 rows and a total of 9 * 10**18.

The functions take the name of a column; a computed measure gets a name first, so it is computed once per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PLACES = 6


def _present(column: str) -> str:
    """The value, with NaN as missing."""
    return f"nanvl(CAST(`{column}` AS DOUBLE), CAST(NULL AS DOUBLE))"


def _decimal_sum(column: str, places: int) -> str:
    if not 0 <= places <= PLACES:
        raise ValueError(f"0 to {PLACES} decimal places, not {places}")
    # Infinity has no whole number of units and fails the query.
    units = f"CAST(rint({_present(column)} * {10**places}D) AS BIGINT)"
    high = f"CAST(sum(shiftright({units}, 20)) AS DECIMAL(20,0)) * CAST(1048576 AS DECIMAL(8,0))"
    low = f"CAST(sum({units} & 1048575) AS DECIMAL(20,0))"
    return f"CAST(({high} + {low}) * CAST('1e-{places}' AS DECIMAL({places + 1},{places})) AS DECIMAL(38,{places}))"


def decimal_sum(column: str, places: int = PLACES) -> Column:
    """Sum as DECIMAL(38, places); partial sums of this type add up exactly later."""
    return F.expr(_decimal_sum(column, places))


def exact_sum(column: str, places: int = PLACES) -> Column:
    return F.expr(f"CAST({_decimal_sum(column, places)} AS DOUBLE)")


def exact_avg(column: str, places: int = PLACES) -> Column:
    """Mean over the rows that hold a value; null if none does."""
    return F.expr(f"CAST({_decimal_sum(column, places)} AS DOUBLE) / count({_present(column)})")


def resum(column: str, places: int = PLACES) -> Column:
    """Add up sums that are already aggregated (few rows, large values)."""
    return F.expr(f"CAST(sum(CAST(`{column}` AS DECIMAL(38,{places}))) AS DOUBLE)")
