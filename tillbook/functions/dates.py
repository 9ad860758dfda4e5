"""Day filters. They leave the column bare so that Parquet can skip by its statistics."""

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Day = str | dt.date


def as_date(day: Day) -> dt.date:
    return day if isinstance(day, dt.date) else dt.date.fromisoformat(day)


def in_days(column: str, first: Day, last: Day) -> Column:
    """Rows from the first day up to and with the last."""
    start = F.lit(as_date(first))
    end = F.lit(as_date(last) + dt.timedelta(days=1))
    return (F.col(column) >= start) & (F.col(column) < end)


def on_day(column: str, day: Day) -> Column:
    return in_days(column, day, day)


def of_days(ledger: DataFrame, first: Day, last: Day) -> DataFrame:
    """Ledger rows created from the first day up to and with the last.

    A ledger stored by day carries ``day``, the day of ``createAt``: bounds on it leave the
    folders of other days unread. The result does not carry it.
    """
    rows = ledger.filter(in_days("createAt", first, last))
    if "day" not in ledger.columns:
        return rows
    return rows.filter(F.col("day").between(F.lit(as_date(first)), F.lit(as_date(last)))).drop("day")
