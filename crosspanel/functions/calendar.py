"""Calendar expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def week_ending_friday(date: Column) -> Column:
    """Friday that closes the week of ``date``; Saturday and Sunday roll forward."""
    return F.next_day(F.date_sub(date, 1), "FRI")


def bucket_friday(week_start: Column, bucket_lag: int = 5) -> Column:
    """Friday a Sunday-labelled weekly bucket is attached to.

    The default of 5 days attaches the bucket to the Friday inside it, which
    leaves its Saturday one day in the future; 12 is the point-in-time safe lag.
    """
    return F.date_add(week_start, bucket_lag)
