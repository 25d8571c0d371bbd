"""Date helpers."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def third_friday(d: Column) -> Column:
    """Third Friday of the month of ``d``."""
    return F.date_add(F.next_day(F.date_sub(F.trunc(d, "month"), 1), "Fri"), 14)
