"""Formats of logs and reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def format_time(seconds: Column) -> Column:
    """'H hr M min' from an hour on, else 'M min S sec'; parts of a second are cut off."""
    s = F.floor(seconds)
    h, m = F.floor(s / 3600), F.pmod(F.floor(s / 60), F.lit(60))
    with_hours = F.concat(h.cast("string"), F.lit(" hr "), m.cast("string"), F.lit(" min"))
    without = F.concat(m.cast("string"), F.lit(" min "), F.pmod(s, F.lit(60)).cast("string"), F.lit(" sec"))
    return F.when(h > 0, with_hours).otherwise(without)


def grouped_number(n: Column) -> Column:
    return F.format_number(n, 0)
