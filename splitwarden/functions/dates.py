"""Season and display form of a calendar date given as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# First and last month of the wet season.
WET_FROM, WET_TO = 6, 11


def parse_date(text: Column) -> Column:
    """Date of ``YYYY-MM-DD`` text (unpadded parts allowed), NULL for anything else."""
    shaped = F.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), text)
    return F.try_to_timestamp(shaped, F.lit("yyyy-M-d")).cast("date")


def season(text: Column, strict: bool = False) -> Column:
    """wet / dry; bad dates give NULL, or fail the query when ``strict``."""
    month = F.month(parse_date(text))
    value = F.when(month.between(WET_FROM, WET_TO), "wet").when(month.isNotNull(), "dry")
    if not strict:
        return value
    message = F.concat(F.lit("not a YYYY-MM-DD date: "), F.coalesce(text, F.lit("NULL")))
    return F.coalesce(value, F.raise_error(message).cast("string"))


def display_date(text: Column) -> Column:
    """``YYYY-MM-DD`` as ``MM/DD/YYYY``; empty stays empty."""
    part = F.split(text, "-")
    shown = F.concat_ws("/", F.get(part, 1), F.get(part, 2), F.get(part, 0))
    return F.when(F.coalesce(text, F.lit("")) == "", "").otherwise(shown)
