"""Date parsing with a list of formats, decided over the whole column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantloom.functions.names import col

# Formats tried in this order.
DATE_FORMATS = (
    "yyyy-MM-dd HH:mm:ss",
    "dd/MM/yyyy HH:mm:ss",
    "MM/dd/yyyy HH:mm:ss",
    "yyyy-MM-dd HH:mm",
    "dd-MM-yyyy HH:mm:ss",
    "yyyy/MM/dd HH:mm:ss",
)
ACCEPT_SHARE = 0.8


def date_value(text, formats=DATE_FORMATS):
    """The first form that reads a text as a timestamp: ISO, then the formats; else NULL."""
    tries = [F.try_to_timestamp(text, F.lit(f)) for f in formats]
    return F.coalesce(text.try_cast("timestamp"), *tries)


def parse_dates(df: DataFrame, column: str = "date", formats=DATE_FORMATS) -> DataFrame:
    """Text to timestamp with the first format that fits over 80 % of the column.

    All formats are tested in one pass.  If none fits, every value takes the first format
    (or ISO form) that reads it; what cannot be read becomes NULL.
    """
    text = F.trim(col(column).cast("string"))
    tries = [F.try_to_timestamp(text, F.lit(f)) for f in formats]
    shares = df.agg(
        *[F.avg(t.isNotNull().cast("double")).alias(f"s{i}") for i, t in enumerate(tries)]
    ).first()
    for share, parsed in zip(shares, tries):
        if share is not None and share > ACCEPT_SHARE:
            return df.withColumn(column, parsed)
    return df.withColumn(column, date_value(text, formats))
