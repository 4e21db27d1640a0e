"""Date functions as Column expressions: parsing, lags, spans, sequences, month-day keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Accepted date layouts in order of preference; the US layout wins over the European one.
FORMATS = ("yyyy-M-d", "M/d/yyyy", "d/M/yyyy", "MMMM d, yyyy", "MMM d, yyyy", "d-MMM-yyyy", "yyyy/M/d", "d.M.yyyy")


def _date_part(text: Column) -> Column:
    """Drop a time of day after the date."""
    return F.regexp_replace(F.trim(text), r"[T ]\d{1,2}:\d{2}.*$", "")


def parse_date_rowwise(text: Column, formats: tuple[str, ...] = FORMATS) -> Column:
    """Each value by the first layout that fits it; NULL if none does."""
    return F.coalesce(*[F.try_to_date(_date_part(text), f) for f in formats])


def date_format_of(df: DataFrame, text: str, order: str, formats: tuple[str, ...] = FORMATS) -> str | None:
    """The first layout that fits the first non-null value (by ``order``); None if all values are null.

    One aggregate job; raises ValueError if no layout fits.
    """
    first = F.min_by(F.col(text), F.col(order))
    row = df.where(F.col(text).isNotNull()).agg(first.alias("v")).select("v", *[F.try_to_date(_date_part(F.col("v")), f).isNotNull().alias(f"f{i}") for i, f in enumerate(formats)]).first()
    if row["v"] is None:
        return None
    for i, f in enumerate(formats):
        if row[f"f{i}"]:
            return f
    raise ValueError(f"no date layout fits {row['v']!r}")


def parse_date_column(df: DataFrame, text: str, order: str, out: str = "date", formats: tuple[str, ...] = FORMATS) -> DataFrame:
    """The whole column by one layout, chosen by its first non-null value; misfits become NULL."""
    fmt = date_format_of(df, text, order, formats)
    return df.withColumn(out, F.try_to_date(_date_part(F.col(text)), fmt) if fmt else F.lit(None).cast("date"))


def link_date(date: Column, lag: int = 0, grain: str = "day") -> Column:
    """``date`` shifted back by ``lag`` days, or to the first of the month ``lag`` months back."""
    return F.date_sub(date, lag) if grain == "day" else F.to_date(F.add_months(F.trunc(date, "month"), -lag))


def span_start(link: Column, span: int, grain: str = "day") -> Column:
    return F.date_sub(link, span) if grain == "day" else F.to_date(F.add_months(link, -span))


def span_dates(link: Column, span: int, grain: str = "day") -> Column:
    """All dates (or months) from ``span`` before the link date to it, as an array."""
    if span < 0:
        raise ValueError("time_span must not be negative")
    return F.sequence(span_start(link, span, grain), link, F.expr(f"interval 1 {grain}"))


def month_day(date: Column) -> Column:
    return F.date_format(date, "MM-dd")


def leap_days(date: Column) -> Column:
    """How many days called 29 February there were up to a date, since the year 1."""
    year = F.year(date) - F.when(F.month(date) * 100 + F.dayofmonth(date) < 229, 1).otherwise(0)
    return F.floor(year / 4) - F.floor(year / 100) + F.floor(year / 400)


def days_in_month(year: Column, month: Column) -> Column:
    return F.dayofmonth(F.last_day(F.make_date(year, month, F.lit(1))))


def make_dates(df: DataFrame, years: str, months: str, days: str, out: str = "date") -> DataFrame:
    """Cross product of a row's key arrays as dates; impossible combinations are dropped."""
    keys = df.withColumn("_y", F.explode(years)).withColumn("_m", F.explode(months)).withColumn("_d", F.explode(days))
    stamp = F.try_make_timestamp(F.col("_y"), F.col("_m"), F.col("_d"), F.lit(0), F.lit(0), F.lit(0))
    return keys.withColumn(out, F.to_date(stamp)).where(F.col(out).isNotNull()).drop("_y", "_m", "_d")


def distinct_keys(date: Column) -> tuple[Column, Column, Column]:
    """Aggregates: sorted distinct years, months and days as unpadded strings."""
    return tuple(F.sort_array(F.collect_set(f(date))).cast("array<string>") for f in (F.year, F.month, F.dayofmonth))


def hour_names() -> Column:
    """00:00 to 23:00."""
    return F.transform(F.sequence(F.lit(0), F.lit(23)), lambda h: F.format_string("%02d:00", h))


def zone_names() -> Column:
    """utc-12:00 to utc+14:00."""
    return F.transform(F.sequence(F.lit(-12), F.lit(14)), lambda h: F.format_string("utc%+03d:00", h))
