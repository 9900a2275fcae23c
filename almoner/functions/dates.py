"""ISO weeks and periods in file names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .nulls import col

# Month names.
MONTHS = ["január", "február", "március", "április", "május", "június", "július", "augusztus", "szeptember", "október", "november", "december"]


def weeks_in_year(year: Column | str) -> Column:
    """52 or 53: the week of December 28."""
    return F.weekofyear(F.make_date(col(year), F.lit(12), F.lit(28)))


def iso_monday(year: Column | str, week: Column | str) -> Column:
    """The Monday of an ISO week; NULL if the year has no such week."""
    y, w = col(year).cast("int"), col(week).cast("int")
    first = F.date_trunc("week", F.make_date(y, F.lit(1), F.lit(4))).cast("date")
    return F.when(w.between(1, weeks_in_year(y)), F.date_add(first, 7 * (w - 1)))


def iso_year(x: Column | str) -> Column:
    return F.extract(F.lit("YEAROFWEEK"), col(x).cast("date")).cast("int")


def week_calendar(spark: SparkSession, start: str, until: str) -> DataFrame:
    """iso_year, iso_week, period_start and period_end of every week from the one that holds start to until."""
    days = spark.range(1).select(F.explode(F.sequence(F.date_trunc("week", F.lit(start).cast("date")).cast("date"), F.lit(until).cast("date"), F.expr("interval 7 days"))).alias("period_start"))
    return days.select(iso_year("period_start").alias("iso_year"), F.weekofyear("period_start").alias("iso_week"), "period_start", F.date_add("period_start", 6).alias("period_end"))


def period_of(name: Column | str) -> Column:
    """The month a file's name tells: 2024_03, 2024.03, 202403; else a month's name and the year; else January."""
    x = F.lower(col(name))
    year = F.regexp_extract(x, r"(20\d\d)", 1)
    digits = F.regexp_extract(x, r"20\d\d[._]?(0[1-9]|1[0-2])", 1)
    named = F.lit(None).cast("int")
    for i, m in reversed(list(enumerate(MONTHS, 1))):
        named = F.when(F.contains(x, F.lit(m)), F.lit(i)).otherwise(named)
    month = F.coalesce(F.when(digits != "", digits.cast("int")), named, F.lit(1))
    return F.when(year != "", F.make_date(F.nullif(year, F.lit("")).cast("int"), month, F.lit(1)))
