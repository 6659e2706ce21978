"""The US market calendar as columns: holidays and sessions for any range of years."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def nth_weekday(year: Column, month: int, weekday: int, n: int) -> Column:
    """The n-th weekday (Monday 0) of a month."""
    first = F.make_date(year, F.lit(month), F.lit(1))
    return F.date_add(first, F.pmod(F.lit(weekday) - F.weekday(first), F.lit(7)) + 7 * (n - 1))


def last_weekday(year: Column, month: int, weekday: int) -> Column:
    last = F.last_day(F.make_date(year, F.lit(month), F.lit(1)))
    return F.date_sub(last, F.pmod(F.weekday(last) - F.lit(weekday), F.lit(7)))


def observed(date: Column) -> Column:
    """Saturday moves to Friday, Sunday to Monday."""
    return F.when(F.weekday(date) == 5, F.date_sub(date, 1)).when(F.weekday(date) == 6, F.date_add(date, 1)).otherwise(date)


def easter(year: Column) -> Column:
    """Easter Sunday by the anonymous Gregorian computus."""
    div = lambda a, b: F.floor(a / b).cast("int")
    a, b, c = year % 19, div(year, 100), year % 100
    h = (19 * a + b - div(b, 4) - div(b - div(b + 8, 25) + 1, 3) + 15) % 30
    ell = (32 + 2 * (b % 4) + 2 * div(c, 4) - h - c % 4) % 7
    m = div(a + 11 * h + 22 * ell, 451)
    day = h + ell - 7 * m + 114
    return F.make_date(year, div(day, 31), day % 31 + 1)


def market_holidays(spark: SparkSession, first_year: int, last_year: int) -> DataFrame:
    """date, holiday: one row for each full holiday of those years."""
    y = F.col("year")
    fixed = lambda month, day: observed(F.make_date(y, F.lit(month), F.lit(day)))
    new_year = F.make_date(y, F.lit(1), F.lit(1))
    rules = {
        "new year": F.when(F.weekday(new_year) != 5, observed(new_year)),
        "king": nth_weekday(y, 1, 0, 3),
        "presidents": nth_weekday(y, 2, 0, 3),
        "good friday": F.date_sub(easter(y), 2),
        "memorial": last_weekday(y, 5, 0),
        "juneteenth": F.when(y >= 2022, fixed(6, 19)),
        "independence": fixed(7, 4),
        "labor": nth_weekday(y, 9, 0, 1),
        "thanksgiving": nth_weekday(y, 11, 3, 4),
        "christmas": fixed(12, 25),
    }
    years = spark.range(first_year, last_year + 1).select(F.col("id").cast("int").alias("year"))
    listed = years.select(F.array(*(F.struct(d.alias("date"), F.lit(n).alias("holiday")) for n, d in rules.items())).alias("all"))
    return listed.select(F.explode("all").alias("h")).select("h.*").where("date IS NOT NULL")


def session_ladder(spark: SparkSession, first_year: int, last_year: int) -> DataFrame:
    """date, is_session, n_sessions (up to and with that day): sessions between two days are a difference of two rows."""
    ends = spark.sql(f"SELECT explode(sequence(make_date({first_year}, 1, 1), make_date({last_year}, 12, 31))) AS date")
    days = ends.join(F.broadcast(market_holidays(spark, first_year, last_year)), "date", "left")  # ten rows a year
    session = (F.weekday("date") < 5) & F.col("holiday").isNull()
    return days.select("date", session.alias("is_session"), F.sum(session.cast("int")).over(Window.orderBy("date")).alias("n_sessions"))
