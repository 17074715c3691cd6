"""Date differences and display formats. Times are shown in the session zone."""

from pyspark.sql import Column, functions as F

MS_PER_DAY = 86_400_000.0


def diff_days(later: Column, earlier: Column) -> Column:
    return (F.unix_millis(later) - F.unix_millis(earlier)) / F.lit(MS_PER_DAY)


def fmt_ym(dt: Column) -> Column:
    return F.date_format(dt, "yyyy-MM")


def fmt_mdwhm(dt: Column) -> Column:
    """``2024  1/05 Fri 09:30``: the month is padded with a blank."""
    return F.concat(F.date_format(dt, "yyyy "), F.lpad(F.date_format(dt, "M"), 2, " "),
                    F.date_format(dt, "/dd EEE HH:mm"))


def fmt_md(dt: Column) -> Column:
    return F.date_format(dt, "M/dd")


def date_parts(dt: Column) -> Column:
    return F.struct(
        F.year(dt).alias("year"), F.month(dt).alias("month"), F.dayofmonth(dt).alias("day"),
        F.date_format(dt, "EEE").alias("weekday"), F.hour(dt).alias("hour"),
        F.minute(dt).alias("minute"),
    )
