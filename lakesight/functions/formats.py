"""Numbers and times as the serving layer shows them."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def percentage(part: Column, whole: Column) -> Column:
    """``part / whole`` in percent, rounded half up to two decimals."""
    return (F.try_divide(part.cast("double"), whole.cast("double")) * 100).cast("decimal(5,2)")


def mean(total: Column, n: Column) -> Column:
    """An average from an exact sum, so that it does not depend on row order."""
    return F.try_divide(total.cast("double"), n.cast("double"))


def zero_if_null(c: Column) -> Column:
    return F.coalesce(c.cast("double"), F.lit(0.0))


def utc_wall(ts: Column) -> Column:
    """The UTC wall clock of an instant, whatever the session's time zone."""
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), ts.cast("timestamp_ntz"))


def iso_utc(ts: Column) -> Column:
    """ISO-8601 text with a ``Z`` of a UTC wall clock; the fraction is left out when it is zero."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.date_format(ts, "SSSSSS")
    return F.concat(whole, F.when(fraction != "000000", F.concat(F.lit("."), fraction)).otherwise(""), F.lit("Z"))


def interval_minutes(seconds: Column) -> Column:
    """Whole minutes of a schedule interval, at least one."""
    return F.greatest(F.lit(1).cast("long"), F.floor(seconds / 60).cast("long"))


def relative_age(ts: Column, as_of: Column) -> Column:
    """``Just now`` / ``5 minutes ago`` / ``1 hour ago`` / ``3 days ago``."""
    minutes = F.floor((F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))) / 60_000_000)
    hours = F.floor(minutes / 60)
    days = F.floor(hours / 24)

    def label(n: Column, unit: str) -> Column:
        return F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n > 1, "s").otherwise(""), F.lit(" ago"))

    return (
        F.when(minutes < 1, "Just now")
        .when(minutes < 60, label(minutes, "minute"))
        .when(hours < 24, label(hours, "hour"))
        .otherwise(label(days, "day"))
    )


def whole_dollars(c: Column) -> Column:
    """Currency text without cents, halves rounded away from zero."""
    return F.concat(F.when(c < 0, "-").otherwise(""), F.lit("$"), F.format_number(F.round(F.abs(c), 0), 0))
