"""Session-time-zone independent time conversions.

The driver tables store event time as ``timestamp_ntz`` holding UTC wall-clock
time.  ``cast('timestamp')`` would reinterpret that wall clock in the session
time zone, so epoch values are built from the fields with an explicit 'UTC'
zone, and local calendar days are derived with ``convert_timezone`` on
``timestamp_ntz`` values, whose formatting does not depend on the session.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_EPOCH_NTZ = "1970-01-01 00:00:00"


def ntz_micros(ts: Column) -> Column:
    """Epoch microseconds of a UTC wall-clock ``timestamp_ntz``."""
    return F.unix_micros(F.make_timestamp(F.year(ts), F.month(ts), F.dayofmonth(ts), F.hour(ts), F.minute(ts),
                                          F.date_part(F.lit("SECOND"), ts), F.lit("UTC")))


def ntz_seconds(ts: Column) -> Column:
    """Epoch seconds (double) of a UTC wall-clock ``timestamp_ntz``."""
    return ntz_micros(ts) / F.lit(1e6)


def micros_to_utc_ntz(us: Column) -> Column:
    """Epoch microseconds -> UTC wall clock as ``timestamp_ntz``."""
    return F.timestamp_add("MICROSECOND", us, F.to_timestamp_ntz(F.lit(_EPOCH_NTZ)))


def local_day(us: Column, tz: str) -> Column:
    """Epoch microseconds -> 'YYYY-MM-DD' of the local calendar day in ``tz``."""
    return F.date_format(F.convert_timezone(F.lit("UTC"), F.lit(tz), micros_to_utc_ntz(us)), "yyyy-MM-dd")
