"""Wall-clock arithmetic that no session time zone enters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400_000_000


def wall_micros(value: Column) -> Column:
    """Microseconds from 1970-01-01 00:00 on the clock that ``value`` was read from; clock changes do not count."""
    time = value.cast("timestamp_ntz")
    second = (F.extract(F.lit("SECOND"), time) * 1_000_000).cast("bigint")
    minutes = (F.hour(time) * 60 + F.minute(time)).cast("bigint")
    return F.unix_date(time.cast("date")).cast("bigint") * DAY + minutes * 60_000_000 + second
