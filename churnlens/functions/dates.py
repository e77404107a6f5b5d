"""Date and time expressions (all JVM-side, codegen friendly)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_timestamp(c, fmt: str = TIMESTAMP_FORMAT) -> Column:
    """Text → timestamp_ntz; unparsable text becomes null (never an error)."""
    return F.try_to_timestamp(_c(c), F.lit(fmt)).cast("timestamp_ntz")


def month_start(c) -> Column:
    """First day of the month as a DATE (``trunc`` keeps timestamp_ntz zone-free)."""
    return F.trunc(_c(c), "MM")


def month_diff(later, earlier) -> Column:
    """Whole calendar months between two month starts, from year/month parts."""
    later, earlier = _c(later), _c(earlier)
    return ((F.year(later) - F.year(earlier)) * 12
            + (F.month(later) - F.month(earlier))).cast("int")


def elapsed_days(start, end) -> Column:
    """Whole elapsed 24 h periods from ``start`` to ``end`` (47 h → 1)."""
    return F.timestamp_diff("DAY", _c(start), _c(end))


def fractional_days(start, end) -> Column:
    """Elapsed time in days as a double (negative when ``end`` is earlier)."""
    return F.timestamp_diff("MICROSECOND", _c(start), _c(end)).cast("double") / F.lit(86400e6)


def add_days(c, n) -> Column:
    n = F.lit(n) if isinstance(n, int) else _c(n)
    return F.timestamp_add("DAY", n, _c(c))
