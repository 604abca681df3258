"""Column expressions shared by operators (all JVM-side, codegen friendly)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def epoch_us(ts) -> Column:
    """Microseconds since the epoch of a TIMESTAMP_NTZ column (no time zone)."""
    return F.timestamp_diff("MICROSECOND", F.expr(EPOCH), col(ts))


def parse_ts(c, fmt: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """Tolerant timestamp parse: malformed text becomes NULL (the reference raises)."""
    return F.try_to_timestamp(col(c), F.lit(fmt)).cast("timestamp_ntz")


def round_dp(c, places: int) -> Column:
    """Round half away from zero at ``places`` decimals via ``round(x*10^p)/10^p``.

    Rounding the scaled double (instead of its decimal string) makes the
    result a function of the double's exact value, as in most SQL engines.
    """
    scale = float(10 ** places)
    return F.round(col(c) * scale, 0) / scale


def round6(c) -> Column:
    return round_dp(c, 6)


def exact_avg(c, scale: int = 9) -> Column:
    """Mean via an exact DECIMAL sum: independent of partitioning and of the
    order rows arrive in, so repeated runs give the same double."""
    return F.try_divide(F.sum(col(c).cast(f"decimal(38,{scale})")).cast("double"),
                        F.count(col(c)))


def flag(cond: Column) -> Column:
    """Boolean condition as a 0/1 BIGINT feature (NULL counts as 0)."""
    return F.coalesce(cond.cast("long"), F.lit(0).cast("long"))


def is_error(status_code="status_code") -> Column:
    """The base of every error metric: HTTP status >= 400."""
    return col(status_code) >= 400


def hour(ts="ts") -> Column:
    return F.hour(col(ts)).cast("long")


def minute(ts="ts") -> Column:
    return F.minute(col(ts)).cast("long")


def day_of_week(ts="ts") -> Column:
    """Monday = 0 ... Sunday = 6 (``weekday``, not ``dayofweek``)."""
    return F.weekday(col(ts)).cast("long")


def is_peak_hour(ts="ts", start: int = 9, end: int = 17) -> Column:
    return flag(F.hour(col(ts)).between(start, end))


def is_weekend(ts="ts") -> Column:
    return flag(F.weekday(col(ts)) >= 5)


def ip_last_octet(ip="source_ip") -> Column:
    """Integer after the last '.', 0 when missing or not a number."""
    part = F.substring_index(col(ip), ".", -1)
    return F.coalesce(part.try_cast("bigint"), F.lit(0).cast("long"))


def status_class(status_code="status_code") -> Column:
    return (F.floor(col(status_code) / 100) * 100).cast("long")


def pct_1dp(part, whole) -> Column:
    """``round(100 * part / whole, 1)`` computed exactly (HALF_UP).

    Both operands are counts, so ``1000 * part / whole`` is one correctly
    rounded division and rounding it to an integer is unambiguous.
    """
    return F.round(F.try_divide(col(part).cast("double") * 1000.0, col(whole)), 0) / 10.0
