"""One value, many notations: keys, uuids, dates, instants, checksums.

All functions take and give columns. A value that cannot be read becomes null and is never an error.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space at either end, no-break space included.
_ENDS = r"^[\s\x{00a0}\x{feff}]+|[\s\x{00a0}\x{feff}]+$"


def stripped(c: Column) -> Column:
    """Without white space at the ends; blank becomes null."""
    s = F.regexp_replace(c.cast("string"), _ENDS, "")
    return F.when(s != "", s)


def uuid_key(c: Column) -> Column:
    """Unpadded and in lower case; blank becomes null."""
    return F.lower(stripped(c))


def checksum_value(c: Column) -> Column:
    """The digest in lower case without padding and without a leading algorithm name (`md5:`)."""
    s = F.regexp_replace(F.lower(stripped(c)), r"^[a-z0-9_-]+:\s*", "")
    return F.when(s != "", s)


def date_value(c: Column) -> Column:
    """A date from `2024-01-31`, `31.1.2024`, `20240131` or an ISO instant; else null."""
    s = stripped(c)
    iso = F.regexp_extract(s, r"^(\d{4}-\d{1,2}-\d{1,2})(?:$|[T ])", 1)
    dotted = F.regexp_extract(s, r"^(\d{1,2}\.\d{1,2}\.\d{4})(?:$|\s)", 1)
    packed = F.regexp_extract(s, r"^(\d{8})$", 1)
    return F.coalesce(
        F.try_to_date(F.when(iso != "", iso), "yyyy-M-d"),
        F.try_to_date(F.when(dotted != "", dotted), "d.M.yyyy"),
        F.try_to_date(F.when(packed != "", packed), "yyyyMMdd"),
    )


def instant_micros(c: Column) -> Column:
    """Microseconds since 1970 of a written instant: ISO with `T` or blank, with offset, `Z` or neither (then UTC);
    `31.1.2024 10:00`; digits only are milliseconds since 1970. Else null. Independent of the session's time zone."""
    s = stripped(c)
    millis = F.when(s.rlike(r"^\d+$"), s).try_cast("bigint")
    iso = F.regexp_replace(s, r"^(\d{1,2})\.(\d{1,2})\.(\d{4})", "$3-$2-$1")
    dated = F.when(iso.rlike(r"^\d{4}-\d{1,2}-\d{1,2}($|[T ])"), iso)
    full = F.when(dated.rlike(r"^[\d-]+$"), F.concat(dated, F.lit(" 00:00:00"))).otherwise(dated)
    zoned = F.when(full.rlike(r"[:\d]\s*(Z|z|[+-]\d{2}:?\d{0,2})$"), full).otherwise(F.concat(full, F.lit("Z")))
    return F.coalesce(
        F.when(F.abs(millis) < F.lit(10**15), millis * 1000), F.unix_micros(zoned.try_cast("timestamp"))
    )


def ntz_micros(c: Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone that means UTC, independent of the session's time zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), c.cast("timestamp_ntz"))


def month_of_micros(c: Column) -> Column:
    """`2024-01` of microseconds since 1970, in UTC."""
    days = F.floor(c / F.lit(86_400_000_000)).cast("int")
    return F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), days), "yyyy-MM")
