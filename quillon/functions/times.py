"""Times written as text, parsed and printed without regard to the session's zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DATE = r"^\d{4}-\d{2}-\d{2}$"
_PLAIN = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d{1,6})?(?:Z|[+-]\d{2}:\d{2})?$"
_STAMP = r"^(\d{4}-\d{2}-\d{2})[T ](\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?)\s*(Z|z|[+-]\d{2}(?::?\d{2})?)?$"


def parse_micros(text: Column) -> Column:
    """Microseconds since 1970 UTC of a text time, NULL if it can't be read.

    Read are: an ISO date with ``T`` or a blank before the time, optional seconds and fractions, optional ``Z`` or
    offset (none means UTC); a date alone (midnight); digits alone with an optional sign (epoch seconds)."""
    t = F.trim(text)
    zone = F.regexp_extract(t, _STAMP, 3)
    hours = F.regexp_extract(zone, r"^([+-]\d{2})", 1)
    minutes = F.regexp_extract(zone, r"^[+-]\d{2}:?(\d{2})$", 1)
    offset = F.when(F.upper(zone).isin("", "Z"), F.lit("+00:00")).otherwise(
        F.concat(hours, F.lit(":"), F.when(minutes == "", F.lit("00")).otherwise(minutes))
    )
    stamp = F.concat(F.regexp_extract(t, _STAMP, 1), F.lit("T"), F.regexp_extract(t, _STAMP, 2), offset)
    # the usual forms are told by one pattern and read as they are
    zoned = F.endswith(t, F.lit("Z")) | F.substring(t, -6, 1).isin("+", "-")
    return (
        F.when(t.rlike(_PLAIN), F.unix_micros(F.when(zoned, t).otherwise(F.concat(t, F.lit("Z"))).try_cast("timestamp")))
        .when(t.rlike(r"^[+-]?\d{1,12}$") & ~t.rlike(_DATE), t.try_cast("bigint") * F.lit(1_000_000))
        .when(t.rlike(_DATE), F.unix_micros(F.concat(t, F.lit("T00:00:00+00:00")).try_cast("timestamp")))
        .when(t.rlike(_STAMP), F.unix_micros(stamp.try_cast("timestamp")))
    )


def format_seconds(micros: Column) -> Column:
    """``2025-01-31T08:00:00Z`` for microseconds since 1970 UTC; fractions are cut; NULL stays NULL."""
    seconds = F.floor(micros / F.lit(1_000_000)).cast("bigint")
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / F.lit(86400)).cast("int")).cast("string")
    rest = F.pmod(seconds, F.lit(86400)).cast("int")
    clock = F.format_string("%02d:%02d:%02d", (rest / 3600).cast("int"), F.pmod((rest / 60).cast("int"), F.lit(60)), F.pmod(rest, F.lit(60)))
    return F.when(micros.isNotNull(), F.concat(day, F.lit("T"), clock, F.lit("Z")))
