"""Date dialects.  Each pattern is guarded, since Spark's parser is laxer than the formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, stripped


def _try(c: Column, guard: str, pattern: str) -> Column:
    return F.when(c.rlike(guard), F.try_to_timestamp(c, F.lit(pattern)))


def month_key(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM")


def ofx_timestamp(c: Column) -> Column:
    """8, 12 or 14 digits, an optional fraction and an offset such as [-3:BRT]; UTC without one."""
    shape = r"^(\d{14}|\d{12}|\d{8})(?:\.(\d+))?(?:\[([+-]?\d+(?:\.\d+)?):[^\]]+\])?$"

    def moment(s: Column) -> Column:
        ok = s.rlike(shape)
        base = F.regexp_extract(s, shape, 1)
        at = F.try_to_timestamp(F.rpad(base, 14, "0"), F.lit("yyyyMMddHHmmss"))
        micro = F.rpad(F.left(F.regexp_extract(s, shape, 2), F.lit(6)), 6, "0").cast("long")
        hours = F.coalesce(F.regexp_extract(s, shape, 3).try_cast("double"), F.lit(0.0))
        shifted = F.timestamp_micros(F.unix_micros(at) + micro - (hours * 3_600_000_000).cast("long"))
        return F.when(ok, shifted)

    return let(stripped(c), moment)


def card_date(c: Column) -> Column:
    """dd/MM/yyyy, yyyy-MM-dd, dd-MM-yyyy, dd/MM/yy or yyyy/MM/dd."""
    return F.coalesce(
        _try(c, r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"),
        _try(c, r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
        _try(c, r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-yyyy"),
        _try(c, r"^\d{1,2}/\d{1,2}/\d{2}$", "d/M/yy"),
        _try(c, r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
    )


def statement_date(c: Column, year: int) -> Column:
    """dd/MM/yyyy, dd/MM/yy or dd/MM of the year given; / or - between."""
    full = r"(\d{2})[/\-](\d{2})[/\-](\d{4}|\d{2})"
    short = r"(\d{2})[/\-](\d{2})"

    def day(c: Column) -> Column:
        y = F.regexp_extract(c, full, 3)
        long_year = F.when(F.length(y) == 2, F.concat(F.lit("20"), y)).otherwise(y)
        whole = F.concat_ws("-", long_year, F.regexp_extract(c, full, 2), F.regexp_extract(c, full, 1))
        part = F.concat_ws("-", F.lit(str(year)), F.regexp_extract(c, short, 2), F.regexp_extract(c, short, 1))
        return F.coalesce(
            F.when(c.rlike(full), F.try_to_timestamp(whole, F.lit("yyyy-MM-dd"))),
            F.when(c.rlike(short), F.try_to_timestamp(part, F.lit("yyyy-MM-dd"))),
        ).cast("date")

    return let(c, day)


def model_date(c: Column) -> Column:
    """dd/MM/yyyy, yyyy-MM-dd or dd-MM-yyyy."""
    s = stripped(c)
    return F.coalesce(
        _try(s, r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"), _try(s, r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"), _try(s, r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-yyyy")
    )


def xml_timestamp(c: Column) -> Column:
    """An ISO moment with an offset, one without (UTC), or a day."""
    s = stripped(c)
    return F.coalesce(
        _try(s, r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(Z|[+-]\d{2}:\d{2})$", "yyyy-MM-dd'T'HH:mm:ssXXX"),
        _try(s, r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}[+-]\d{4}$", "yyyy-MM-dd'T'HH:mm:ssXX"),
        _try(s, r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}$", "yyyy-MM-dd'T'HH:mm:ss"),
        _try(s, r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd"),
    )


def day_bounds(c: Column, first: str | None, last: str | None) -> Column:
    """A plain date as upper bound includes the whole day; a timestamp is inclusive itself."""
    keep = F.lit(True)
    if first:
        keep = keep & (c >= F.lit(first).cast("timestamp"))
    if last:
        bound = F.lit(last).cast("timestamp")
        keep = keep & ((c < bound + F.expr("INTERVAL 1 DAY")) if len(last) == 10 else (c <= bound))
    return keep
