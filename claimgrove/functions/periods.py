"""Period and date literals. Unknown syntax stays unresolved (null or false)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimgrove.functions.text import SPACE, nfc, strip

_DAY = r"([0-9]{4}-[0-9]{2}-[0-9]{2})"
_S = f"[{SPACE}]"


def _iso(c: Column) -> Column:
    return F.try_to_timestamp(F.nullif(c, F.lit("")), F.lit("yyyy-MM-dd")).cast("date")


def is_supported_period(c: Column) -> Column:
    """Year, FY year, quarter, year range, ISO day or ISO day range."""
    text = strip(c)
    year = F.regexp_extract(
        text, f"(?i)^(?:FY{_S}*)?([0-9]{{4}})(?:년)?(?:{_S}+Q[1-4])?$", 1
    )
    number = lambda digits: F.nullif(digits, F.lit("")).try_cast("int")
    year = number(year)
    span = f"^([0-9]{{4}})년?{_S}*[-–—~]{_S}*([0-9]{{4}})년?$"
    first, last = (number(F.regexp_extract(text, span, k)) for k in (1, 2))
    days = f"^{_DAY}(?:{_S}*(?:~|–|—|to| - ){_S}*{_DAY})?$"
    start_raw = F.regexp_extract(text, days, 1)
    end_raw = F.regexp_extract(text, days, 2)
    start = _iso(start_raw)
    end = F.when(end_raw == "", start).otherwise(_iso(end_raw))
    supported = F.coalesce(
        (year > 0)
        | ((first > 0) & (first <= last))
        | ((start_raw != "") & start.isNotNull() & end.isNotNull() & (start <= end)),
        F.lit(False),
    )
    # A bare year, the common case, needs one pattern instead of six.
    return F.when(c.rlike(r"^[0-9]{4}\z"), c != "0000").otherwise(supported)


def normalize_period(start: Column, end: Column) -> Column:
    """`YYYYMMDD` or `YYYY-MM-DD` pair -> struct of dates, null when invalid or reversed."""

    def day(c: Column) -> Column:
        text = strip(c)
        shape = "^([0-9]{4})-?([0-9]{2})-?([0-9]{2})$"
        return F.when(text.rlike(shape), _iso(F.regexp_replace(text, shape, "$1-$2-$3")))

    lo, hi = day(start), day(end)
    return F.when(lo <= hi, F.struct(lo.alias("start"), hi.alias("end")))


# --- fixed values: explicit day literals and range delimiters -----------------
_DATE_LITERAL = (
    f"(?<![0-9])(?:[0-9]{{4}}년{_S}*[0-9]{{1,2}}월{_S}*[0-9]{{1,2}}일"
    "|[0-9]{4}-[0-9]{2}-[0-9]{2})(?![0-9])"
)
_RANGE_DELIMITER = "(?:~|～|–|—|-|/|부터|to)"
# --- end of fixed values --------------------------------------------------------


def period_from_literal(c: Column) -> Column:
    """Period stated by exactly two explicit days with a range delimiter between them."""
    days = F.regexp_extract_all(c, F.lit(f"({_DATE_LITERAL})"), 1)

    def parse(literal: Column) -> Column:
        numbers = F.regexp_extract_all(literal, F.lit("([0-9]+)"), 1)
        return _iso(
            F.concat_ws(
                "-",
                F.get(numbers, F.lit(0)),
                F.lpad(F.get(numbers, F.lit(1)), 2, "0"),
                F.lpad(F.get(numbers, F.lit(2)), 2, "0"),
            )
        )

    start, end = parse(F.get(days, F.lit(0))), parse(F.get(days, F.lit(1)))
    delimited = c.rlike(
        f"{_DATE_LITERAL}{_S}*{_RANGE_DELIMITER}{_S}*{_DATE_LITERAL}"
    )
    return F.when(
        (F.size(days) == 2) & delimited & (start <= end),
        F.struct(start.alias("start"), end.alias("end")),
    )


def single_year(c: Column) -> Column:
    """`2025`, `2025년` or `2025 년도` -> `2025`; every other text is null."""
    return F.nullif(
        F.regexp_extract(strip(nfc(c)), f"^([0-9]{{4}})(?:년|{_S}*년도)?$", 1), F.lit("")
    )
