"""Exact numbers: display intervals, unit scales and reduced fractions.

A displayed number is kept as integers, never as a float:
`value = twice / (2 * 10^digits)` with `twice` DECIMAL(38,0). The half display
step is then exactly one unit of `twice`, so every interval test becomes an
integer comparison after aligning `digits`. A number too long for 38 digits is
null, which callers report as `precision_exceeded`.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimgrove.functions.text import SPACE, let, strip

INTEGER = "decimal(38,0)"
# --- fixed values: accepted number syntax, missing tokens and amount units ------
NUMBER = rf"^([+-]?(?:[0-9]{{1,3}}(?:,[0-9]{{3}})+|[0-9]+)(?:\.[0-9]+)?)(?:[{SPACE}]+(.+))?$"
MISSING_TOKENS = ("", "-", "N/A")
MISSING_AMOUNTS = ("", "-", "N/A", "null", "None")
KRW_UNIT_ZEROS = {
    "": 0,
    "원": 0,
    "krw": 0,
    "천원": 3,
    "백만원": 6,
    "억원": 8,
    "억": 8,
    "조원": 12,
    "조": 12,
}
# --- end of fixed values ----------------------------------------------------------


def power10(digits: Column) -> Column:
    """10^digits as DECIMAL(38,0), null above 37."""
    return F.concat(F.lit("1"), F.repeat(F.lit("0"), digits)).try_cast(INTEGER)


def times(a: Column, b: Column) -> Column:
    """Exact product; null when it does not fit into 38 digits."""
    return F.try_multiply(a.cast(INTEGER), b.cast(INTEGER))


def plus(a: Column, b: Column) -> Column:
    return F.try_add(a.cast(INTEGER), b.cast(INTEGER)).cast(INTEGER)


def number_text(raw: Column) -> Column:
    """Literal number without thousands separators, null for other text."""
    number = F.nullif(
        F.regexp_replace(F.regexp_extract(strip(raw), NUMBER, 1), ",", ""), F.lit("")
    )
    # A text of digits and a point is its own number; it needs one pattern instead of three.
    return F.when(raw.rlike(r"^[+-]?[0-9]+(?:\.[0-9]+)?\z"), raw).otherwise(number)


def in_cell_unit(raw: Column) -> Column:
    return F.nullif(strip(F.regexp_extract(strip(raw), NUMBER, 2)), F.lit(""))


def twice_shown(text: Column) -> Column:
    """Twice the digits of a literal number (see `number_text`) as an integer, null beyond 38 digits."""
    whole = F.translate(text, ".+", "").try_cast(INTEGER)
    return F.try_multiply(whole, F.lit(2).cast(INTEGER)).cast(INTEGER)


def decimals_shown(text: Column) -> Column:
    """Decimals of a literal number (see `number_text`)."""
    return F.length(F.substring_index(F.concat(text, F.lit(".")), ".", 2)) - F.length(F.substring_index(text, ".", 1)) - 1


def display(raw: Column) -> Column:
    """Displayed number -> struct<twice, digits>, null when it is not a number."""

    def parse(text: Column) -> Column:
        return F.struct(twice_shown(text).alias("twice"), decimals_shown(text).alias("digits"))

    return let(
        let(number_text(raw), parse), lambda n: F.when(n["twice"].isNotNull(), n)
    )


def display_interval(raw: Column, decimals: int = 10) -> Column:
    """Closed interval `value ± half display step` as struct<lo, hi> of DECIMAL.

    Null when the number needs more than `decimals` places or 38 digits.
    """

    def interval(number: Column) -> Column:
        places = number["digits"] + 1

        def bound(step: int) -> Column:
            # (twice ± 1) / (2 * 10^digits) = 5 * (twice ± 1) / 10^(digits + 1)
            def place(scaled: Column) -> Column:
                digits = F.lpad(F.abs(scaled).cast("string"), 39, "0")
                return F.concat(
                    F.when(scaled < 0, F.lit("-")).otherwise(F.lit("")),
                    F.substring(digits, F.lit(1), 39 - places),
                    F.lit("."),
                    F.substring(digits, 40 - places, places),
                )

            text = let(times(number["twice"] + F.lit(step), F.lit(5)), place)
            return F.when(places <= decimals, text.try_cast(f"decimal(38,{decimals})"))

        return F.struct(bound(-1).alias("lo"), bound(1).alias("hi"))

    return let(
        let(display(raw), interval),
        lambda i: F.when(i["lo"].isNotNull() & i["hi"].isNotNull(), i),
    )


def shift_decimal(text: Column, zeros: Column) -> Column:
    """Multiply a plain decimal text by 10^zeros, keeping its displayed digits.

    Works on the text, so the number of digits is not limited by any type.
    """
    def place(parts: Column) -> Column:
        coefficient, digits = parts["coefficient"], parts["digits"]
        cut = F.length(coefficient) - digits
        whole = F.regexp_replace(F.substring(coefficient, F.lit(1), cut), "^0+(?=[0-9])", "")
        return F.concat(
            F.when(parts["negative"], F.lit("-")).otherwise(F.lit("")),
            F.coalesce(F.nullif(whole, F.lit("")), F.lit("0")),
            F.when(
                digits > 0, F.concat(F.lit("."), F.substring(coefficient, cut + 1, digits))
            ).otherwise(F.lit("")),
        )

    def split(t: Column) -> Column:
        body = F.regexp_replace(t, "^[+-]", "")
        return F.struct(
            F.concat(
                F.replace(body, F.lit("."), F.lit("")), F.repeat(F.lit("0"), zeros)
            ).alias("coefficient"),
            F.length(F.regexp_extract(body, r"\.([0-9]*)$", 1)).alias("digits"),
            t.startswith("-").alias("negative"),
        )

    return let(let(text, split), lambda parts: F.when(parts["coefficient"].isNotNull(), place(parts)))


def normalize_value(raw: Column, unit: Column) -> Column:
    """Cell text and header unit -> struct<value, unit, multiplier, state>.

    state is value | missing | unreadable | conflict; a missing token is never zero.
    """
    parts = F.struct(
        strip(raw).alias("raw"),
        number_text(raw).alias("number"),
        in_cell_unit(raw).alias("cell"),
        F.nullif(unit, F.lit("")).alias("named"),
    )

    def decide(p: Column) -> Column:
        effective = F.coalesce(p["cell"], p["named"])
        thousand = F.coalesce(effective.startswith("천 "), F.lit(False))
        conflict = F.coalesce(p["cell"] != p["named"], F.lit(False))
        state = (
            F.when(conflict, F.lit("conflict"))
            .when(F.upper(p["raw"]).isin(*MISSING_TOKENS), F.lit("missing"))
            .when(p["number"].isNull(), F.lit("unreadable"))
            .otherwise(F.lit("value"))
        )
        canonical = F.when(thousand, strip(F.substring(effective, 3, 1 << 20))).otherwise(effective)
        return F.struct(
            F.when(state == "value", p["number"]).alias("number"),
            F.when(conflict, p["named"]).otherwise(canonical).alias("unit"),
            F.when(thousand & ~conflict, F.lit("1000")).otherwise(F.lit("1")).alias("multiplier"),
            state.alias("state"),
        )

    return let(
        let(parts, decide),
        lambda d: F.struct(
            shift_decimal(
                d["number"], F.when(d["multiplier"] == "1000", F.lit(3)).otherwise(F.lit(0))
            ).alias("value"),
            d["unit"].alias("unit"),
            d["multiplier"].alias("multiplier"),
            d["state"].alias("state"),
        ),
    )


def normalize_amount(raw: Column, currency: Column, unit: Column) -> Column:
    """Currency amount -> struct<normalized, state>.

    state is value | missing | unit_unknown | amount_invalid. Commas go, an
    amount in parentheses is negative, KRW units scale exactly.
    """
    scales = F.create_map(*[x for k, v in KRW_UNIT_ZEROS.items() for x in (F.lit(k), F.lit(v))])

    def zeros_of(clean: Column) -> Column:
        krw = F.coalesce(F.try_element_at(scales, clean), F.try_element_at(scales, F.lower(clean)))
        other = F.when((clean == "") | (F.lower(clean) == F.lower(currency)), F.lit(0))
        return F.when(F.upper(currency) == "KRW", krw).otherwise(other)

    def signed(plain: Column) -> Column:
        inner = F.regexp_extract(plain, r"(?s)^\((.*)\)$", 1)
        return F.when(
            plain.startswith("(") & plain.endswith(")"), F.concat(F.lit("-"), strip(inner))
        ).otherwise(plain)

    parts = F.struct(
        strip(raw).alias("text"),
        let(F.replace(strip(raw), F.lit(","), F.lit("")), signed).alias("signed"),
        let(strip(F.coalesce(unit, F.lit(""))), zeros_of).alias("zeros"),
    )

    def decide(p: Column) -> Column:
        valid = p["signed"].rlike(r"^[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)$")
        state = (
            F.when(p["zeros"].isNull(), F.lit("unit_unknown"))
            .when(p["text"].isNull() | p["text"].isin(*MISSING_AMOUNTS), F.lit("missing"))
            .when(valid, F.lit("value"))
            .otherwise(F.lit("amount_invalid"))
        )
        return F.struct(
            F.when(state == "value", p["signed"]).alias("signed"),
            p["zeros"].alias("zeros"),
            state.alias("state"),
        )

    return let(
        let(parts, decide),
        lambda d: F.struct(
            shift_decimal(d["signed"], F.coalesce(d["zeros"], F.lit(0))).alias("normalized"),
            d["state"].alias("state"),
        ),
    )


def decimal_text(units: Column, places: Column) -> Column:
    """Shortest decimal text of units / 10^places, for at least one place."""
    digits = F.abs(units).cast("string")
    padded = F.concat(F.repeat(F.lit("0"), places + 1 - F.length(digits)), digits)
    cut = F.length(padded) - places
    body = F.concat(F.substring(padded, F.lit(1), cut), F.lit("."), F.substring(padded, cut + 1, places))
    sign = F.when(units < 0, F.lit("-")).otherwise(F.lit(""))
    return F.concat(sign, F.rtrim(F.rtrim(body, F.lit("0")), F.lit(".")))


def _terminating(n: int, d: int) -> str | None:
    """Decimal text of the reduced fraction n / d, null when it does not end."""
    digits, rest = 0, d
    while rest % 10 == 0:
        rest, digits = rest // 10, digits + 1
    for factor in (2, 5):
        while rest % factor == 0:
            rest, digits = rest // factor, digits + 1
    if rest != 1:
        return None
    while digits and (n * 10 ** (digits - 1)) % d == 0:
        digits -= 1
    whole = abs(n) * 10**digits // d
    text = str(whole).rjust(digits + 1, "0")
    cut = len(text) - digits
    body = text[:cut] + ("." + text[cut:] if digits else "")
    return ("-" if n < 0 else "") + body


@F.pandas_udf(
    T.StructType(
        [T.StructField(n, T.StringType()) for n in ("decimal", "numerator", "denominator")]
    )
)
def _reduce(numerator: pd.Series, denominator: pd.Series, long_numerator: pd.Series, long_denominator: pd.Series) -> pd.DataFrame:
    from math import gcd

    n, d = numerator.to_numpy(), denominator.to_numpy()
    out = np.full((3, len(n)), None, dtype=object)
    short = np.flatnonzero((d != 0) & (np.minimum(n, d) > np.iinfo(np.int64).min))
    a, b = np.where(d[short] < 0, -n[short], n[short]), np.abs(d[short])
    common = np.gcd(a, b)
    a, b = a // common, b // common
    rest = b // (b & -b)
    while (fives := rest % 5 == 0).any():
        rest[fives] //= 5
    ends = rest == 1
    out[0, short[ends]] = [_terminating(x, y) for x, y in zip(a[ends].tolist(), b[ends].tolist())]
    out[1, short[~ends]] = [str(x) for x in a[~ends].tolist()]
    out[2, short[~ends]] = [str(x) for x in b[~ends].tolist()]
    for i in np.flatnonzero(long_denominator.notna().to_numpy()):
        x, y = int(long_numerator[i]), int(long_denominator[i])
        if y < 0:
            x, y = -x, -y
        g = gcd(x, y)
        x, y = x // g, y // g
        text = _terminating(x, y)
        out[:, i] = (text, None, None) if text is not None else (None, str(x), str(y))
    return pd.DataFrame(dict(zip(("decimal", "numerator", "denominator"), out)))


def reduce_fraction(numerator: Column, denominator: Column) -> Column:
    """Exact decimal text, or the reduced pair when the quotient does not terminate.

    Numbers of 64 bits are reduced many at a time, only longer ones one by one.
    """
    n, d = numerator.cast(INTEGER), denominator.cast(INTEGER)
    some = n.isNotNull() & (d != 0)
    least = F.lit(-(2**63))
    short = (F.least(n, d) > least) & (F.greatest(n, d) < F.lit(2**63 - 1))
    part = lambda c: F.coalesce(F.when(some & short, c.try_cast("bigint")), F.lit(0).cast("bigint"))
    return _reduce(part(n), part(d), F.when(some & ~short, n), F.when(some & ~short, d))
