"""Reusable Column expressions.

Casts are lenient (``try_cast``): bad input becomes NULL instead of stopping a
job, whatever ``spark.sql.ansi.enabled`` says.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values -----------------------------------------------------------
# Dollar value of one unit of each currency; anything else counts as 1.
USD_RATES = {"USD": 1.0, "EUR": 1.1, "GBP": 1.25, "CAD": 0.75, "AUD": 0.65}

EMAIL = r"^[A-Za-z0-9+_.-]+@(.+)$"
PHONE = r"^\+?1?\d{9,15}$"
CUSTOMER_ID = r"^CUST-\d{6}$"
PRODUCT_ID = r"^PROD-\d{6}$"

OPEN_END = date(9999, 12, 31)
# ----------------------------------------------------------------------------


def as_date(day: date | str) -> date:
    return day if isinstance(day, date) else date.fromisoformat(day)


def day_lit(day: date | str) -> Column:
    return F.lit(as_date(day))


def in_days(ts: str | Column, first: date | str, last: date | str) -> Column:
    """``first <= DATE(ts) <= last`` as a half-open range on the raw column.

    Leaving the column bare lets the scan use partition values and row-group
    statistics, which ``DATE(ts) = ...`` would hide.
    """
    c = F.col(ts) if isinstance(ts, str) else ts
    after = as_date(last) + timedelta(days=1)
    return (c >= F.lit(as_date(first)).cast("timestamp")) & (
        c < F.lit(after).cast("timestamp")
    )


def on_day(ts: str | Column, day: date | str) -> Column:
    return in_days(ts, day, day)


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def blank_to_null(name: str) -> Column:
    """Trimmed text, with empty text as NULL."""
    return F.nullif(F.trim(F.col(name)), F.lit(""))


def usd(amount: Column, currency: Column, rates: Mapping[str, float] = USD_RATES) -> Column:
    """Amount in dollars; an unknown or missing currency counts at par."""
    table = F.create_map(*[F.lit(x) for pair in rates.items() for x in pair])
    return amount * F.coalesce(table[currency], F.lit(1.0))


def joined_text(columns: Sequence[str], sep: str = "_", null: str = "NULL") -> Column:
    return F.concat_ws(
        sep, *[F.coalesce(F.col(c).cast("string"), F.lit(null)) for c in columns]
    )


def sha256_key(columns: Sequence[str]) -> Column:
    """SHA-256 of the columns joined by ``_``, NULL written as ``NULL``."""
    return F.sha2(joined_text(columns), 256)


def hash_surrogate(column: str) -> Column:
    """Non-negative 63-bit surrogate key from a business key."""
    return F.xxhash64(F.col(column)).bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF))


def from_map(map_col: str, key: str, dtype: str = "string", default=None) -> Column:
    """A map entry as a typed value, or the default when it is absent or unreadable."""
    value = F.col(map_col)[key]
    value = value if dtype == "string" else value.try_cast(dtype)
    return value if default is None else F.coalesce(value, F.lit(default).cast(dtype))


def customer_from_seller(seller: Column) -> Column:
    """Customer id from the first digit run of a seller id, folded onto 1..100."""
    n = F.regexp_extract(seller, r"(\d+)", 1).try_cast("int") % 100 + 1
    return F.concat(F.lit("CUST-"), F.lpad(n.cast("string"), 6, "0"))


def differs(left: Column, right: Column) -> Column:
    """True when values differ, counting NULL against a value as a difference."""
    return ~left.eqNullSafe(right)


def hours_between(start: Column, end: Column) -> Column:
    """Fractional hours from start to end, exact to the microsecond."""
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(3_600_000_000.0)


def days_before(day: date | str, ts: Column) -> Column:
    return F.date_diff(day_lit(day), F.to_date(ts))


def ratio(part: Column, whole: Column, digits: int) -> Column:
    """Rounded part / whole in double arithmetic; NULL when whole is 0 or NULL."""
    w = whole.cast("double")
    return F.round(F.when(w != 0, part.cast("double") / w), digits)


def exact_mean(total: Column, n: Column, digits: int) -> Column:
    """Decimal total / n, rounded half up in decimal arithmetic; NULL when n is 0."""
    return F.round(total / F.when(n != 0, n), digits)


def severity(status: Column) -> Column:
    """PASS < WARN < FAIL < ERROR (and their long spellings) as a sortable number."""
    order = {"PASS": 0, "PASSED": 0, "SKIPPED": 0, "WARN": 1, "WARNING": 1, "FAIL": 2, "FAILED": 2, "ERROR": 3}
    table = F.create_map(*[F.lit(x) for pair in order.items() for x in pair])
    return table[status]


def lenient_cast(name: str, dtype: T.DataType, actual: T.DataType | None = None) -> Column:
    """The column under its own name in the declared type."""
    c = F.col(name)
    if actual == dtype:
        return c
    return c.try_cast(dtype.simpleString()).alias(name)
