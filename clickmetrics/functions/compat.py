"""Column-expression helpers that give the reference's SQL-dialect semantics.

All are plain Spark ``Column`` expressions: they stay inside whole-stage
codegen and need no Python worker.  Each documents the dialect rule it
reproduces.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str

_UNIT_MICROS = {
    "SECOND": 1_000_000,
    "MINUTE": 60_000_000,
    "HOUR": 3_600_000_000,
    "DAY": 86_400_000_000,
}


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ntz(value: str) -> Column:
    """A ``timestamp_ntz`` literal from text such as ``'2012-06-01'``.

    The reference compares datetimes with text literals (implicit
    conversion).  A typed wall-clock literal keeps the comparison independent
    of the session time zone.
    """
    return F.to_timestamp_ntz(F.lit(value))


def epoch_micros(ts: ColumnOrName) -> Column:
    """Microseconds since 1970-01-01 of a ``timestamp_ntz`` wall-clock value.

    Built from the value's own fields (date, hour, minute, fractional
    second), which never involve a time zone.  ``timestampdiff`` would cast
    to the session-zone ``timestamp`` first and shift wall-clock times that
    fall in that zone's daylight-saving gap.
    """
    t = _col(ts)
    days = F.datediff(F.to_date(t), F.lit("1970-01-01").cast("date")).cast("long")
    secs_frac = F.date_part(F.lit("SECOND"), t)  # decimal(8,6): seconds with microseconds
    return (days * F.lit(86_400_000_000) + F.hour(t).cast("long") * F.lit(3_600_000_000)
            + F.minute(t).cast("long") * F.lit(60_000_000) + (secs_frac * F.lit(1_000_000)).cast("long"))


def time_bucket(ts: ColumnOrName, unit_micros: int) -> Column:
    """Integer bucket number of width ``unit_micros`` for a ``timestamp_ntz``."""
    return floor_div(epoch_micros(ts), unit_micros)


def boundary_diff(unit: str, start: ColumnOrName, end: ColumnOrName) -> Column:
    """``DATEDIFF(unit, start, end)``: number of unit *boundaries crossed*.

    00:00:59 -> 00:01:01 is 1 minute although only 2 seconds elapsed.  Equal
    to the difference of the floored epoch counts.  NULL if either is NULL.
    """
    size = _UNIT_MICROS[unit.upper()]
    return time_bucket(end, size) - time_bucket(start, size)


def week_start(ts: ColumnOrName) -> Column:
    """``DATEADD(WEEK, DATEDIFF(WEEK, 0, d), 0)``.

    Day 0 is Monday 1900-01-01 and DATEDIFF(WEEK) counts Sunday boundaries, so
    Monday..Saturday map to that week's Monday and a Sunday maps to the
    *next* day's Monday.  Result is a midnight ``timestamp_ntz``.
    """
    d = F.to_date(_col(ts))
    return F.trunc(F.date_add(d, 1), "week").cast("timestamp_ntz")


def int_avg(name: str) -> Column:
    """``AVG`` of an integer column: integer result truncated toward zero.

    ``sum div count`` is exact (no double rounding) and yields ``bigint``;
    an empty input gives NULL, as ``AVG`` over no rows does.
    """
    return F.expr(f"sum(`{name}`) div nullif(count(`{name}`), 0)")


def round_half_away(c: ColumnOrName, digits: int = 0) -> Column:
    """``ROUND(x, digits)`` of a double: round the *binary* value scaled by
    ``10^digits`` to the nearest integer, ties away from zero, and scale back.

    Spark's built-in ``round`` on doubles rounds the shortest decimal text
    instead (1.005 -> 1.01 although the stored value is 1.00499...), which
    disagrees with engines that round the scaled binary value in the last
    digit of ~0.03% of ratios.  This form is fixed IEEE arithmetic (multiply,
    round-to-integer, divide), so every engine doing the same steps returns
    the same bits.  ``round(y, 0)`` is exact here: a double prints as ``k.5``
    only if it equals ``k.5``.
    """
    m = F.lit(float(10 ** digits))
    return F.round(_col(c).cast("double") * m, 0) / m


def pct(num: Column, den: Column) -> Column:
    """``CAST(num AS FLOAT) / den * 100`` with a zero denominator giving NULL.

    The reference leaves most ratios unguarded (division error or infinity);
    NULL is the portable choice.  Operation order matches the reference so
    the double result is bit-identical to the SQL form.
    """
    return F.try_divide(num.cast("double"), den.cast("double")) * F.lit(100.0)


def pct_scaled_first(num: Column, den: Column) -> Column:
    """``num * 100.0 / den`` (scale before dividing); zero denominator gives NULL."""
    return F.try_divide(num.cast("double") * F.lit(100.0), den.cast("double"))


def safe_ratio(num: Column, den: Column) -> Column:
    """``CASE WHEN den > 0 THEN CAST(num AS FLOAT) / den ELSE 0 END`` (the guarded form)."""
    return F.when(den > 0, num.cast("double") / den.cast("double")).otherwise(F.lit(0.0))


def label_marker(c: ColumnOrName, marker: str, label: str) -> Column:
    """Replace the text marker (the string ``'NULL'``) by a label; real NULLs stay NULL."""
    c = _col(c)
    return F.when(c == F.lit(marker), F.lit(label)).otherwise(c)


def soundex_difference(a: ColumnOrName, b: ColumnOrName) -> Column:
    """``DIFFERENCE(a, b)``: how many of the 4 SOUNDEX code characters agree (0-4).

    The reference applies it to two integers.  Text without a leading letter
    has SOUNDEX code ``'0000'`` in the reference dialect, whereas Spark's
    ``soundex`` returns such text unchanged, so those are mapped to ``'0000'``.
    """

    def code(c: ColumnOrName) -> Column:
        s = F.soundex(_col(c).cast("string"))
        return F.when(F.substring(s, 1, 1).rlike("^[A-Z]$"), F.rpad(s, 4, "0")).otherwise(F.lit("0000"))

    ca, cb = code(a), code(b)
    agree = [(F.substring(ca, i, 1) == F.substring(cb, i, 1)).cast("int") for i in range(1, 5)]
    return (agree[0] + agree[1] + agree[2] + agree[3]).alias("difference")


def floor_div(x: Column, by: int) -> Column:
    """Floor of ``x / by`` for longs, in integer arithmetic (no double in between)."""
    return F.call_function("div", x - F.pmod(x, F.lit(by)), F.lit(by)).cast("long")
