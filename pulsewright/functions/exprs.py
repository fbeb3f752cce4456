"""Scalar and array expressions shared by the operators; all are built-in Catalyst expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once a row: inside another lambda it would be computed for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def safe_ratio(num: str | Column, den: str | Column) -> Column:
    """num / den where den is positive, else null (a bare division raises under ANSI rules)."""
    return F.when(col(den) > 0, col(num) / col(den))


def clip(x: str | Column, low: float | None = None, high: float | None = None) -> Column:
    """Clip that keeps nulls (greatest and least skip them)."""
    x = col(x)
    out = x
    if low is not None:
        out = F.greatest(out, F.lit(low))
    if high is not None:
        out = F.least(out, F.lit(high))
    return F.when(x.isNotNull(), out)


def nan_to_null(x: str | Column) -> Column:
    """Comparisons hold NaN greater than anything, so it must not survive a source."""
    return F.when(~F.isnan(col(x)), col(x))


def array_median(a: str | Column) -> Column:
    """Median of an array's non-null elements; the mean of the middle two if their number is even. Null for none."""
    s = F.array_sort(F.array_compact(col(a)))
    n = F.size(s)
    # try_element_at is one-based; positions of the two middles
    lo, hi = F.floor((n + 1) / 2).cast("int"), (F.floor(n / 2) + 1).cast("int")
    return F.when(n > 0, (F.try_element_at(s, lo) + F.try_element_at(s, hi)) / 2.0)


def first_argmax(names: Sequence[str], values: Sequence[Column]) -> Column:
    """Name of the largest value; the first of equals; null if all are null."""
    a = F.array(*values)
    at = F.array_position(a, F.array_max(a))
    return F.when(at > 0, F.try_element_at(F.array(*[F.lit(n) for n in names]), at.cast("int")))


Shift = tuple[str, int, int]
# The assumed schedule of three shifts of eight hours.
DEFAULT_SHIFTS: tuple[Shift, ...] = (("Shift 1 (06-14)", 6, 14), ("Shift 2 (14-22)", 14, 22), ("Shift 3 (22-06)", 22, 6))


def shift_label(hour: str | Column, shifts: Iterable[Shift] = DEFAULT_SHIFTS) -> Column:
    """Label of the first shift [start, end) that holds the hour, over midnight if start > end; else Unassigned."""
    h = col(hour)

    def holds(a: int, b: int) -> Column:
        return (h >= a) & (h < b) if a < b else ((h >= a) | (h < b)) if a > b else F.lit(False)

    return reduce(lambda rest, s: F.when(holds(s[1], s[2]), F.lit(s[0])).otherwise(rest), reversed(list(shifts)), F.lit("Unassigned"))


def in_any(t: str | Column, intervals: Iterable[tuple]) -> Column:
    """Whether t lies in one of the closed intervals."""
    return reduce(lambda a, b: a | b, [col(t).between(lo, hi) for lo, hi in intervals], F.lit(False))


def register(spark: SparkSession) -> None:
    """value_of_warning and shift_label as SQL functions (Catalyst macros, not user code)."""
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION value_of_warning(lead DOUBLE, needed DOUBLE, full_value DOUBLE, expedited DOUBLE) RETURNS DOUBLE "
        "RETURN CASE WHEN lead IS NULL OR isnan(lead) OR lead <= 0 OR lead = double('infinity') THEN 0D WHEN lead >= needed THEN full_value ELSE expedited END"
    )
    cases = " ".join(f"WHEN {'h >= %d AND h < %d' % (a, b) if a < b else 'h >= %d OR h < %d' % (a, b)} THEN '{name}'" for name, a, b in DEFAULT_SHIFTS)
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION shift_label(h INT) RETURNS STRING RETURN CASE {cases} ELSE 'Unassigned' END")
