"""The row at a given rank of an order, found without sorting the table.

One column after the other is settled.  A number is bracketed: a mergeable
quantile sketch names two values around the wanted rank, one count says how many
rows lie below and between them, and the search goes on between them.  A text is
taken two bytes at a time: a histogram of the next two bytes (at most 65,537
cells) says in which cell the rank lies.  Both shrink the rows in question by
orders of magnitude with each pass, and a pass is an aggregate: no row is moved
until at most SMALL of them are left, and only those are sorted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import FractionalType, NumericType, StringType

from conflictlake.operators.stored import Stored

SMALL = 10_000
ACCURACY = 10_000  # of the quantile sketch: a rank is off by at most rows / ACCURACY


def _sorted(df: DataFrame, col: str, k: int):
    """Value at rank ``k`` of at most SMALL rows."""
    return df.select(col).orderBy(col).offset(k).limit(1).first()[0]


def _number(df: DataFrame, col: str, n: int, k: int):
    rows = df
    if isinstance(df.schema[col].dataType, FractionalType):
        rows = df.where(~F.isnan(F.col(col).cast("double")))
        n = rows.count()
        if k >= n:
            return float("nan")
    while n > SMALL:
        near = [min(max((k + off * 2 * n / ACCURACY) / n, 0.0), 1.0) for off in (-1, 1)]
        lo, hi = rows.agg(F.percentile_approx(col, near, ACCURACY)).first()[0]
        c = F.col(col)
        below, among, above_lo = rows.agg(F.count_if(c < lo), F.count_if(c.between(lo, hi)), F.min(F.when(c > lo, c))).first()
        if k < below:
            rows, n = rows.where(c < lo), below
        elif k >= below + among:
            rows, n, k = rows.where(c > hi), n - below - among, k - below - among
        else:
            rows, k = rows.where(c.between(lo, hi)), k - below
            if lo == hi:
                return lo
            if among == n:  # the sketch could not tell them apart: the least value by itself
                least = rows.agg(F.count_if(c == lo)).first()[0]
                if k < least:
                    return lo
                rows, k, among = rows.where(c >= above_lo), k - least, among - least
            n = among
    return _sorted(rows, col, k)


def _text(df: DataFrame, col: str, n: int, k: int):
    rows, at = df, 1
    digits = F.hex(F.encode(F.col(col), "UTF-8"))  # bytes in hex sort like the text
    while n > SMALL:
        cell = F.substring(digits, at, 4)
        cells = sorted((r[0], r[1]) for r in rows.groupBy(cell.alias("cell")).agg(F.count(F.lit(1))).collect())  # 65,537 at most
        for name, size in cells:
            if k < size:
                break
            k -= size
        rows, n, at = rows.where(cell == name), size, at + 4
        if len(name) < 4:  # the texts end here and are all the same
            return rows.select(col).first()[0]
    return _sorted(rows, col, k)


def _compare(col: str, value) -> tuple[F.Column, F.Column, F.Column]:
    """Whether a column is less than, equal to, greater than a value (NaN is the greatest number)."""
    c = F.col(col)
    if value != value:
        nan = F.isnan(c.cast("double"))
        return ~nan, nan, F.lit(False)
    return c < F.lit(value), c == F.lit(value), c > F.lit(value)


def nth(df: DataFrame, order: list[tuple[str, bool]], k: int) -> tuple[Row, int] | None:
    """The row of the order columns at rank ``k`` (0-based), and how many rows come before the first such row.

    ``order``: (column, descending); numbers (NaN is the greatest) or texts, without
    nulls.  The frame is read a few times, so it should be a stored one
    or a scan.  None if the frame has no more than ``k`` rows.
    """
    n = df.count()
    if not 0 <= k < n:
        return None
    rows, found, before = df.select(*[c for c, _ in order]), [], 0
    for col, falls in order:
        kind = rows.schema[col].dataType
        find = _text if isinstance(kind, StringType) else _number if isinstance(kind, NumericType) else None
        if find is None:
            raise TypeError(f"{col}: neither a number nor a text")
        value = find(rows, col, n, n - 1 - k if falls else k)
        less, equal, more = _compare(col, value)
        first, same = rows.agg(F.count_if(more if falls else less), F.count_if(equal)).first()
        found.append(value)
        rows, n, k, before = rows.where(equal), same, k - first, before + first
    return Row(*[c for c, _ in order])(*found), before


def _from(order: list[tuple[str, bool]], bound: Row, upto: bool) -> F.Column:
    """Whether a row stands at or after ``bound`` in the order (``upto``: at or before)."""
    cond = F.lit(True)
    for (col, falls), value in reversed(list(zip(order, bound))):
        less, equal, more = _compare(col, value)
        cond = (less if falls != upto else more) | (equal & cond)
    return cond


def rank_slice(df: DataFrame, order: list[tuple[str, bool]], start: int, n: int) -> DataFrame:
    """Rows ``start .. start + n - 1`` of the order: only rows between the two bounds are sorted."""
    keys = Stored(df.select(*[c for c, _ in order]), "slice-keys")
    first = nth(keys.df, order, start) if n > 0 else None
    if first is None:
        keys.delete()
        return df.limit(0)
    last = nth(keys.df, order, start + n - 1)
    keys.delete()
    rows = df.where(_from(order, first[0], False))
    if last is not None:
        rows = rows.where(_from(order, last[0], True))
    by = [F.desc(c) if falls else F.asc(c) for c, falls in order]
    return rows.orderBy(*by).offset(start - first[1]).limit(n)
