"""Exact order statistics by bracketing, without ranking or sorting all rows.

A wanted row is named by a filter, a column and a 0-based rank in ascending
order (nulls last).  One aggregation with a mergeable quantile sketch brackets
its value; counting what lies below the bracket tells the rank inside it, and
brackets that still hold many rows are narrowed by another sketch over them
alone.  The few rows left are reduced to (value, count) and only those are
put in order.  Every bracket is checked by exact counts, so the sketch's error
costs time, never exactness.  All wanted rows share each pass, and what
reaches the driver is one row for each of them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DateType, NumericType, StringType, TimestampNTZType, TimestampType

#: Rows of a bracket that are reduced and ordered; larger ones are narrowed.
INSIDE = 200_000
#: Points and accuracy of the sketch that narrows a bracket.
GRID = 500
ACCURACY = 5_000


@dataclass
class Wanted:
    """One row: the ``rank``-th of ``column`` among the rows of ``where``.
    ``value`` and ``below`` (rows with a smaller value) are filled in."""

    column: str
    rank: int
    where: Column | None = None
    n: int = 0  # rows of ``where`` whose column is not null
    value: Any = None
    below: int = 0
    low: float | None = None
    high: float | None = None
    inside: int = 0
    ties: int = 0  # rows that share the value
    base: int = 0  # rows below the bracket


def order_number(column: str, dtype: DataType) -> Column | None:
    """A double that never decreases where the column's order increases
    (strings: their first six bytes); None where the type has none."""
    c = F.col(column)
    if isinstance(dtype, NumericType):
        return c.cast("double")
    if isinstance(dtype, DateType):
        return F.unix_date(c).cast("double")
    if isinstance(dtype, TimestampType):
        return F.unix_micros(c).cast("double")
    if isinstance(dtype, TimestampNTZType):
        return F.unix_micros(F.to_utc_timestamp(c, "UTC")).cast("double")
    if isinstance(dtype, StringType):
        head = F.rpad(F.hex(F.substring(F.encode(c, "UTF-8"), 1, 6)), 12, "0")
        return F.when(c.isNotNull(), F.conv(head, 16, 10).cast("double"))
    return None


def orderable(df: DataFrame, columns: Sequence[str]) -> bool:
    return all(order_number(c, df.schema[c].dataType) is not None for c in columns)


def select_ranks(df: DataFrame, wanted: Sequence[Wanted], inside: int | None = None) -> None:
    """Fill in ``value`` and ``below`` of every wanted row.  ``n`` must hold
    the exact number of its filter's non-null rows; ranks from ``n`` on are
    nulls.  ``df`` is read once for each narrowing and once at the end."""
    inside = inside or INSIDE
    todo = []
    for w in wanted:
        if w.rank >= w.n:
            w.value, w.below = None, w.n
        else:
            w.low = w.high = None
            w.base, w.inside = 0, w.n
            todo.append(w)
    if not todo:
        return
    numbers = {c: order_number(c, df.schema[c].dataType) for c in {w.column for w in todo}}

    def held(w: Wanted) -> Column:
        keep = numbers[w.column].isNotNull()
        if w.where is not None:
            keep = keep & w.where
        if w.low is not None:
            keep = keep & (numbers[w.column] >= w.low)
        if w.high is not None:
            keep = keep & (numbers[w.column] <= w.high)
        return keep

    # narrowing: a grid of the rows inside, then exact counts of the new bracket
    while large := [w for w in todo if w.inside > inside and (w.low is None or w.low != w.high)]:
        grid = [i / GRID for i in range(GRID + 1)]
        # one sketch for all ranks of one filter, column and bracket
        kinds = {}
        for w in large:
            kinds.setdefault((w.column, str(w.where), w.low, w.high), w)
        found = df.agg(*[F.percentile_approx(F.when(held(w), numbers[w.column]), grid, ACCURACY).alias(f"g{i}")
                         for i, w in enumerate(kinds.values())]).first()
        grids = {key: found[f"g{i}"] for i, key in enumerate(kinds)}
        tries = []
        for w in large:
            points = grids[(w.column, str(w.where), w.low, w.high)]
            at = (w.rank - w.base) / w.inside * GRID
            tries.append((w, points[max(0, int(at) - 1)], points[min(GRID, int(at) + 2)]))
        counts = df.agg(*[c for i, (w, low, high) in enumerate(tries) for c in (
            F.count_if(F.coalesce(held(w) & (numbers[w.column] < low), F.lit(False))).alias(f"b{i}"),
            F.count_if(F.coalesce(held(w) & numbers[w.column].between(low, high), F.lit(False))).alias(f"i{i}"))]).first()
        moved = False
        for i, (w, low, high) in enumerate(tries):
            below, n = w.base + counts[f"b{i}"], counts[f"i{i}"]
            if below <= w.rank < below + n and n < w.inside:
                w.base, w.inside, w.low, w.high = below, n, low, high
                moved = True
        if not moved:
            break  # nothing left to narrow: one value, or one number for many values
    # wanted rows of one filter, column and bracket are read off one histogram
    kinds = {}
    for w in todo:
        kinds.setdefault((w.column, str(w.where), w.low, w.high), []).append(w)
    for column in numbers:
        mine = [ws for key, ws in kinds.items() if key[0] == column]
        places = [F.when(F.coalesce(held(ws[0]), F.lit(False)), F.lit(i)) for i, ws in enumerate(mine)]
        place = places[0] if len(mine) == 1 else F.explode(F.array_compact(F.array(*places)))
        rows = (df.select(F.col(column).alias("v"), place.alias("i")).filter("i is not null")
                .groupBy("i", "v").agg(F.count(F.lit(1)).alias("c")))
        upto = F.sum("c").over(Window.partitionBy("i").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
        ranks = F.element_at(F.array(*[F.array(*[F.lit(w.rank - w.base) for w in ws]) for ws in mine]), F.col("i") + 1)
        hit = rows.withColumn("u", upto).filter(F.exists(ranks, lambda r: (F.col("u") > r) & (F.col("u") - F.col("c") <= r)))
        for r in hit.select("i", "v", "u", "c").collect():
            for w in mine[r["i"]]:
                if r["u"] - r["c"] <= w.rank - w.base < r["u"]:
                    w.value, w.below, w.ties = r["v"], w.base + r["u"] - r["c"], r["c"]


def counts_of(df: DataFrame, pairs: Sequence[tuple[str, Column | None]]) -> list[tuple[int, int]]:
    """(rows, non-null rows) of each (column, filter), in one pass."""
    def keep(where):
        return F.lit(True) if where is None else F.coalesce(where, F.lit(False))

    row = df.agg(*[c for i, (column, where) in enumerate(pairs) for c in (
        F.count_if(keep(where)).alias(f"n{i}"),
        F.count_if(keep(where) & F.col(column).isNotNull()).alias(f"v{i}"))]).first()
    return [(row[f"n{i}"], row[f"v{i}"]) for i in range(len(pairs))]


def select_keys(df: DataFrame, keys: Sequence[str], ranks: Sequence[int], known: int | None = None,
                inside: int | None = None) -> list[tuple]:
    """The key tuples at 0-based ranks of ``df`` ordered by ``keys`` (nulls
    last): the first key's value at a rank, then, only among rows that share
    it, the next key's.  A rank that begins a tie, or has none, needs no
    further key: its tuple is shorter.  ``known``: non-null rows of the first
    key."""
    found: list[list] = [[] for _ in ranks]
    left, where, open_ = list(ranks), [None] * len(ranks), list(range(len(ranks)))
    for level, column in enumerate(keys):
        # cuts inside one tie share its filter
        filters = {str(where[i]): where[i] for i in open_}
        if level == 0 and known is not None:
            n = {str(None): (known, known)}
        else:
            n = dict(zip(filters, counts_of(df, [(column, w) for w in filters.values()])))
        wanted = {i: Wanted(column, left[i], where[i], n[str(where[i])][1]) for i in open_}
        select_ranks(df, list(wanted.values()), inside)
        dtype = df.schema[column].dataType
        for i, w in wanted.items():
            found[i].append(w.value)
            left[i] -= w.below
            same = F.col(column).eqNullSafe(F.lit(w.value).cast(dtype))
            where[i] = same if where[i] is None else where[i] & same
        open_ = [i for i in open_ if left[i]]
        if not open_:
            break
    return [tuple(f) for f in found]


def not_before(df: DataFrame, keys: Sequence[str], cut: Sequence) -> Column:
    """Whether a row's keys are at or after ``cut`` (ascending, nulls last;
    a shorter tuple compares its keys only)."""
    after = F.lit(True)
    for column, value in reversed(list(zip(keys, cut))):
        c, v = F.col(column), F.lit(value).cast(df.schema[column].dataType)
        greater = F.lit(False) if value is None else c.isNull() | F.coalesce(c > v, F.lit(False))
        after = greater | (c.eqNullSafe(v) & after)
    return after
