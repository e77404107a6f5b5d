"""Rule tables: ordered (predicate, label) lists folded into one CASE.

A rule table is data, not code: ``apply_rules`` turns it into a single
``when`` chain (first match wins), which stays inside whole-stage codegen
instead of a per-row Python function.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the analysed project's definitions.
# Frequency buckets (orders → F score): 1 → 1, 2 → 3, 3-4 → 4, 5 or more → 5.
FREQUENCY_BUCKETS = ((1, 1, 1), (2, 2, 3), (3, 4, 4))
FREQUENCY_TOP_SCORE = 5

# The nine segment labels, in rule order (first match wins).
SEGMENT_LABELS = (
    "Champions",
    "Loyal Customers",
    "Potential Loyalists",
    "At Risk",
    "New High-Value",
    "Recent One-Timers",
    "Lost High-Value",
    "Lost / Hibernating",
    "Middle One-Timers",
)


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def apply_rules(rules: Sequence[tuple[Column, str]], default: str) -> Column:
    """Ordered rules → one CASE expression; first matching predicate wins."""
    expr = None
    for predicate, label in rules:
        expr = F.when(predicate, F.lit(label)) if expr is None else expr.when(predicate, F.lit(label))
    return F.lit(default) if expr is None else expr.otherwise(F.lit(default))


def frequency_score(freq) -> Column:
    """Manual frequency buckets (quintiles cannot split a mass of one-timers)."""
    f = _c(freq)
    expr = None
    for lo, hi, score in FREQUENCY_BUCKETS:
        cond = (f == lo) if lo == hi else f.between(lo, hi)
        expr = F.when(cond, F.lit(score)) if expr is None else expr.when(cond, F.lit(score))
    return expr.otherwise(F.lit(FREQUENCY_TOP_SCORE)).cast("int")


def segment_rules(r, f, m) -> list[tuple[Column, str]]:
    """The RFM segment rule table over integer scores r, f, m (1..5).

    ``Potential Loyalists`` can never fire: every row it would match was
    already taken by ``Loyal Customers``.  The order is kept as defined.
    """
    r, f, m = _c(r), _c(f), _c(m)
    return [
        ((r >= 4) & (f >= 4), "Champions"),
        ((f >= 3) & (r >= 3), "Loyal Customers"),
        ((r >= 4) & (f == 3), "Potential Loyalists"),
        ((f >= 3) & (r <= 2), "At Risk"),
        ((r == 5) & (f == 1) & (m >= 4), "New High-Value"),
        ((r >= 4) & (f == 1), "Recent One-Timers"),
        ((r <= 2) & (f == 1) & (m >= 4), "Lost High-Value"),
        ((r <= 2) & (f == 1), "Lost / Hibernating"),
    ]


def segment_of(r, f, m) -> Column:
    return apply_rules(segment_rules(r, f, m), "Middle One-Timers")
