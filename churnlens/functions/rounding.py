"""Exact rounding of ratios.

Rates and averages are rounded on integers (counts, cents) so that the
result does not depend on floating-point evaluation order and matches SQL
``NUMERIC`` half-up (SQL-derived outputs) or half-even (notebook-derived
outputs) exactly.  The rounded value is returned as a double.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_cents(c) -> Column:
    """Exact money (decimal with two places) → integer cents as decimal(38,0)."""
    return (_c(c) * 100).cast("decimal(38,0)")


def ratio_round(num, den, scale: int = 1, digits: int = 2,
                mode: str = "half_even") -> Column:
    """round(scale * num / den, digits) computed exactly.

    ``num`` and ``den`` are non-negative integer expressions (counts or
    cents).  ``den = 0`` gives null, as a ratio of nothing is undefined.
    """
    factor = scale * 10 ** digits
    n = _c(num).cast("decimal(38,0)") * F.lit(factor).cast("decimal(38,0)")
    d = _c(den).cast("decimal(38,0)")
    safe_d = F.when(d != 0, d)
    if mode == "half_up":
        # floor((2n + d) / 2d), as an exact integer quotient
        m = n * 2 + safe_d
        q = (m - F.pmod(m, safe_d * 2)) / (safe_d * 2)
    elif mode == "half_even":
        base = (n - F.pmod(n, safe_d)) / safe_d
        r2 = F.pmod(n, safe_d) * 2
        bump = (r2 > safe_d) | ((r2 == safe_d) & (F.pmod(base, F.lit(2)) == 1))
        q = base + F.when(bump, 1).otherwise(0)
    else:
        raise ValueError(f"unknown rounding mode {mode!r}")
    return (q.cast("decimal(38,0)").cast("double") / F.lit(float(10 ** digits)))


def money_avg(total, count, mode: str = "half_even") -> Column:
    """Exact average of money: round(total / count, 2) from integer cents."""
    return ratio_round(to_cents(total), count, scale=1, digits=0, mode=mode) / F.lit(100.0)


def int_avg(total, count, digits: int = 2, mode: str = "half_even") -> Column:
    """Exact average of integers rounded to ``digits`` places."""
    return ratio_round(total, count, scale=1, digits=digits, mode=mode)


def money_share(part, whole, digits: int = 2, mode: str = "half_even") -> Column:
    """part / whole × 100 for money columns, computed on cents."""
    return ratio_round(to_cents(part), to_cents(whole), scale=100, digits=digits, mode=mode)
