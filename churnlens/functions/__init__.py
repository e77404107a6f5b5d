"""Column-level helpers (dates, exact rounding, rule tables)."""

from churnlens.functions.dates import (  # noqa: F401
    add_days, elapsed_days, fractional_days, month_diff, month_start, parse_timestamp,
)
from churnlens.functions.rounding import (  # noqa: F401
    int_avg, money_avg, money_share, ratio_round, to_cents,
)
from churnlens.functions.rules import (  # noqa: F401
    SEGMENT_LABELS, apply_rules, frequency_score, segment_of, segment_rules,
)
