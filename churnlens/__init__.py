"""churnlens: customer-retention analytics as Spark DataFrame operators.

Every public operator takes DataFrames and returns a lazy DataFrame; column
names and thresholds are arguments.  Catalyst plans the work; the only
operators that trigger jobs on their own are the exact distributed ranking
helpers in :mod:`churnlens.operators.ranking` (they must know partition
sizes before they can number rows).
"""

__version__ = "0.1.0"
