"""Thresholds that the registered queries pass to the operators.

The operators' own defaults are the source analysis' values (50 persons a
heatmap cohort, 100 a curve cohort, 500 a category, on ~96K persons).  The
registered queries and their SQL pass the one set below for every folder,
whatever its name or size; it is low enough that the smallest folders have
rows to compare.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Thresholds:
    heatmap_min_cohort: int = 50
    curve_min_cohort: int = 100
    category_min_customers: int = 500
    shown_month_index: int = 12  # heatmap and curve show the first 13 months
    top_k: int = 10


SOURCE = Thresholds()
REGISTERED = Thresholds(heatmap_min_cohort=10, curve_min_cohort=10, category_min_customers=50)
