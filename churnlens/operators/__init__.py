"""DataFrame → DataFrame operators (profiling, master table, ranking,
cohorts, RFM, retention drivers)."""
