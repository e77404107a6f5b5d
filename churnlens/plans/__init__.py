"""Named queries (the user-facing analytics) and their SQL oracles."""
