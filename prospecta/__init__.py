"""A PySpark engine for fund-registration filing events: identity, history, readiness, themes and briefs."""
