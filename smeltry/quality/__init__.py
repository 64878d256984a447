"""Data-quality checks, expectations and roll-ups, all as result rows."""
