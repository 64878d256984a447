"""Column profiles, outliers and file health."""
