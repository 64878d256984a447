"""Table-level operators: filters, keys, joins, history, upserts."""
