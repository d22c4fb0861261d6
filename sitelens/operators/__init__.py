"""DataFrame operators: shredding, extraction, merging, joins, walks, metrics."""
