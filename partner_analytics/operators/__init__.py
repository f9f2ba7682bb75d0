"""Relational operators: filters, joins, aggregations, ranking, sets, sinks."""
