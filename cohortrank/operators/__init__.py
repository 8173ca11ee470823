"""DataFrame -> DataFrame operators (ranks, joins, aggregates, set logic)."""
