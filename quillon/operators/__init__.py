"""DataFrame operators: counts, information, order, joins, resampling, models, search."""
