"""Building blocks: filters, joins, merges, windows, quantiles and raw-row ingest."""
