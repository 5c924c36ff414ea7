"""lexitag: tag the rows of large tables from rows that already carry tags, on Spark."""
