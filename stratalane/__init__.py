"""Type-aware column encoding on Spark: profile, size, select, encode and decode blocks of ordered columns."""
