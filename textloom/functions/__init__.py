"""Column builders: text, buckets, filters, presentation."""
