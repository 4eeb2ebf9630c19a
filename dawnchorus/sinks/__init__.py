"""Output formats: pure projections plus partitioned writes."""
