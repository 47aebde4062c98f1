"""Column-level building blocks: names, distances, chart encodings, quantiles."""
