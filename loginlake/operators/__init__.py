"""Table-to-table jobs: parsing, correlation, labels, metrics, enrichment."""
