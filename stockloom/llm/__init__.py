"""Training-data pipeline operators: scans, filters, dedup, mixing and counting over document tables."""
