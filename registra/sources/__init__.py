"""Where rows come from: requests, providers, zones, Parquet footers."""
