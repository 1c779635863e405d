"""Tables: the catalog and versioned Parquet snapshots."""
