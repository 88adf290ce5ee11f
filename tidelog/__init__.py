"""Event-log analytics on Spark: scans, ordered folds, conditional writes, projections and streams."""
