"""Fleet-wide diagnostics over database telemetry, expressed as Spark DataFrames."""

KEYS = ("cluster_id", "snapshot_ts")
