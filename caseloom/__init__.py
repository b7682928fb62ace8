"""Event-sequence analytics as Spark jobs: event logs, forecasts, and agent traces."""
