"""tidemark: a Spark-native analytics engine for telemetry (logs, traces, metrics)."""

__version__ = "0.1.0"
