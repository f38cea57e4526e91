"""lectern: a Spark-first engine for study books, dialogue scripts and their telemetry."""

__version__ = "0.1.0"
