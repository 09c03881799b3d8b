"""feedloom: app-review and user-feedback analytics as Spark DataFrame jobs."""

__version__ = "0.1.0"
