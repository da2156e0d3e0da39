"""Set-based Spark jobs that turn metadata evidence about analytical models into findings and rollups."""

__version__ = "0.1.0"
