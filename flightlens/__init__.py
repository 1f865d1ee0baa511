"""flightlens: on-time-performance analytics as Spark DataFrame / SQL / ML jobs."""

__version__ = "0.1.0"
