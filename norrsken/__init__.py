"""norrsken: equity screening and pick tracking as Spark DataFrame jobs."""

__version__ = "0.1.0"
