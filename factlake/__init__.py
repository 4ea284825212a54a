"""factlake: checking machine-written text at table scale, as Spark jobs."""

__version__ = "0.1.0"
