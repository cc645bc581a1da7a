"""News-sentiment analytics as PySpark DataFrame and Structured Streaming jobs."""

from tickerloom.params import Params

__all__ = ["Params"]
