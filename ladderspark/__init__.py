"""Contest-rating analytics as PySpark DataFrame operators."""

from ladderspark.config import RatingConfig

__all__ = ["RatingConfig"]
