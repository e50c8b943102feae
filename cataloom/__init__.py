"""cataloom: a Spark-native analytics library for media-library metadata."""

from cataloom.session import get_session

__all__ = ["get_session"]
