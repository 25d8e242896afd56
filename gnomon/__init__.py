"""gnomon: a Spark-native analytics engine for places, their schedule sources and time rules."""

from __future__ import annotations

__version__ = "0.1.0"
