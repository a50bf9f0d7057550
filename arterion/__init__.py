"""arterion: a Spark-first analytics engine for camera-derived pulse signals."""

__version__ = "0.1.0"
