"""prosegauge: PySpark-native forensics of prose at corpus scale."""

__version__ = "1.0.0"
