"""caselattice: a PySpark-native engine for evidence-network and event analytics."""

__version__ = "0.1.0"
