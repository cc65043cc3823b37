"""folioscope: a PySpark-native engine for page-oriented document analytics."""
