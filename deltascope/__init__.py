"""A PySpark-native engine for disclosure change detection, scoring and alert ranking."""
