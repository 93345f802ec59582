"""geoloom: a PySpark-native geodata analytics engine."""
