"""lodestrata: a PySpark-native analytics engine over content-addressed data."""
