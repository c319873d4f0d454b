"""A PySpark-native engine that turns recognized page content into clean tables, declared as DataFrame plans."""
