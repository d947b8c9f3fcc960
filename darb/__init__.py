"""darb: a PySpark-native analytics engine for school-bus routing data and large training corpora."""
