"""notemill: a PySpark-native engine for ordered, checked and measurable record collections."""
