"""noteframe: a PySpark-native engine for corpora of digitised notes and documents."""
