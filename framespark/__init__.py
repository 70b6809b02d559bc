"""PySpark-native engine for stacks of image frames."""
