"""PySpark-native e-mail analytics: scan, decode, flatten, extract, report."""
