"""A Spark-native context engine: files to chunks, selection, rendering and edits as DataFrames."""
