"""Text-evidence analytics on Spark: columns, operators, sources, streams and plans."""
