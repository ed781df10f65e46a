"""Repository analytics on Spark: DataFrame-to-DataFrame operators over files, symbols, commits, changes and imports."""
