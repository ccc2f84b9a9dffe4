"""Writers: tables as Parquet, and the text views other tools read."""
