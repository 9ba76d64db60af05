"""Readers: dated Parquet files, tables by suffix, footers, raw lines; and views of the test tables."""
