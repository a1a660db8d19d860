"""Sources and sinks: CSV and Parquet tables, encoding audit, input size."""

from siftframe.sources.csv import read_csv_table
from siftframe.sources.encoding import encoding_audit
from siftframe.sources.parquet import read_parquet_table
from siftframe.sources.sinks import cleaned_name, write_table

__all__ = ["read_csv_table", "read_parquet_table", "encoding_audit", "write_table", "cleaned_name"]
