from shelfprice.sources.csv_source import DatasetError, clean_headers, read_lenient_csv, require_rows
from shelfprice.sources.sinks import load_model, save_model, write_csv, write_json, write_table

__all__ = [
    "DatasetError", "clean_headers", "load_model", "read_lenient_csv", "require_rows",
    "save_model", "write_csv", "write_json", "write_table",
]
