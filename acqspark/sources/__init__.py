"""Inputs and outputs: test tables, canonical input views, seed CSVs, Parquet sinks."""

from .tables import read_table, TableSet
from .canonical import canon_user_data, canon_spend, CANON_CTES
from .seeds import SEEDS, load_csv, read_csv
from .buckets import cv_bucket_table

__all__ = [
    "read_table", "TableSet", "canon_user_data", "canon_spend", "CANON_CTES",
    "SEEDS", "load_csv", "read_csv", "cv_bucket_table",
]
