"""Where rows come from and go to: export files, Parquet tables, test tables."""

from .exports import write_exports
from .files import (
    documents, file_kind, fingerprints, list_files, list_profiles, rejected_files,
)
from .tables import read_dimensions, read_plays, read_table, remove_old_runs, write_table

__all__ = [
    "documents", "file_kind", "fingerprints", "list_files", "list_profiles",
    "read_dimensions", "read_plays", "read_table", "rejected_files", "remove_old_runs",
    "write_exports", "write_table",
]
