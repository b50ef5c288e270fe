"""Writing export files, as a sink of Spark's Python data source API.

``write_exports(rows, root)`` writes each row ``profile, file_name, value`` to
``<root>/profile=<profile>/<file_name>``, the layout that the scan reads. A NULL value removes
the file. Tasks write the files themselves; nothing passes through the driver.

A file is written under a hidden name and then renamed, so no reader meets half a file and a
task that is run again, or twice at once, leaves the same files. Removing a file that is not
there is no error. Rows without a profile or file name fail the write. Of two rows for one
file either may win.
"""

from __future__ import annotations

import posixpath
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

# Characters that Spark writes as %XX in the name of a partition folder.
_ESCAPED = re.compile("[\x00-\x1f\"#%'*/:=?\\\\\x7f{\\[\\]^]")


def folder_name(profile: str) -> str:
    """The folder of a profile, escaped as Spark reads it back."""
    return "profile=" + _ESCAPED.sub(lambda m: f"%{ord(m[0]):02X}", profile)


def _filesystem(root: str):
    from pyarrow import fs

    local = re.sub("^file:/+", "/", root)
    if local.startswith("/"):
        return fs.LocalFileSystem(), local
    return fs.FileSystem.from_uri(re.sub("^s3a:", "s3:", root))


@dataclass
class Written(WriterCommitMessage):
    files: int


class _ExportWriter(DataSourceWriter):
    def __init__(self, root: str) -> None:
        self.root = root

    def write(self, rows: Iterator[Row]) -> Written:
        from pyarrow import fs

        files, root = _filesystem(self.root)
        done, made = 0, set()
        for row in rows:
            if row.profile is None or not row.file_name:
                raise ValueError("an export file needs a profile and a name")
            folder = posixpath.join(root, folder_name(row.profile))
            path = posixpath.join(folder, row.file_name)
            done += 1
            if row.value is None:
                if files.get_file_info(path).type == fs.FileType.File:
                    files.delete_file(path)
                continue
            if folder not in made:
                files.create_dir(folder, recursive=True)
                made.add(folder)
            hidden = posixpath.join(folder, f"_{uuid.uuid4().hex}")
            with files.open_output_stream(hidden) as out:
                out.write(row.value.encode())
            files.move(hidden, path)
        return Written(done)


class ExportFolders(DataSource):
    """The sink ``format("export_folders")``; it can be appended to and not read."""

    @classmethod
    def name(cls) -> str:
        return "export_folders"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("export folders are appended to: write NULL to remove a file")
        return _ExportWriter(self.options["path"])


def write_exports(rows: DataFrame, root: str) -> None:
    """Write, replace and remove export files under ``root``."""
    spark: SparkSession = rows.sparkSession
    spark.dataSource.register(ExportFolders)
    chosen = rows.select("profile", "file_name", "value")
    chosen.write.format("export_folders").mode("append").save(root)
