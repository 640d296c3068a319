"""Packages as files in any store, written in two phases and read again.

`write_packages` is a Spark data source writer. A task writes its packages below a staging folder of its own attempt; the
driver's commit moves the folders of the tasks that succeeded, one rename a task, and an abort removes the staging folder. So a
task that fails halfway, a lost executor or a second attempt leaves no file that readers see, and none twice. A task that runs
on behind an abort may leave a staging folder; readers leave out names with an underscore before them.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

#: Folders that Spark's readers, and ours, leave out.
STAGING = "_staging"


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    """The store of a folder's URI (a plain path is local), and the path in it."""
    return fs.FileSystem.from_uri(folder if re.match(r"[a-z0-9+.-]+:/", folder) else f"file://{folder}")


@dataclass
class Written(WriterCommitMessage):
    part: str
    files: int


class PackageWriter(DataSourceArrowWriter):
    def __init__(self, folder: str, ending: str, overwrite: bool):
        self.folder, self.ending, self.overwrite = folder, ending, overwrite
        self.job = uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, base = opened(self.folder)
        part = f"part-{uuid.uuid4().hex}"  # of this attempt alone
        files = 0
        for batch in iterator:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                if not content.is_valid:
                    continue
                if not files:
                    store.create_dir(f"{base}/{STAGING}-{self.job}/{part}", recursive=True)
                with store.open_output_stream(f"{base}/{STAGING}-{self.job}/{part}/{name}{self.ending}") as out:
                    out.write(content.as_buffer())
                files += 1
        return Written(part, files)

    def commit(self, messages: list[Written | None]) -> None:
        store, base = opened(self.folder)
        done = [m for m in messages if m is not None and m.files]
        store.create_dir(base, recursive=True)
        before = [x.path for x in store.get_file_info(fs.FileSelector(base)) if x.base_name.startswith("part-")] if self.overwrite else []
        for message in done:
            store.move(f"{base}/{STAGING}-{self.job}/{message.part}", f"{base}/{message.part}")
        for path in before:
            store.delete_dir(path)
        self._clear(store, base)
        with store.open_output_stream(f"{base}/_SUCCESS"):
            pass

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*opened(self.folder))

    def _clear(self, store: fs.FileSystem, base: str) -> None:
        staging = f"{base}/{STAGING}-{self.job}"
        if store.get_file_info(staging).type == fs.FileType.Directory:
            store.delete_dir(staging)


class PackageSink(DataSource):
    """Options: path; ending (".docx")."""

    @classmethod
    def name(cls) -> str:
        return "packages"

    def writer(self, schema, overwrite: bool) -> PackageWriter:
        return PackageWriter(self.options["path"], self.options.get("ending", ".docx"), overwrite)


def write_packages(df: DataFrame, folder: str, id: str = "doc_id", content: str = "content", ending: str = ".docx", overwrite: bool = False) -> None:
    """Write each row's package as <folder>/part-*/<id><ending>; rows without content are left out.

    With overwrite, what earlier writes left goes once the new files are in place. An id is a file name: null and names that
    would leave the folder are refused before anything is written, and equal ids of one task overwrite each other.
    """
    df.sparkSession.dataSource.register(PackageSink)
    name = F.col(id).cast("string")
    bad = name.isNull() | name.rlike(r"[/\\\x00]|^\.{0,2}$")
    checked = F.when(~bad, name).otherwise(F.raise_error(F.concat(F.lit("not a file name: "), F.coalesce(name, F.lit("null")))).cast("string"))
    rows = df.select(checked.alias("name"), F.col(content).alias("content"))
    rows.write.format("packages").mode("overwrite" if overwrite else "append").option("path", folder).option("ending", ending).save()


def read_packages(spark: SparkSession, folder: str, ending: str = ".docx") -> DataFrame:
    """(name, content, path) of the packages that were committed into a folder; one nobody wrote to gives an error."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", f"*{ending}").option("recursiveFileLookup", "true").load(folder)
    named = F.regexp_extract("path", r"([^/]+)$", 1)
    return found.select(F.substring(named, F.lit(1), F.length(named) - len(ending)).alias("name"), "content", "path")
