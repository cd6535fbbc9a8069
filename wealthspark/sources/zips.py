"""SRC4: folders of zip files as a data source with a partition for each member."""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Rows that are held at a time.
ROWS = 10_000


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address and the path in it."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), unquote("/" + path.removeprefix("file:").lstrip("/"))
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class Member(InputPartition):
    def __init__(self, zip: str, name: str):
        super().__init__(f"{zip}!{name}")
        self.zip, self.name = zip, name


class MemberReader(DataSourceReader):
    def __init__(self, folder: str, columns: list[str]):
        self.folder, self.columns = folder, columns

    def _members(self, path: str) -> list[Member]:
        """From the zip's directory at its end alone; a zip that cannot be read has none."""
        try:
            with opened(self.folder)[0].open_input_file(path) as f, zipfile.ZipFile(f) as z:
                return [Member(path, m) for m in z.namelist() if m.lower().endswith(".csv")]
        except (zipfile.BadZipFile, pa.ArrowInvalid):  # a file shorter than a zip's directory cannot be sought in
            return []

    def partitions(self) -> list[InputPartition]:
        store, at = opened(self.folder)
        found = sorted(i.path for i in store.get_file_info(fs.FileSelector(at, recursive=True)) if i.is_file and i.path.endswith(".zip"))
        with ThreadPoolExecutor(16) as pool:
            return [m for members in pool.map(self._members, found) for m in members] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if not isinstance(partition, Member):
            return
        names = ["zip", "member", *self.columns]
        batch = lambda rows: pa.record_batch([pa.array(c, pa.string()) for c in zip(*rows)], names)
        with opened(self.folder)[0].open_input_file(partition.zip) as f, zipfile.ZipFile(f) as z, z.open(partition.name) as member:
            held = []
            for row in csv.DictReader(io.TextIOWrapper(member, "utf-8", errors="replace")):
                held.append((partition.zip, partition.name, *[row.get(c) for c in self.columns]))
                if len(held) >= ROWS:
                    yield batch(held)
                    held = []
            if held:
                yield batch(held)


class ZippedCsv(DataSource):
    """``spark.read.format("zipped_csv").schema("zip string, member string, ...").load(folder)``: the columns after the first two are looked up in each member's head."""

    @classmethod
    def name(cls) -> str:
        return "zipped_csv"

    def reader(self, schema) -> DataSourceReader:
        return MemberReader(self.options["path"], schema.names[2:])
