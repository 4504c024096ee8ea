"""Folder trees as a Spark data source: folders are pruned while they are listed, files opened later.

`list_tree` gives one row a file (path, length, modification time) and opens nothing. The driver
lists only as many levels as it needs to have some folders for each core; tasks list what is
below them, and never enter a pruned folder. Filters on the path prefix are pushed into the
listing. `with_content` then opens what is left of the rows, dealt out by size.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition, StringStartsWith

from ballast.session import mapped_arrow

LISTED = "path string, len long, modified_millis long"
#: Files of one folder that one task lists, folders of the plan for each core, bytes of an Arrow batch.
FOLDER_FILES = 20_000
FOLDERS_A_CORE = 4
BATCH_BYTES = 16 << 20
#: What opening a file costs, in bytes read.
OPEN_BYTES = 1 << 16


@dataclass
class Piece(InputPartition):
    """A folder: with all below it, or only its own files whose names fall into one of `of` parts."""

    folder: str
    below: bool
    part: int = 0
    of: int = 1

    def __post_init__(self):
        super().__init__(None)


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.files, self.root = fs.FileSystem.from_uri(options["path"])
        self.root = self.root.rstrip("/")
        self.pruned = frozenset(json.loads(options.get("pruned", "[]")))
        self.folders = int(options.get("folders", "32"))
        self.prefix = ""
        #: folders listed by this object, for tests
        self.listed: list[str] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Keep what begins with the longest prefix asked for; every filter is still applied by Spark."""
        for wanted in filters:
            if isinstance(wanted, (EqualTo, StringStartsWith)) and wanted.attribute == ("path",):
                value = str(wanted.value)
                if value.startswith(self.prefix):
                    self.prefix = value
            yield wanted

    def _reachable(self, folder: str) -> bool:
        """Whether a path with the prefix can lie below the folder (relative, with a closing slash)."""
        return folder.startswith(self.prefix) or self.prefix.startswith(folder)

    def _children(self, folder: str) -> tuple[list[str], list[fs.FileInfo]]:
        """Folders to enter and files of a folder, named relative to the root."""
        self.listed.append(folder)
        found = self.files.get_file_info(fs.FileSelector(f"{self.root}/{folder}" if folder else self.root, allow_not_found=True))
        inside = [f"{folder}{i.base_name}/" for i in found if i.type == fs.FileType.Directory and i.base_name not in self.pruned]
        return sorted(f for f in inside if self._reachable(f)), [i for i in found if i.type == fs.FileType.File]

    def partitions(self) -> list[Piece]:
        waiting, pieces = [""], []
        while waiting and len(waiting) + len(pieces) < self.folders:
            folder = waiting.pop(0)
            inside, files = self._children(folder)
            waiting += inside
            parts = -(-len(files) // FOLDER_FILES)
            pieces += [Piece(folder, False, n, parts) for n in range(parts)]
        return pieces + [Piece(folder, True) for folder in waiting] or [Piece("", False)]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        waiting = [partition.folder]
        while waiting:
            folder = waiting.pop()
            inside, files = self._children(folder)
            if partition.below:
                waiting += inside
            rows = [
                (folder + i.base_name, i.size, i.mtime_ns // 1_000_000)
                for i in files
                if partition.of == 1 or zlib.crc32(i.base_name.encode()) % partition.of == partition.part
            ]
            rows = [row for row in rows if row[0].startswith(self.prefix)]
            if rows:
                names, sizes, times = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.string()), pa.array(sizes, pa.int64()), pa.array(times, pa.int64())], ["path", "len", "modified_millis"]
                )


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ballast_tree"

    def schema(self) -> str:
        return LISTED

    def reader(self, schema) -> TreeReader:
        return TreeReader(dict(self.options))


def list_tree(spark: SparkSession, root: str, pruned: Iterable[str] = ()) -> DataFrame:
    """path (relative to `root`), len and modified_millis of the files outside pruned folders."""
    from ballast.session import ship_package

    ship_package(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TreeSource)
    folders = FOLDERS_A_CORE * spark.sparkContext.defaultParallelism
    reader = spark.read.format(TreeSource.name()).option("pruned", json.dumps(sorted(pruned))).option("folders", str(folders))
    return reader.load(root)


def with_content(listed: DataFrame, root: str, tasks: int | None = None) -> DataFrame:
    """The rows of `listed` (path, len and any other columns) with their content, null where it cannot be read.

    Rows are dealt by path, so a folder with most of the files is no task of its own; rows of a
    task are opened one by one and sent in batches of bounded size.
    """
    spark = listed.sparkSession
    dealt = listed.repartition(tasks or FOLDERS_A_CORE * spark.sparkContext.defaultParallelism, "path")
    at = listed.columns.index("path")

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            first, held, size = 0, [], 0
            names = [*batch.schema.names, "content"]
            for row, path in enumerate(batch.column(at).to_pylist()):
                try:
                    with files.open_input_stream(f"{base.rstrip('/')}/{path}") as stream:
                        held.append(stream.read())
                except OSError:
                    held.append(None)
                size += OPEN_BYTES + len(held[-1] or b"")
                if size >= BATCH_BYTES or row + 1 == batch.num_rows:
                    part = batch.slice(first, row + 1 - first)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(held, pa.binary())], names)
                    first, held, size = row + 1, [], 0

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in listed.schema.fields]
    return mapped_arrow(dealt, opened, ", ".join([*fields, "content binary"]))
