"""Media files: a listing whose statuses are read by tasks, and a sink that writes them."""

from __future__ import annotations

from collections.abc import Iterator
from fnmatch import fnmatchcase
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, folder string, image string, length bigint"
ROWS_PER_BATCH = 10_000


def _store(root: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a root and the root's name in it. A plain path is local."""
    base = root.rstrip("/")
    if urlsplit(base).scheme == "file":
        base = "/" + urlsplit(base).path.lstrip("/")
    return pafs.FileSystem.from_uri(base)


def _hidden(name: str) -> bool:
    return name.startswith(("_", "."))


class _Folder(InputPartition):
    """One directory below the root, or the files of the root itself (None)."""

    def __init__(self, folder: str | None) -> None:
        self.folder = folder


class _TreeReader(DataSourceReader):
    def __init__(self, root: str, glob: str) -> None:
        self.root, self.glob = root.rstrip("/"), glob

    def partitions(self) -> list[_Folder]:
        """The names of the directories below the root; their files are listed by the tasks."""
        store, base = _store(self.root)
        found = store.get_file_info(pafs.FileSelector(base))
        folders = sorted(f.base_name for f in found if f.type == pafs.FileType.Directory and not _hidden(f.base_name))
        return [_Folder(None), *map(_Folder, folders)]

    def read(self, partition: _Folder) -> Iterator[pa.RecordBatch]:
        store, base = _store(self.root)
        schema = pa.schema([("path", pa.string()), ("folder", pa.string()), ("image", pa.string()), ("length", pa.int64())])
        # One directory at a time, so a task holds the entries of one directory.
        waiting, rows = [base if partition.folder is None else f"{base}/{partition.folder}"], []
        while waiting:
            for f in store.get_file_info(pafs.FileSelector(waiting.pop())):
                if _hidden(f.base_name):
                    continue
                if f.type == pafs.FileType.Directory:
                    if partition.folder is not None:
                        waiting.append(f.path)
                elif fnmatchcase(f.base_name, self.glob):
                    rows.append((self.root + f.path[len(base):], partition.folder, f.base_name, f.size))
                    if len(rows) == ROWS_PER_BATCH:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)
                        rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)


class MediaTree(DataSource):
    """``spark.read.format("media_tree").option("root", ...).option("glob", ...)``"""

    @classmethod
    def name(cls) -> str:
        return "media_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _TreeReader:
        return _TreeReader(self.options["root"], self.options.get("glob", "*"))


def scan_media(spark: SparkSession, root: str, glob: str = "*", by_tasks: bool = True) -> DataFrame:
    """One row per file under ``root``: path below the root, folder, name, length.

    ``folder`` is the first directory below the root, or NULL for a file in the root itself. One task
    lists one such directory with all below it; the driver sees the directories' names only. Names that begin
    with ``_`` or ``.`` are left out, as Spark does. ``by_tasks=False`` uses
    Spark's own listing, which passes through the driver and leaves out empty files, for a store that only Spark reaches.
    """
    base = root.rstrip("/")
    if by_tasks:
        spark.dataSource.register(MediaTree)
        return spark.read.format("media_tree").option("root", base).option("glob", glob).load()
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .load(base)
        .select("path", "length")
    )
    # The listing gives qualified paths; what they begin with is the qualified root.
    given = spark._jvm.org.apache.hadoop.fs.Path(base)
    root_path = given.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(given)
    below = F.substring(F.col("path"), len(root_path.toString()) + 2, F.length("path"))
    steps = F.split(below, "/")
    return files.select(
        F.concat(F.lit(base + "/"), below).alias("path"),
        F.when(F.size(steps) > 1, F.get(steps, 0)).alias("folder"),
        F.element_at(steps, -1).alias("image"),
        "length",
    )


def write_media(files: DataFrame, root: str, folder: str = "folder", image: str = "image", content: str = "content") -> DataFrame:
    """Write each row's bytes as ``root/folder/image``; one row per task: the number of files.

    A file is written under a hidden name and renamed, so a task that runs again replaces whole files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (store, base), count, made = _store(root), 0, set()
        draft = f".draft-{TaskContext.get().taskAttemptId()}"
        for batch in batches:
            for where, name, data in zip(*(c.to_pylist() for c in batch.columns)):
                if where not in made:
                    store.create_dir(f"{base}/{where}", recursive=True)
                    made.add(where)
                with store.open_output_stream(f"{base}/{where}/{draft}", compression=None) as out:
                    out.write(data or b"")
                store.move(f"{base}/{where}/{draft}", f"{base}/{where}/{name}")
                count += 1
        yield pa.RecordBatch.from_pydict({"files": [count]})

    return files.select(folder, image, F.col(content).cast("binary")).mapInArrow(run, "files long")
