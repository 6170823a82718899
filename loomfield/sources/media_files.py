"""Media files of any size: read by byte ranges, hashed as they stream, and written from rows of chunks."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator, Sequence
from functools import reduce
from typing import NamedTuple

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from loomfield.operators.ranks import written

#: The extensions of media files.
MEDIA = ["mp4", "mov", "mkv", "webm", "flv"]
#: Bytes of a range, those that it shares with the next one, those read by a task about, and those hashed at a time.
RANGE, OVERLAP, TASK, PIECE = 8 << 20, 19, 64 << 20, 1 << 20
#: Files and folders of a task, about.
TASK_FILES, TASK_FOLDERS = 1000, 16
LISTED = "media_path string, size_bytes long, modified_ns long, folder boolean"
RANGES = "media_path string, size_bytes long, modified_ns long, offset long, content binary"
INVENTORY = "media_path string, size_bytes long, modified_ns long, content_hash string"


class Found(NamedTuple):
    """A file."""

    path: str
    size: int
    modified_ns: int


class Files(InputPartition):
    def __init__(self, found: list[Found]):
        super().__init__(0)
        self.found = found


def _tasks(root: str, endings: Sequence[str]) -> list[Files]:
    """All media files under a folder, in tasks of about equal size."""
    system, top = fs.FileSystem.from_uri(root)
    tasks, held, files = [], 0, 0
    for info in sorted(system.get_file_info(fs.FileSelector(top, recursive=True)), key=lambda i: i.path):
        if info.type != fs.FileType.File or info.extension.lower() not in endings:
            continue
        if not tasks or held + info.size > TASK or files >= TASK_FILES:
            tasks.append(Files([]))
            held, files = 0, 0
        tasks[-1].found.append(Found(info.path, info.size, info.mtime_ns))
        held, files = held + info.size, files + 1
    return tasks or [Files([])]


class InventoryReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.endings = options["path"], options.get("endings", ",".join(MEDIA)).split(",")

    def partitions(self) -> Sequence[InputPartition]:
        return _tasks(self.root, self.endings)

    def read(self, partition: Files) -> Iterator[Row]:
        system, _ = fs.FileSystem.from_uri(self.root)
        for f in partition.found:
            digest = hashlib.sha256()
            with system.open_input_stream(f.path) as file:
                while piece := file.read(PIECE):
                    digest.update(piece)
            yield Row(media_path=f.path, size_bytes=f.size, modified_ns=f.modified_ns, content_hash=digest.hexdigest())


class FileWriter(DataSourceWriter):
    def __init__(self, options: dict):
        self.root = options["path"]

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        """A file is written under a name of its own and renamed when it is whole, so a task that runs again replaces it."""
        system, top = fs.FileSystem.from_uri(self.root)
        name, file, draft = None, None, None

        def close() -> None:
            file.close()
            system.move(draft, f"{top}/{name}")

        for row in iterator:
            if row.name != name:
                if file:
                    close()
                name = row.name
                draft = f"{top}/{name}.{uuid.uuid4().hex}"
                system.create_dir(f"{top}/{name}".rpartition("/")[0], recursive=True)
                file = system.open_output_stream(draft)
            file.write(bytes(row.content or b""))
        if file:
            close()
        return WriterCommitMessage()


class MediaInventory(DataSource):
    """``media_inventory``: a row of INVENTORY for each file, hashed piece by piece."""

    @classmethod
    def name(cls) -> str:
        return "media_inventory"

    def schema(self) -> str:
        return INVENTORY

    def reader(self, schema) -> DataSourceReader:
        return InventoryReader(self.options)


class MediaFiles(DataSource):
    """``media_files``: a sink for rows (name, part, content)."""

    @classmethod
    def name(cls) -> str:
        return "media_files"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return FileWriter(self.options)


def scan_media(spark: SparkSession, root: str) -> DataFrame:
    """media_path, size_bytes, modified_ns, content_hash of the media files under a folder; endings in either case.

    A file is hashed by one task, piece by piece, so no row or worker holds it whole.
    """
    spark.dataSource.register(MediaInventory)
    return spark.read.format(MediaInventory.name()).load(root)


def list_media(spark: SparkSession, root: str, endings: Sequence[str] = MEDIA) -> DataFrame:
    """media_path, size_bytes, modified_ns of the media files under a folder; endings in either case.

    Tasks list the folders of a level, each by one task, and write what they find, so
    the driver sees no file. The levels run when this is called.
    """

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = fs.FileSystem.from_uri(root)
        for folder in (f for b in batches for f in b.column(0).to_pylist()):
            found = [i for i in system.get_file_info(fs.FileSelector(folder)) if i.type == fs.FileType.Directory or i.type == fs.FileType.File and i.extension.lower() in endings]
            for at in range(0, len(found), 4096):
                rows = [(i.path, i.size or 0, i.mtime_ns or 0, i.type == fs.FileType.Directory) for i in found[at : at + 4096]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["media_path", "size_bytes", "modified_ns", "folder"])

    folders, levels, n = spark.createDataFrame([(fs.FileSystem.from_uri(root)[1],)], "media_path string"), [], 1
    while n:
        dealt = folders.repartition(-(-n // TASK_FOLDERS), "media_path")
        level = written(dealt.mapInArrow(look, LISTED))
        levels.append(level.where("NOT folder").drop("folder"))
        folders = level.where("folder").select("media_path")
        n = folders.count()
    return reduce(DataFrame.union, levels)


def read_ranges(spark: SparkSession, root: str, step: int = RANGE, overlap: int = OVERLAP) -> DataFrame:
    """RANGES of the media files under a folder: rows of at most ``step`` bytes and ``overlap`` more; an empty file is one row.

    Files, and stretches of long ones, are dealt over tasks, which cut them into their ranges.
    """
    files, stretch = list_media(spark, root), max(1, TASK // step) * step
    size, number = files.agg(F.sum("size_bytes"), F.count(F.lit(1))).first()
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size_bytes") - 1, F.lit(0)), F.lit(stretch).cast("long"))
    dealt = files.withColumn("start", F.explode(starts)).repartition(max(1, -(-(size or 0) // TASK), -(-number // TASK_FILES)), "media_path", "start")
    names = [f.split()[0] for f in RANGES.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = fs.FileSystem.from_uri(root)
        rows, held = [], 0
        for path, size, modified_ns, start in (r for b in batches for r in zip(*[c.to_pylist() for c in b.columns], strict=True)):
            with system.open_input_file(path) as file:
                for at in range(start, max(1, min(start + stretch, size)), step):
                    content = file.read_at(min(step, size - at) + overlap, at) if size else b""
                    rows.append((path, size, modified_ns, at, content))
                    held += len(content)
                    if held >= PIECE or len(rows) >= 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return dealt.mapInArrow(read, RANGES)


def write_files(chunks: DataFrame, root: str, together: bool = False) -> None:
    """Write rows (name, part, content) as files; the parts of a name stream through one task in their order.

    together: they come one after another already, as when each name's parts are made of one row.
    """
    chunks.sparkSession.dataSource.register(MediaFiles)
    rows = chunks.select("name", "part", "content")
    if not together:
        rows = rows.repartition("name").sortWithinPartitions("name", "part")
    rows.write.format("media_files").mode("append").save(root)


def named_as(path: str) -> Column:
    """The last part of a path without its ending."""
    return F.regexp_extract(path, r"([^/]+)\.[^./]*$", 1)
