"""Archives as a source: the driver reads the directory of an archive, tasks read its members."""

from __future__ import annotations

import datetime
import io
import posixpath
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .scratch import bounded_batches

SCHEMA = "archive string, path string, length long, modified timestamp, content binary, error string"
#: Members and stored bytes of one task (a larger member is alone).
MEMBERS, BYTES = 200, 64_000_000
_LOCAL = struct.Struct("<26xHH")


@dataclass
class Member:
    path: str
    offset: int
    stored: int
    length: int
    method: int
    crc: int
    modified: tuple
    problem: str | None


class Members(InputPartition):
    def __init__(self, archive: str, members: list[Member]):
        super().__init__(archive)
        self.archive, self.members = archive, members


def _problem(info: zipfile.ZipInfo) -> str | None:
    name = posixpath.normpath(info.filename.replace("\\", "/"))
    if name.startswith(("/", "../")) or name == ".." or ":" in name.split("/")[0]:
        return "the path leaves the archive"
    if info.flag_bits & 1:
        return "encrypted"
    return None if info.compress_type in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED) else f"compression {info.compress_type}"


class _Seekable(io.RawIOBase):
    """A file of a file system; a place before its start is an OSError, as zipfile expects."""

    def __init__(self, f):
        self.f = f

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.f.tell()

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        at = offset + (0, self.f.tell(), self.f.size())[whence]
        if at < 0:
            raise OSError("before the start")
        return self.f.seek(at)

    def read(self, n: int | None = -1) -> bytes:
        return self.f.read(None if n is None or n < 0 else n)


def directory(archive: str) -> list[Member]:
    """The files of an archive, from its directory alone; if all lie in one root folder, that is left out of their paths."""
    fs, path = pafs.FileSystem.from_uri(archive)
    with fs.open_input_file(path) as f, zipfile.ZipFile(_Seekable(f)) as z:
        infos = [i for i in z.infolist() if not i.is_dir()]
    shown = [i for i in infos if not i.filename.startswith((".", "__MACOSX"))]
    roots = {i.filename.split("/")[0] if "/" in i.filename else None for i in shown}
    root = f"{roots.pop()}/" if len(roots) == 1 and None not in roots else ""
    cut = lambda n: n[len(root) :] if root and n.startswith(root) else n
    return [Member(cut(i.filename), i.header_offset, i.compress_size, i.file_size, i.compress_type, i.CRC, i.date_time, _problem(i)) for i in infos]


def content(f, m: Member) -> bytes:
    """One member's bytes, from its place in the archive."""
    f.seek(m.offset)
    skip = sum(_LOCAL.unpack(f.read(30)))
    f.seek(m.offset + 30 + skip)
    raw = f.read(m.stored)
    found = raw if m.method == zipfile.ZIP_STORED else zlib.decompress(raw, -15)
    if len(found) != m.length or zlib.crc32(found) != m.crc:
        raise ValueError("damaged")
    return found


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.paths = options["path"].split("\n")
        self.members, self.bytes = int(options.get("members", MEMBERS)), int(options.get("bytes", BYTES))

    def partitions(self) -> list[Members]:
        out = []
        for archive in self.paths:
            held, size = [], 0
            for m in sorted(directory(archive), key=lambda m: m.offset):  # neighbours are read together
                if held and (len(held) >= self.members or size + m.stored > self.bytes):
                    out.append(Members(archive, held))
                    held, size = [], 0
                held.append(m)
                size += m.stored
            if held:
                out.append(Members(archive, held))
        return out

    def read(self, partition: Members) -> Iterator[pa.RecordBatch]:
        fs, path = pafs.FileSystem.from_uri(partition.archive)
        stamp = lambda m: datetime.datetime(*m.modified, tzinfo=datetime.UTC)
        with fs.open_input_file(path) as f:
            for m in partition.members:
                try:
                    found, problem = (None, m.problem) if m.problem else (content(f, m), None)
                except Exception as e:
                    found, problem = None, str(e) or type(e).__name__
                try:
                    when = stamp(m)
                except ValueError:  # archives may hold days that are none
                    when = None
                row = [partition.archive], [m.path], [m.length], pa.array([when], pa.timestamp("us", "UTC")), pa.array([found], pa.binary()), pa.array([problem], pa.string())
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in row], names=["archive", "path", "length", "modified", "content", "error"])


class ArchiveSource(DataSource):
    """``spark.read.format("archive").load(path)``"""

    @classmethod
    def name(cls) -> str:
        return "archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(dict(self.options))


def read_archives(spark: SparkSession, paths: list[str], members: int = MEMBERS, size: int = BYTES) -> DataFrame:
    """archive, path, length, modified, content, error of the files in ZIP archives that all workers can reach.

    One task reads up to ``members`` files of one archive, or ``size`` stored bytes.  A file that cannot be read, or whose
    path leaves the archive, is a row with an error and no content; it stops no other.
    """
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("archive").option("members", members).option("bytes", size).load("\n".join(paths))


def write_archives(files: DataFrame, folder: str) -> list[str]:
    """(path, content) as archives below folder, one a task; their names.  An archive is whole or not there: it gets its
    name when it is closed, and the archives of attempts that failed are not among the names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.zip"
        n = 0
        with fs.open_output_stream(f"{root}/.{name}") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for batch in batches:
                for path, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                    z.writestr(path, data or b"")
                    n += 1
        fs.move(f"{root}/.{name}", f"{root}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], names=["name", "n"])

    bounded_batches(files.sparkSession)
    made = files.select("path", F.col("content").cast("binary").alias("content")).mapInArrow(run, "name string, n long")
    return [f"{folder.rstrip('/')}/{r.name}" for r in made.where("n > 0").collect()]


def listing(files: DataFrame) -> DataFrame:
    """archive, folder, files, bytes: the tree of the archives."""
    folder = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    return files.groupBy("archive", folder.alias("folder")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))
