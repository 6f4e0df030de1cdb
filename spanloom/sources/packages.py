"""Books in zip archives as a data source: read member by member, written book by book.

``spark.read.format("book_archives")`` gives a row for each document of each archive, in reading order. Options: ``path``
(a folder or one archive), ``glob`` (of file names, ``*.epub``), ``bytesPerPartition`` (archives that a task reads, 64 MiB
together; a larger one is a task of its own) and ``mode`` (``permissive``: what can't be read is a row that tells why;
``failfast``: an error). ``df.write.format("book_archives")`` writes rows (book, ord, name, content) as archives.

The files are opened where the tasks run, by path and through the file systems that Arrow knows; an archive is never
held whole, only the member that is being read or written. ``archives.documents`` reads the same through Spark's own
reader, for stores that only Spark reaches.
"""

from __future__ import annotations

import fnmatch
import posixpath
import sys
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.sax.saxutils import quoteattr

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from spanloom.sources.archives import member, reading_order

FORMAT = "book_archives"
#: Bytes of archives that a task reads.
BYTES = 64 << 20
#: Dates are not kept, so that the same rows give the same files.
DATE = (1980, 1, 1, 0, 0, 0)
CONTAINER = b'<?xml version="1.0"?><container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>'
NAVIGATION = b'<html xmlns="http://www.w3.org/1999/xhtml"><head><title>Navigation</title></head><body><nav><ol></ol></nav></body></html>'


def file_system(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system of a path, and the path in it; without a scheme, or with file:, the local one."""
    if path.startswith("file:"):
        return arrow_fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    if "://" in path:
        return arrow_fs.FileSystem.from_uri(path)
    return arrow_fs.LocalFileSystem(), path


@dataclass
class Share(InputPartition):
    """The archives that one task reads."""

    paths: list[str]


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.glob = options["path"], options.get("glob", "*.epub")
        self.bytes, self.strict = int(options.get("bytesPerPartition", BYTES)), options.get("mode", "permissive").lower() == "failfast"

    def partitions(self) -> list[Share]:
        """Archives in the order of their names, cut where they add up to the bytes of a task."""
        fs, root = file_system(self.path)
        found = fs.get_file_info(root)
        if found.type == arrow_fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [found] if found.is_file else fs.get_file_info(arrow_fs.FileSelector(root, recursive=True))
        out, size = [Share([])], 0
        for f in sorted(files, key=lambda f: f.path):
            hidden = any(p.startswith(("_", ".")) for p in posixpath.relpath(f.path, root).split("/") if p != ".")
            if f.is_file and (f is found or not hidden and fnmatch.fnmatch(posixpath.basename(f.path), self.glob)):
                if out[-1].paths and size + f.size > self.bytes:
                    out.append(Share([]))
                    size = 0
                out[-1].paths.append(f.path)
                size += f.size
        return out

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        fs, _ = file_system(self.path)
        for path in partition.paths:
            try:
                with fs.open_input_file(path) as file, zipfile.ZipFile(file) as z:
                    for k, name in enumerate(reading_order(z)):
                        content = member(z, name)
                        if content is None and self.strict:
                            raise ValueError(f"{path}: {name} can't be read")
                        yield row(path, k, name, content, None if content is not None else "member can't be read")
            except (zipfile.BadZipFile, OSError, pa.ArrowInvalid) as e:
                if self.strict:
                    raise ValueError(f"{path}: {e}") from e
                yield row(path, None, None, None, str(e))


def row(path: str, k: int | None, name: str | None, content: bytes | None, error: str | None) -> pa.RecordBatch:
    """One document as a batch: the next member is read when this one has been taken."""
    columns = [pa.array([path]), pa.array([k], pa.int32()), pa.array([name], pa.string()), pa.array([content], pa.binary()), pa.array([error], pa.string())]
    return pa.RecordBatch.from_arrays(columns, names=["path", "ord", "name", "content", "error"])


@dataclass
class Written(WriterCommitMessage):
    """What a task has written, and where it waits."""

    folder: str
    names: list[str]


class ArchiveWriter(DataSourceArrowWriter):
    """Each task writes into a folder of its own; only what committed tasks wrote is moved to its place.

    A task that outlives its failed job can leave such a folder, which readers pass over.
    """

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite, self.staging = options["path"], overwrite, f"_temporary-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = file_system(self.path)
        folder, names, at, book = f"{root}/{self.staging}/{uuid.uuid4().hex}", [], None, None
        fs.create_dir(folder, recursive=True)
        for batch in iterator:
            for r in batch.select(["book", "name", "content"]).to_pylist():
                if r["book"] != at or book is None:
                    if book is not None:
                        book.close()
                    at = r["book"]
                    names.append(f"{at}.epub")
                    book = Book(fs, f"{folder}/{names[-1]}")
                book.add(r["name"], r["content"] or b"")
        if book is not None:
            book.close()
        return Written(folder, names)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = file_system(self.path)
        done = [(m.folder, n) for m in messages if m for n in m.names]
        if len({n for _, n in done}) < len(done):
            self.abort(messages)
            raise ValueError("a book's rows must follow one another in one task")
        fs.create_dir(root, recursive=True)
        if self.overwrite:
            for f in fs.get_file_info(arrow_fs.FileSelector(root)):
                if f.is_file and f.path.endswith(".epub"):
                    fs.delete_file(f.path)
        for folder, name in done:
            fs.move(f"{folder}/{name}", f"{root}/{name}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = file_system(self.path)
        if fs.get_file_info(f"{root}/{self.staging}").type != arrow_fs.FileType.NotFound:
            fs.delete_dir(f"{root}/{self.staging}")


class Book:
    """An archive that is being written: members as they come, the package document at the end."""

    def __init__(self, fs: arrow_fs.FileSystem, path: str):
        self.stream = fs.open_output_stream(path)
        self.zip, self.names = zipfile.ZipFile(self.stream, "w", zipfile.ZIP_DEFLATED), []
        self.put("mimetype", b"application/epub+zip", zipfile.ZIP_STORED)
        self.put("META-INF/container.xml", CONTAINER)
        self.put("nav.xhtml", NAVIGATION)

    def put(self, name: str, content: bytes, how: int = zipfile.ZIP_DEFLATED) -> None:
        info = zipfile.ZipInfo(name, DATE)
        info.compress_type = how
        self.zip.writestr(info, content)

    def add(self, name: str, content: bytes) -> None:
        self.names.append(name)
        self.put(name, content)

    def close(self) -> None:
        kind = "application/xhtml+xml"
        items = "".join(f'<item id="d{k}" href={quoteattr(n)} media-type="{kind}"/>' for k, n in enumerate(self.names))
        spine = "".join(f'<itemref idref="d{k}"/>' for k in range(len(self.names)))
        package = f'<?xml version="1.0"?><package xmlns="http://www.idpf.org/2007/opf" version="3.0"><manifest><item id="nav" href="nav.xhtml" media-type="{kind}" properties="nav"/>{items}</manifest><spine><itemref idref="nav"/>{spine}</spine></package>'
        self.put("content.opf", package.encode())
        self.zip.close()
        self.stream.close()


class Archives(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "path string, ord int, name string, content binary, error string"

    def reader(self, schema: StructType) -> ArchiveReader:
        return ArchiveReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to a session. It carries its code along, wherever the workers find their modules."""
    modules = [sys.modules[__name__], sys.modules[reading_order.__module__]]
    for m in modules:
        cloudpickle.register_pickle_by_value(m)
    try:
        spark.dataSource.register(Archives)
    finally:
        for m in modules:
            cloudpickle.unregister_pickle_by_value(m)


def read(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """(path, ord, name, content, error) of the documents of all archives at ``path``."""
    register(spark)
    return spark.read.format(FORMAT).options(**options).load(path)


def write(documents: DataFrame, path: str, mode: str = "append") -> None:
    """Documents (book, ord, name, content) as one archive for each book, named by it."""
    register(documents.sparkSession)
    rows = documents.select("book", "ord", "name", "content").repartition("book").sortWithinPartitions("book", "ord")
    rows.write.format(FORMAT).mode(mode).save(path)
