"""Pages of document files as a data source: format ``document_pages``, in batch and as a stream.

A file is dealt to tasks by its size; each takes its share of the pages, so one huge file keeps many tasks busy and no task
holds a file. An engine says how many pages a file has and reads a range of them. Files are reached through pyarrow's file
systems, by the workers as well as the driver.
"""

from __future__ import annotations

import importlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import BinaryIO, Protocol

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

#: Bytes of a file for each task, if not set otherwise.
BYTES_PER_TASK = 8 << 20
#: More shares than these are dealt to so many tasks.
MOST_TASKS = 4096
SCHEMA = "path string, page_no int, text string"


class Engine(Protocol):
    """Reads the pages of one open file. Any error means that it can't read the file: no pages."""

    def count(self, file: BinaryIO) -> int: ...

    def read(self, file: BinaryIO, first: int, last: int) -> Iterator[str]:
        """The texts of pages first to last, from 1."""
        ...


class PagedText:
    """Text files whose pages end with a form feed; what follows the last one is a page if it is not empty. One page is held at
    a time."""

    BLOCK = 1 << 20

    def _blocks(self, file: BinaryIO) -> Iterator[bytes]:
        file.seek(0)
        while block := file.read(self.BLOCK):
            yield block

    def count(self, file: BinaryIO) -> int:
        n, last = 0, b"\f"
        for block in self._blocks(file):
            n, last = n + block.count(b"\f"), block[-1:]
        return n + (last != b"\f")

    def read(self, file: BinaryIO, first: int, last: int) -> Iterator[str]:
        page, held = 1, []
        for block in self._blocks(file):
            if page + block.count(b"\f") < first:
                page += block.count(b"\f")
                continue
            *ended, rest = block.split(b"\f")
            for part in ended:
                if first <= page <= last:
                    yield b"".join([*held, part]).decode("utf-8", "replace")
                held, page = [], page + 1
            if page > last:
                return
            if rest and page >= first:
                held.append(rest)
        if held:
            yield b"".join(held).decode("utf-8", "replace")


@dataclass
class Share(InputPartition):
    """The k-th of n shares of a file's pages."""

    path: str
    k: int
    n: int


@dataclass
class Shares(InputPartition):
    """What one task reads, one share after another."""

    own: list[Share]


class _Files:
    """Listing and reading, common to batches and streams."""

    def __init__(self, options: dict[str, str]):
        self.options = {k.lower(): v for k, v in options.items()}

    def _open(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.options["path"]) if "://" in self.options["path"] or self.options["path"].startswith("file:") else (fs.LocalFileSystem(), self.options["path"])

    def found(self) -> list[fs.FileInfo]:
        system, path = self._open()
        suffix = self.options.get("suffix", "")
        files = [f for f in system.get_file_info(fs.FileSelector(path, recursive=True)) if f.type == fs.FileType.File]
        return [f for f in files if f.base_name.endswith(suffix) and not f.base_name.startswith(("_", "."))]

    def shares(self, files: list[fs.FileInfo]) -> list[Share]:
        size = int(self.options.get("bytespertask", BYTES_PER_TASK))
        return [Share(f.path, k, n) for f in files for n in [max(1, -(-f.size // size))] for k in range(n)]

    def dealt(self, files: list[fs.FileInfo]) -> list[Shares]:
        """Shares for tasks: many small ones to a task, neighbours together."""
        every = self.shares(files)
        n = min(len(every), MOST_TASKS)
        return [Shares(every[len(every) * k // n : len(every) * (k + 1) // n]) for k in range(n)]

    def pages(self, share: Share) -> Iterator[tuple[str, int, str]]:
        module, _, name = self.options.get("engine", f"{__name__}:PagedText").partition(":")
        engine: Engine = getattr(importlib.import_module(module), name)()
        with self._open()[0].open_input_file(share.path) as file:
            try:
                total = engine.count(file)
            except Exception:  # an engine may fail where another reads on
                return
            first, last = total * share.k // share.n + 1, total * (share.k + 1) // share.n
            if first <= last:
                for i, text in enumerate(engine.read(file, first, last), first):
                    yield share.path, i, text or ""


class _Reader(_Files, DataSourceReader):
    def partitions(self) -> Sequence[InputPartition]:
        return self.dealt(self.found())

    def read(self, partition: Shares) -> Iterator[tuple]:
        return (page for share in partition.own for page in self.pages(share))


class _StreamReader(_Files, DataSourceStreamReader):
    """Files in order of their time, then of their name. They are written once and appear whole."""

    def initialOffset(self) -> dict:
        return {"at": "0", "path": ""}

    def latestOffset(self) -> dict:
        at, path = max(((f.mtime_ns, f.path) for f in self.found()), default=(0, ""))
        return {"at": str(at), "path": path}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        after, until = ((int(x["at"]), x["path"]) for x in (start, end))
        return self.dealt([f for f in self.found() if after < (f.mtime_ns, f.path) <= until])

    def read(self, partition: Shares) -> Iterator[tuple]:
        return (page for share in partition.own for page in self.pages(share))


class PageSource(DataSource):
    """Options: path, a folder; suffix of file names; engine, as module:Class; bytesPerTask."""

    @classmethod
    def name(cls) -> str:
        return "document_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(dict(self.options))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _StreamReader(dict(self.options))


def read_pages(spark: SparkSession, path: str, stream: bool = False, **options: str | int) -> DataFrame:
    """(path, page_no, text) of the files in a folder."""
    spark.dataSource.register(PageSource)
    source = (spark.readStream if stream else spark.read).format("document_pages")
    return source.options(**{k: str(v) for k, v in options.items()}).load(path)
