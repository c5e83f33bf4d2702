"""A repository's delta files as a Spark data source, for batches and streams.

Rows are client, number, name of the file and the XML of one commit in it, so files are opened and divided in Python and parsed in the JVM.
Filters on client and number choose files before any is opened. A stream's offset is a ledger: the newest number read of each client.
"""

from __future__ import annotations

import codecs
import json
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from xml.parsers import expat

import numpy as np
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from .deltalog import FILE_NAMES
from .storage import file_system

#: A task opens files up to this many bytes together; a larger file is a task of its own and is read as a stream.
TASK_BYTES = 64 << 20
_PART = 1 << 20  # bytes read together
_END = re.compile(rb"</databaseVersion\s*>")


@dataclass
class Files(InputPartition):
    """Files (client, number, name, or name/part) that one task reads."""

    files: list[tuple[str, int, str]]


def delta_files(folder: str) -> list[tuple[str, int, str, int]]:
    """client, number, name, bytes of the delta files in ``folder`` in order of client and number; other files don't count, a missing folder has none. Of one in parts each is told, as name/part."""
    fs, path = file_system(folder)
    infos = fs.get_file_info(arrow_fs.FileSelector(path, allow_not_found=True))
    out = []
    for m, i in [(re.match(FILE_NAMES["database"], i.base_name), i) for i in infos]:
        if m and i.type == arrow_fs.FileType.File:
            out.append((m[1], int(m[2]), i.base_name, i.size))
        elif m:
            parts = fs.get_file_info(arrow_fs.FileSelector(i.path))
            out += [(m[1], int(m[2]), f"{i.base_name}/{p.base_name}", p.size) for p in parts if p.base_name.startswith("part-")]
    return sorted(out)


def grouped(files: list[tuple[str, int, str, int]], most: int) -> list[Files]:
    """``files`` in tasks of neighbours with ``most`` bytes at most, or one file."""
    out, held = [], 0
    for client, number, name, size in files:
        if not out or held + size > most:
            out, held = [*out, Files([])], 0
        out[-1].files.append((client, number, name))
        held += size
    return out


def _utf8(f) -> Iterator[bytes]:
    """The bytes of an XML file in parts, as UTF-8 whatever its byte order mark or declaration says."""
    part = f.read(_PART)
    named = re.match(rb"""<\?xml[^>]*\sencoding\s*=\s*["']([\w.:-]+)""", part)
    name = "utf-16" if part[:2] in (codecs.BOM_UTF16_LE, codecs.BOM_UTF16_BE) else named[1].decode() if named else "utf-8"
    decoder = None if codecs.lookup(name).name in ("utf-8", "ascii") else codecs.getincrementaldecoder(name)()
    while part:
        yield decoder.decode(part).encode() if decoder else part
        part = f.read(_PART)


def commits_in_file(fs: arrow_fs.FileSystem, path: str) -> Iterator[tuple[bytearray, int, int]]:
    """The XML of each commit in a file: UTF-8 bytes, and where it begins and ends there.

    The file is read as a stream and its elements are only passed by, so memory holds the text of a commit and no tree of it.
    """
    parser, held, base, level, start, found = expat.ParserCreate("utf-8"), bytearray(), 0, 0, 0, []

    def opened(tag: str, _) -> None:
        nonlocal level, start
        if tag == "databaseVersion":
            start, level = (start if level else parser.CurrentByteIndex), level + 1

    def closed(tag: str) -> None:
        nonlocal level
        if tag == "databaseVersion":
            level -= 1
            if not level:
                close = _END.match(held, at := parser.CurrentByteIndex - base)
                found.append((start, base + (close.end() if close else at)))  # behind an element without a tag that closes it

    parser.StartElementHandler, parser.EndElementHandler = opened, closed
    with fs.open_input_stream(path) as f:
        for part in _utf8(f):
            held += part
            parser.Parse(part, False)
            if found:
                for begin, end in found:
                    yield held, begin - base, end - base
                held, base = bytearray(memoryview(held)[found[-1][1] - base :]), found[-1][1]
                found.clear()
    parser.Parse(b"", True)


class _Reads:
    def __init__(self, options: dict[str, str]):
        self.folder = options["path"]
        self.most = int(options.get("taskBytes", TASK_BYTES))

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        """A batch for each commit, whose text isn't copied: rows would be collected by the thousand."""
        fs, path = file_system(self.folder)
        for client, number, name in partition.files:
            for held, begin, end in commits_in_file(fs, f"{path}/{name}"):
                text = pa.StringArray.from_buffers(1, pa.py_buffer(np.array([begin, end], np.int32)), pa.py_buffer(held))
                yield pa.RecordBatch.from_arrays([pa.array([client]), pa.array([number], pa.int64()), pa.array([name.split("/")[0]]), text], ["client", "number", "name", "xml"])


class BatchReader(_Reads, DataSourceReader):
    """Keeps the filters that a file's name can answer and opens the files that pass them."""

    TESTS = {
        EqualTo: lambda x, v: x == v, In: lambda x, v: x in v, IsNotNull: lambda x, v: True, GreaterThan: lambda x, v: x > v,
        GreaterThanOrEqual: lambda x, v: x >= v, LessThan: lambda x, v: x < v, LessThanOrEqual: lambda x, v: x <= v,
    }

    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if type(f) in self.TESTS and f.attribute in (("client",), ("number",), ("name",)):
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> Sequence[Files]:
        passes = lambda row: all(self.TESTS[type(f)](row[f.attribute[0]], getattr(f, "value", None)) for f in self.filters)
        return grouped([f for f in delta_files(self.folder) if passes(dict(client=f[0], number=f[1], name=f[2].split("/")[0]))], self.most) or [Files([])]


class StreamReader(_Reads, DataSourceStreamReader):
    """Each client's files beyond its number in the ledger. A client numbers its files upwards, a merged file above those it replaces."""

    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        self.known: dict[str, int] = json.loads(options.get("known", "{}"))
        self.newest = dict(self.known)

    def initialOffset(self) -> dict:
        return self.known

    def latestOffset(self) -> dict:
        for client, number, _, _ in delta_files(self.folder):
            self.newest[client] = max(number, self.newest.get(client, -1))
        return dict(self.newest)

    def partitions(self, start: dict, end: dict) -> Sequence[Files]:
        return grouped([f for f in delta_files(self.folder) if start.get(f[0], -1) < f[1] <= end.get(f[0], -1)], self.most)


class DeltaFiles(DataSource):
    """``spark.read.format("stratalog_deltas").load(folder)``; options ``taskBytes`` and, for streams, ``known`` (JSON, the ledger to start behind)."""

    @classmethod
    def name(cls) -> str:
        return "stratalog_deltas"

    def schema(self) -> str:
        return "client string, number bigint, name string, xml string"

    def reader(self, schema: StructType) -> BatchReader:
        return BatchReader(dict(self.options))

    def streamReader(self, schema: StructType) -> StreamReader:
        return StreamReader(dict(self.options))
