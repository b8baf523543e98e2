"""Tail of line files that grow in place, as a Structured Streaming source.

``spark.readStream.format("line_tail")`` gives (path, offset, line) for every
complete line below a folder. The source's offset is the length of each file
seen, so a micro-batch reads byte ranges only: what was appended since the
last one, cut into ranges of ``maxRangeBytes`` that tasks read side by side.
A line belongs to the range that holds its line feed; a task that starts
inside a line looks back for its beginning. A last line without a line feed
therefore waits until it is complete and arrives once then, no range repeats
or splits a line, and a restart goes on from the checkpoint.

Options: ``path`` (any URI that Arrow's file systems open), ``glob`` (of file
names, ``*.jsonl``), ``startAt`` (``beginning``, or ``end`` to leave out what
is there when the stream is first started), ``maxRangeBytes`` (64 MiB). A file
that has become shorter is read from its start again. Empty lines are left
out. Files and their lengths pass the driver, never their contents.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .commit_events import COMMIT_EVENT_SCHEMA, valid_events

CHUNK = 1 << 20


@dataclass
class ByteRange(InputPartition):
    path: str
    start: int
    end: int

    def __post_init__(self):
        super().__init__((self.path, self.start, self.end))


def _open(uri: str):
    """(file system, path) of a URI or an absolute local path. Spark writes
    ``file:/x`` for local files and does not escape names in it."""
    from pyarrow import fs

    if uri.startswith(("file:", "/")):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def file_lengths(uri: str, glob: str) -> dict[str, int]:
    """Path -> length of the files below ``uri``; none if it is not there."""
    from fnmatch import fnmatch

    from pyarrow import fs

    system, root = _open(uri)
    found = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    return {i.path: i.size for i in found if i.type == fs.FileType.File and fnmatch(i.base_name, glob)}


def ranges(before: dict[str, int], now: dict[str, int], most: int) -> list[ByteRange]:
    """Byte ranges that ``now`` has and ``before`` had not."""
    out = []
    for path, end in sorted(now.items()):
        start = before.get(path, 0)
        start = start if start <= end else 0  # cut or written anew
        out += [ByteRange(path, a, min(a + most, end)) for a in range(start, end, most)]
    return out


def _line_start(f, at: int) -> int:
    """Where the line begins whose line feed is the first at or after ``at``."""
    while at > 0:
        a = max(0, at - CHUNK)
        f.seek(a)
        found = f.read(at - a).rfind(b"\n")
        if found >= 0:
            return a + found + 1
        at = a
    return 0


def open_file(uri: str):
    """A file of any of Arrow's file systems, for random reads."""
    system, path = _open(uri)
    return system.open_input_file(path)


def lines_of(f, start: int, end: int, last: bool = False) -> Iterator[tuple[int, bytes]]:
    """(offset, line) of the lines whose line feed lies in [start, end); with
    ``last`` also what follows the last line feed."""
    begin = _line_start(f, start)
    f.seek(begin)
    at, kept = begin, []
    while at < end:
        data = f.read(min(CHUNK, end - at))
        if not data:
            break
        at += len(data)
        *whole, rest = data.split(b"\n")
        for line in whole:
            kept.append(line)
            line = b"".join(kept)
            yield begin, line.removesuffix(b"\r")
            begin, kept = begin + len(line) + 1, []
        kept.append(rest)
    if last and (line := b"".join(kept)):
        yield begin, line.removesuffix(b"\r")


class _Ranges:
    def __init__(self, options):
        self.uri, self.glob = options["path"], options.get("glob", "*.jsonl")
        self.most = int(options.get("maxRangeBytes", 64 << 20))
        self.from_end = options.get("startAt", "beginning") == "end"

    def read(self, part: ByteRange):
        import pyarrow as pa

        def batch():
            text = pa.array(lines, pa.binary()).cast(pa.string(), safe=False)
            return pa.RecordBatch.from_arrays([pa.array([part.path] * len(lines)), pa.array(offsets, pa.int64()), text], ["path", "offset", "line"])

        system, _ = _open(self.uri)
        offsets, lines, size = [], [], 0
        with system.open_input_file(part.path) as f:
            for offset, line in lines_of(f, part.start, part.end):
                if line:
                    offsets.append(offset)
                    lines.append(line.decode("utf-8", "replace").encode())
                    size += len(line)
                if size >= 4 * CHUNK:
                    yield batch()
                    offsets, lines, size = [], [], 0
        if lines:
            yield batch()


class _Stream(_Ranges, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"files": json.dumps(file_lengths(self.uri, self.glob) if self.from_end else {})}

    def latestOffset(self) -> dict:
        return {"files": json.dumps(file_lengths(self.uri, self.glob), sort_keys=True)}

    def partitions(self, start: dict, end: dict):
        return ranges(json.loads(start["files"]), json.loads(end["files"]), self.most)


class _Batch(_Ranges, DataSourceReader):
    def partitions(self):
        return ranges({}, file_lengths(self.uri, self.glob), self.most)


class LineTail(DataSource):
    @classmethod
    def name(cls) -> str:
        return "line_tail"

    def schema(self) -> str:
        return "path string, offset bigint, line string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options)

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options)


def tail_lines(spark: SparkSession, path: str, glob: str = "*.jsonl", start_at: str = "beginning", **options) -> DataFrame:
    """The stream of complete lines of growing files."""
    spark.dataSource.register(LineTail)
    return spark.readStream.format("line_tail").option("glob", glob).option("startAt", start_at).options(**options).load(path)


def commit_events_of(lines: DataFrame) -> DataFrame:
    """S5 on tailed lines: valid commit events with their file and offset."""
    event = F.from_json("line", COMMIT_EVENT_SCHEMA, {"columnNameOfCorruptRecord": "_corrupt_record"})
    return valid_events(lines.select("path", "offset", event.alias("e")).select("path", "offset", "e.*"))
