"""Logs that grow: a data source that gives every line of a folder of log files once, with its number, as files are appended to.

``spark.readStream.format("growing_logs")`` follows the files; ``spark.read.format("growing_logs")`` reads them as they are. Both give
``path``, ``line`` (from 1) and ``value``, and shuffle nothing. A stream's offset says of each file how many bytes were read.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from spoolsight.session import ship_package
from spoolsight.sources.lines import MOST_BYTES

#: Bytes of a task at most, of a read, and of a batch of lines.
RANGE, READ = 64 << 20, 4 << 20
#: A file is known again by the sums of so many first bytes, as far as they are written.
HEADS = (16, 64, 256, 1024, 4096)
#: So many ends of a file are remembered with their line numbers; a batch that is given again needs the last but one.
ENDS = 4


@dataclass
class LogRange(InputPartition):
    """Lines that start at bytes ``start`` to ``stop`` of a file. What was read before ends at ``base``; ``end`` is the batch's end."""

    path: str
    known: str
    base: int
    start: int
    stop: int
    end: int


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def _listed(folder: str, suffix: str) -> tuple[pafs.FileSystem, dict[str, int]]:
    fs, root = _open(folder)
    found = fs.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True))
    return fs, {f.path: f.size for f in found if f.is_file and f.path.endswith(suffix) and not f.base_name.startswith((".", "_"))}


def _whole_lines(file: pa.NativeFile, size: int) -> int:
    """Bytes up to the last line end. A last line that is not written whole waits, however long it is."""
    at = size
    while at > 0:
        begin = max(0, at - (1 << 16))
        file.seek(begin)
        last = file.read(at - begin).rfind(b"\n")
        if last >= 0:
            return begin + last + 1
        at = begin
    return 0


def _seen(fs: pafs.FileSystem, path: str, size: int) -> list:
    """[bytes, [sums of the first bytes]] of a file as it is."""
    with fs.open_input_file(path) as file:
        whole = _whole_lines(file, size)
        file.seek(0)
        head = file.read(min(HEADS[-1], whole))
    return [whole, [zlib.crc32(head[:n]) for n in HEADS if n <= whole]]


def same_file(before: list, now: list) -> bool:
    """Whether a file has only grown: it is no shorter, and begins as it did."""
    return now[0] >= before[0] and now[1][: len(before[1])] == before[1]


def moved(start: dict[str, list], end: dict[str, list]) -> dict[str, tuple[str, int]]:
    """For each file of ``end`` under which name it was read before, and how far.

    A file that was cut or replaced is read from its start. One that has appeared under a new name, and begins as one that
    has gone from its own name or was replaced there, is that one, renamed: it is read on.
    """
    out = {p: (p, start[p][0]) for p, now in end.items() if p in start and same_file(start[p], now)}
    left = {p: before for p, before in start.items() if p not in out and before[1]}
    for p in sorted(end.keys() - out.keys()):
        was = next((q for q, before in sorted(left.items(), key=lambda x: -x[1][0]) if same_file(before, end[p])), None)
        out[p] = (was, left.pop(was)[0]) if was is not None else (p, 0)
    return out


def ranges(start: dict[str, list], end: dict[str, list], size: int) -> list[LogRange]:
    """The batch between two offsets, in ranges of ``size`` bytes."""
    out = []
    for path, (known, base) in moved(start, end).items():
        stop = end[path][0]
        out += [LogRange(path, known, base, at, min(at + size, stop), stop) for at in range(base, stop, size)]
    return out


class _Logs:
    """What batch and stream share: options, and reading a range."""

    def __init__(self, options: dict):
        self.folder, self.suffix, self.index = options["path"], options.get("suffix", ""), options.get("index")
        self.size = int(options.get("rangebytes", RANGE))

    def files(self) -> dict[str, list]:
        fs, sizes = _listed(self.folder, self.suffix)
        return {path: _seen(fs, path, size) for path, size in sorted(sizes.items())}

    def _ends(self, path: str) -> tuple[pafs.FileSystem, str] | None:
        if not self.index:
            return None
        fs, root = _open(self.index)
        return fs, f"{root}/{hashlib.sha256(path.encode()).hexdigest()}.json"

    def _lines_before(self, r: LogRange, file: pa.NativeFile) -> int:
        """Lines before ``start``: as remembered up to ``base``, the others counted."""
        at, lines = 0, 0
        where = self._ends(r.known)
        if r.base and where is not None and where[0].get_file_info(where[1]).type == pafs.FileType.File:
            with where[0].open_input_file(where[1]) as told:
                ends = dict(map(tuple, json.loads(told.read())))
            if r.base in ends:
                at, lines = r.base, ends[r.base]
        file.seek(at)
        while at < r.start:
            data = file.read(min(READ, r.start - at))
            lines, at = lines + data.count(b"\n"), at + len(data)
        return lines

    def _remember(self, r: LogRange, lines: int) -> None:
        where = self._ends(r.path)
        if where is None:
            return
        fs, path = where
        fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        ends = []
        if r.base and fs.get_file_info(path).type == pafs.FileType.File:
            with fs.open_input_file(path) as told:
                ends = [e for e in json.loads(told.read()) if e[0] <= r.base]
        fresh = f"{path}.{r.end}.tmp"
        with fs.open_output_stream(fresh) as out:
            out.write(json.dumps([*ends[-ENDS:], [r.end, lines]]).encode())
        fs.move(fresh, path)

    def lines(self, r: LogRange) -> Iterator[pa.RecordBatch]:
        """Good lines of a range in batches. Blank lines count and are left out; of lines over 10 MiB one byte more is given."""
        fs, _ = _open(self.folder)
        with fs.open_input_file(r.path) as file:
            number = self._lines_before(r, file)
            at = r.start
            if at > r.base:  # a line that began in the range before belongs to it
                file.seek(at - 1)
                while head := file.read(1 << 16):
                    cut = head.find(b"\n")
                    at += len(head) if cut < 0 else cut
                    if cut >= 0:
                        break
                number += at > r.start
            file.seek(at)
            begin, rest = at, b""  # where the line at hand starts, and what was read of it
            while begin < r.stop and (data := file.read(min(READ, r.end - at))):
                place, numbers, values = 0, [], []
                while begin < r.stop and (cut := data.find(b"\n", place)) >= 0:
                    line = (rest + data[place:cut])[: MOST_BYTES + 1].removesuffix(b"\r")
                    rest, place, number = b"", cut + 1, number + 1
                    begin = at + place
                    if line.strip():
                        numbers.append(number)
                        values.append(line.decode("utf-8", "replace"))
                rest = (rest + data[place:])[: MOST_BYTES + 1]
                at += len(data)
                if numbers:
                    yield pa.RecordBatch.from_arrays([pa.array([r.path] * len(numbers)), pa.array(numbers, "int64"), pa.array(values)], names=["path", "line", "value"])
            if r.stop == r.end:
                self._remember(r, number)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.logs = _Logs(options)

    def partitions(self) -> list[LogRange]:
        return ranges({}, self.logs.files(), self.logs.size)

    def read(self, partition: LogRange | None) -> Iterator[pa.RecordBatch]:
        return iter(()) if partition is None else self.logs.lines(partition)  # without files Spark asks for none


class _StreamReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.logs = _Logs(options)

    def initialOffset(self) -> dict:
        return {"files": {}}

    def latestOffset(self) -> dict:
        return {"files": self.logs.files()}

    def partitions(self, start: dict, end: dict) -> list[LogRange]:
        return ranges(start["files"], end["files"], self.logs.size)

    def read(self, partition: LogRange) -> Iterator[pa.RecordBatch]:
        return self.logs.lines(partition)

    def commit(self, end: dict) -> None:
        """Nothing to let go of: what is remembered of a file is one small object."""


class GrowingLogs(DataSource):
    """Options: ``path`` (folder, searched with all below it), ``suffix`` of file names, ``index`` (folder for line numbers of ends, so that
    a stream does not count a file's old lines anew), ``rangebytes`` (bytes of a task)."""

    @classmethod
    def name(cls) -> str:
        return "growing_logs"

    def schema(self) -> str:
        return "path string, line long, value string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options)


def read_growing(spark: SparkSession, folder: str, index: str | None = None, stream: bool = True, suffix: str = "", range_bytes: int = RANGE) -> DataFrame:
    """Lines of a folder of logs: ``path``, ``line``, ``value``; each once, and with ``stream`` those that are appended later.

    A line counts when its end is written. Between two triggers a file may grow, be cut, be replaced or be renamed; what was
    replaced is read anew. A file that was replaced by one with the same first bytes and more of them is taken for grown.
    The offset has an entry a file, so logs that are done should leave the folder. ``index`` is a folder that all nodes share.
    ``split_lines`` makes parsed lines and issues of the result.
    """
    ship_package(spark)
    spark.dataSource.register(GrowingLogs)
    reader = (spark.readStream if stream else spark.read).format("growing_logs")
    if index is not None:
        reader = reader.option("index", index)
    return reader.option("suffix", suffix).option("rangeBytes", range_bytes).load(folder)
