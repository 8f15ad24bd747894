"""Tail of growing log files as a stream: format `log_tail`.

The source watches a folder on storage that driver and executors share as a file system. The
driver lists names, times and sizes; it opens no file. A micro-batch covers the bytes added since
the last one, cut into ranges that run in parallel. A line belongs to the range that holds its line
end, and the task looks back for its begin, so no line is lost or read twice, and a last line
without line end waits for the rest.

An offset holds a moment (`mark`) and the sizes of the files changed since (`open`), not of all files
ever seen. The mark is `idleSeconds` before the newest change. What changed between two marks has
been read to its end. A file that grows again after it was left behind the mark is read again
from its begin, which the byte positions show; nothing is lost.

Options: `path`, `glob`, `fromByte`, `rangeBytes`, `idleSeconds`, and `maxBytesPerBatch`, which limits
a micro-batch of a stream that keeps running (this Spark hands sources of this kind no limits, so a
run with `availableNow` takes one micro-batch and should set none).
"""

from __future__ import annotations

import glob
import os
import stat
from collections.abc import Iterator
from typing import BinaryIO

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import LongType, StringType, StructField, StructType

_SCHEMA = StructType(
    [
        StructField("file", StringType()),
        StructField("byte_start", LongType()),
        StructField("line", StringType()),
    ]
)
_CHUNK = 65_536


class _Ranges(InputPartition):
    """Byte ranges read by one task: (path, start, end)."""

    def __init__(self, ranges: list[tuple[str, int, int]]):
        self.ranges = ranges


def _line_end(log: BinaryIO, start: int, end: int) -> int:
    """Position of the first line end in [start, end), or -1."""
    for at in range(start, end, _CHUNK):
        log.seek(at)
        found = log.read(min(_CHUNK, end - at)).find(b"\n")
        if found >= 0:
            return at + found
    return -1


def _line_begin(log: BinaryIO, at: int, floor: int) -> int:
    """Begin of the line that `at` lies in, looking back no further than `floor`."""
    while at > floor:
        begin = max(floor, at - _CHUNK)
        log.seek(begin)
        found = log.read(at - begin).rfind(b"\n")
        if found >= 0:
            return begin + found + 1
        at = begin
    return floor


class LogTailReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.pattern = os.path.join(options["path"], options.get("glob", "*"))
        self.from_byte = int(options.get("fromByte", "0"))
        self.range_bytes = int(options.get("rangeBytes", str(64 << 20)))
        self.idle = int(float(options.get("idleSeconds", str(7 * 86_400))) * 1e9)
        self.limit = int(options.get("maxBytesPerBatch", "0"))
        self.last: dict = {"mark": -1, "open": {}}

    def _files(self, since: int) -> dict[str, tuple[int, int]]:
        """Moment of the last change and size of the files changed after `since`."""
        found = {}
        for path in glob.glob(self.pattern):
            try:
                about = os.stat(path)
            except FileNotFoundError:  # gone since it was listed
                continue
            if stat.S_ISREG(about.st_mode) and about.st_ctime_ns > since:
                found[path] = (about.st_ctime_ns, about.st_size)
        return found

    def initialOffset(self) -> dict:
        return {"mark": -1, "open": {}}

    def latestOffset(self) -> dict:
        last = self.last
        files = self._files(last["mark"])
        if not files:
            return last
        mark = max(max(changed for changed, _ in files.values()) - self.idle, last["mark"])
        sizes, room = {}, self.limit or sum(size for _, size in files.values())
        for path, (_, size) in sorted(files.items(), key=lambda item: (item[1][0], item[0])):
            begin = last["open"].get(path, 0)
            sizes[path] = min(size, begin + room)
            room -= max(sizes[path] - begin, 0)
        if all(sizes[path] == size for path, (_, size) in files.items()):
            sizes = {path: size for path, size in sizes.items() if files[path][0] > mark}
        else:
            mark = last["mark"]
        self.last = {"mark": mark, "open": sizes}
        return self.last

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        """Large additions are cut, small ones share a task, up to `rangeBytes` each."""
        if end["mark"] >= self.last["mark"]:
            self.last = end
        stops = dict(end["open"])
        for path, (changed, size) in self._files(start["mark"]).items():
            if path not in stops and changed <= end["mark"]:
                stops[path] = size
        tasks, held = [[]], 0
        for path, stop in sorted(stops.items()):
            for at in range(max(start["open"].get(path, 0), self.from_byte), stop, self.range_bytes):
                upto = min(at + self.range_bytes, stop)
                if tasks[-1] and held + upto - at > self.range_bytes:
                    tasks.append([])
                    held = 0
                tasks[-1].append((path, at, upto))
                held += upto - at
        return [_Ranges(t) for t in tasks if t]

    def read(self, partition: _Ranges) -> Iterator[tuple]:
        for path, start, end in partition.ranges:
            with open(path, "rb") as log:
                at = _line_end(log, start, end)
                if at < 0:
                    continue
                at = _line_begin(log, at, self.from_byte)
                log.seek(at)
                while at < end:
                    raw = log.readline()
                    if not raw.endswith(b"\n") or at + len(raw) > end:
                        break
                    yield (path, at, raw[:-1].decode("utf-8", "replace"))
                    at += len(raw)


class LogTailSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> StructType:
        return _SCHEMA

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return LogTailReader(self.options)
