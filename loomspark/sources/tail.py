"""The tail of a growing log as a data source: read by position, from the end, in batch and as a stream.

``spark.read.format("log_tail").option("path", ...).option("lines", 10).load()`` gives the last lines of each file: blocks are read backwards from the end until
they hold enough line ends, so a large file's beginning is never touched. ``spark.readStream`` with the same options begins with these lines and then gives
what is added: an offset is the place in each file up to which whole lines have been given, so a line that is still being written waits for its
end. A file that has become shorter was begun anew and is read from its start; new files are read whole.

Rows are (file, at, value): the file's name, the byte at which the line begins, and its text; bytes that aren't UTF-8 are replaced. Files are read where the
tasks run, so the folder has to be one that all of them see. Register it with ``spark.dataSource.register(LogTail)``.
"""

from __future__ import annotations

import glob
import json
import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

BLOCK, LINES, PART = 1 << 16, 10, 64 << 20


def files(path: str) -> list[str]:
    """A file, the files of a folder, or those that a pattern names, in order."""
    plain = path.removeprefix("file://")
    found = glob.glob(f"{glob.escape(plain)}/*") if os.path.isdir(plain) else glob.glob(plain)
    return sorted(f for f in found if os.path.isfile(f))


def whole_end(path: str, upto: int, since: int = 0) -> int:
    """The place behind the last line end before ``upto``; ``since`` if there is none after it."""
    with open(path, "rb") as f:
        at = upto
        while at > since:
            begin = max(since, at - BLOCK)
            f.seek(begin)
            if (cut := f.read(at - begin).rfind(b"\n")) >= 0:
                return begin + cut + 1
            at = begin
    return since


def tail_start(path: str, lines: int, end: int) -> int:
    """Where the last ``lines`` lines before ``end`` begin; ``end`` is behind a line end."""
    if lines <= 0:
        return end
    with open(path, "rb") as f:
        at, left = end, lines + 1
        while at > 0:
            begin = max(0, at - BLOCK)
            f.seek(begin)
            block = f.read(at - begin)
            cut = len(block)
            while (cut := block.rfind(b"\n", 0, cut)) >= 0:
                left -= 1
                if not left:
                    return begin + cut + 1
            at = begin
    return 0


class Stretch(InputPartition):
    """Bytes of a file from the beginning of one line to the end of another."""

    def __init__(self, file: str, start: int, end: int):
        super().__init__(file)
        self.file, self.start, self.end = file, start, end


def stretches(file: str, start: int, end: int) -> list[Stretch]:
    """A stretch in parts of about ``PART`` bytes, each of whole lines."""
    cuts = [start]
    while end - cuts[-1] > PART:
        cut = whole_end(file, cuts[-1] + PART, cuts[-1])
        if cut <= cuts[-1]:  # one line longer than a part
            break
        cuts.append(cut)
    return [Stretch(file, a, b) for a, b in zip(cuts, [*cuts[1:], end]) if b > a]


def lines_of(part: Stretch) -> Iterator[tuple[str, int, str]]:
    with open(part.file, "rb") as f:
        f.seek(part.start)
        at = part.start
        while at < part.end:
            line = f.readline()
            if not line:
                return
            yield part.file, at, line.rstrip(b"\r\n").decode("utf-8", "replace")
            at += len(line)


class TailReader(DataSourceReader):
    def __init__(self, path: str, lines: int):
        self.path, self.lines = path, lines

    def partitions(self) -> list[Stretch]:
        found = []
        for f in files(self.path):
            # in batch, an unfinished last line is a line
            size = os.path.getsize(f)
            end = whole_end(f, size)
            start = tail_start(f, self.lines - (size > end), end)
            found += stretches(f, start, size)
        return found or [Stretch("", 0, 0)]

    def read(self, partition: Stretch) -> Iterator[tuple[str, int, str]]:
        return lines_of(partition) if partition.file else iter(())


class TailStream(DataSourceStreamReader):
    def __init__(self, path: str, lines: int):
        self.path, self.lines = path, lines

    def initialOffset(self) -> dict:  # noqa: N802
        found = {f: whole_end(f, os.path.getsize(f)) for f in files(self.path)}
        return {"files": json.dumps({f: tail_start(f, self.lines, end) for f, end in found.items()})}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"files": json.dumps({f: whole_end(f, os.path.getsize(f)) for f in files(self.path)})}

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        before, after = json.loads(start["files"]), json.loads(end["files"])
        found = []
        for f, upto in after.items():
            since = before.get(f, 0)
            found += stretches(f, 0 if since > upto else since, upto)
        return found or [Stretch("", 0, 0)]

    def read(self, partition: Stretch) -> Iterator[tuple[str, int, str]]:
        return lines_of(partition) if partition.file else iter(())

    def commit(self, end: dict) -> None:
        """Nothing is kept outside the checkpoint."""


class LogTail(DataSource):
    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return "file string, at long, value string"

    def reader(self, schema) -> TailReader:
        return TailReader(self.options["path"], int(self.options.get("lines", LINES)))

    def streamReader(self, schema) -> TailStream:  # noqa: N802
        return TailStream(self.options["path"], int(self.options.get("lines", LINES)))
