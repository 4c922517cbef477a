"""Follow a growing log file as a streaming source, across rotations.

``spark.readStream.format("follow_lines").option("path", p).load()`` gives line,
offset and file (its identity). A line counts when its line feed has arrived, so
the end offset is always behind a line feed. When the path names another file
than before, the old one and all rotated since are finished first, oldest first,
from beside the path, also while the path is missing; a needed file that is gone
fails. A file that shrank fails, or starts anew with ``onTruncate=restart``.
"""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

BLOCK = 1 << 20
PACKED = ("gz", "bz2", "xz", "zst")


class Range(InputPartition):
    def __init__(self, path: str, identity: str, start: int, end: int):
        self.path, self.identity, self.start, self.end = path, identity, start, end


def identity_of(path: str) -> str:
    s = os.stat(path)
    return f"{s.st_dev}:{s.st_ino}"


def locate(path: str, identity: str) -> str | None:
    """Where the file of that identity lies now: the path itself or a rotated copy beside it."""
    for p in [path, *sorted(glob.glob(glob.escape(path) + ".*"))]:
        try:
            if identity_of(p) == identity:
                return p
        except FileNotFoundError:
            continue
    return None


def siblings(path: str) -> list[tuple[str, str]]:
    """Place and identity of the rotated files, oldest first, and last of the path itself, empty when it is missing; packed copies do not count."""
    try:
        own = identity_of(path)
    except FileNotFoundError:
        own = ""
    found = {}
    for p in glob.glob(glob.escape(path) + ".*"):
        try:
            s = os.stat(p)
        except FileNotFoundError:
            continue
        suffix = p.rsplit(".", 1)[1]
        if suffix not in PACKED and f"{s.st_dev}:{s.st_ino}" != own:
            found[f"{s.st_dev}:{s.st_ino}"] = (s.st_mtime_ns, -int(suffix) if suffix.isdecimal() else 0, p)
    return [*((v[2], i) for i, v in sorted(found.items(), key=lambda x: x[1])), (path, own)]


def last_line_end(path: str, start: int) -> int:
    """Offset behind the last line feed at or after ``start``, else ``start``; reads backwards in blocks."""
    end = os.path.getsize(path)
    with open(path, "rb") as f:
        while end > start:
            low = max(start, end - BLOCK)
            f.seek(low)
            at = f.read(end - low).rfind(b"\n")
            if at >= 0:
                return low + at + 1
            end = low
    return start


class FollowReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.restart = options.get("onTruncate", "fail") == "restart"
        self.latest = options.get("startingPosition", "earliest") == "latest"

    def initialOffset(self) -> dict:
        now = self.latestOffset()
        return now if self.latest else now | {"offset": 0}

    def latestOffset(self) -> dict:
        """Identity and end of the file the path names now, empty while it is missing; ``done`` has those of the rotated files, oldest first."""
        seen = siblings(self.path)
        while (again := siblings(self.path)) != seen:  # a rotation was under way
            seen = again
        *done, (here, identity) = seen
        ends = [[i, last_line_end(locate(self.path, i) or p, 0)] for p, i in done]
        return {"identity": identity, "offset": last_line_end(locate(self.path, identity) or here, 0) if identity else 0, "done": ends}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        known, files = self._files(start), self._files(end)
        order = [i for i, _ in files]
        newest = known[-1][0] if known else ""
        if newest and newest not in order:
            raise ValueError("Lost: the file that was read last is gone")
        out, at = [], dict(known)
        for n, (identity, stop) in enumerate(files):
            if identity not in at and newest and n < order.index(newest):
                continue  # older than all that was followed
            begin = at.get(identity, 0)
            if stop < begin:
                if not self.restart:
                    raise ValueError("Truncated: the file is shorter than the position in it")
                begin = 0
            if stop > begin:
                here = locate(self.path, identity)
                if not here:
                    raise ValueError("Lost: a file with unread lines is gone")
                out.append(Range(here, identity, begin, stop))
        return out

    @staticmethod
    def _files(offset: dict) -> list:
        return [*map(tuple, offset["done"]), *([(offset["identity"], offset["offset"])] if offset["identity"] else [])]

    def read(self, partition: Range) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            f.seek(partition.start)
            at = partition.start
            while at < partition.end:
                raw = f.readline()
                yield raw[:-1].decode("utf-8", "replace"), at, partition.identity
                at += len(raw)

    def commit(self, end: dict) -> None:
        pass


class FollowLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "follow_lines"

    def schema(self) -> str:
        return "line string, offset long, file string"

    def streamReader(self, schema: StructType) -> FollowReader:
        return FollowReader(self.options)
