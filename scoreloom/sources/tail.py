"""A stream of the lines that are appended to log files."""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "path string, at long, line string"
#: Bytes of one range of a file, and of the mark by which a file is known again.
RANGE, MARK = 64 << 20, 256
#: Small ranges share a task up to so many bytes, where each range counts as so many more; bytes read first at a file's end.
TASK, OPENING, LAST = 8 << 20, 16 << 10, 4096


def _open(path: str):
    """(file system, path in it) of a path with or without scheme."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


class Piece(NamedTuple):
    path: str
    start: int
    stop: int
    end: int  # of what there is to read of the file
    mark: int | None = None  # of the bytes before start, unless the file was begun anew


class Ranges(InputPartition):
    def __init__(self, pieces: list[Piece]):
        self.pieces = pieces


class LogTail(DataSource):
    """`spark.readStream.format("log_tail").load(folder)`: path, byte position and text of each whole line of the files below, as they grow.

    An offset holds for each file the position up to which it was read, which is the end of a line, and a checksum of the bytes before. A file
    that has become shorter, or whose bytes there have changed, was begun anew and is read from its start.
    """

    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return TailReader(self.options["path"], int(self.options.get("range", RANGE)))


class TailReader(DataSourceStreamReader):
    def __init__(self, folder: str, size: int):
        self.folder, self.size = folder, size

    def initialOffset(self) -> dict:  # noqa: N802
        return {"files": {}}

    def latestOffset(self) -> dict:  # noqa: N802
        from pyarrow import fs

        at, root = _open(self.folder)

        found = {}
        for info in at.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
            if info.type == fs.FileType.File and not info.base_name.startswith((".", "_")):
                with at.open_input_file(info.path) as f:
                    found[info.path] = self._end_and_mark(f, info.size)
        return {"files": found}

    @classmethod
    def _end_and_mark(cls, f, size: int) -> list[int]:
        """The end of the last whole line and the mark there, mostly by a single read."""
        start = max(0, size - LAST)
        f.seek(start)
        block = f.read(size - start)
        cut = block.rfind(b"\n") + 1
        if cut >= MARK or not start:
            return [start + cut, zlib.crc32(block[max(0, cut - MARK) : cut])]
        end = cls._line_end(f, size)
        return [end, cls._mark(f, end)]

    @staticmethod
    def _line_end(f, size: int) -> int:
        """The end of the last whole line; read backwards in steps."""
        end = size
        while end > 0:
            start = max(0, end - (1 << 16))
            f.seek(start)
            cut = f.read(end - start).rfind(b"\n")
            if cut >= 0:
                return start + cut + 1
            end = start
        return 0

    @staticmethod
    def _mark(f, end: int) -> int:
        start = max(0, end - MARK)
        f.seek(start)
        return zlib.crc32(f.read(end - start))

    def partitions(self, start: dict, end: dict) -> list[Ranges]:
        """Ranges of the files that have changed, several small ones a task; whether a file was begun anew is seen by the task that reads on in it."""
        out, full = [], TASK
        for path, (stop, mark) in sorted(end["files"].items()):
            begin, known = start["files"].get(path, (0, 0))
            if [begin, known] == [stop, mark]:
                continue
            if begin >= stop:  # shorter than before, or as long with other bytes
                begin = 0
            for s in range(begin, stop, self.size):
                piece = Piece(path, s, min(stop, s + self.size), stop, known if s and s == begin else None)
                if full + piece.stop - s + OPENING > TASK:
                    out.append(Ranges([]))
                    full = 0
                out[-1].pieces.append(piece)
                full += piece.stop - s + OPENING
        return out

    def read(self, partition: Ranges) -> Iterator[tuple[str, int, str]]:
        """The lines that begin in the ranges."""
        at, _ = _open(self.folder)
        for path, pieces in itertools.groupby(partition.pieces, key=lambda p: p.path):
            with at.open_input_file(path) as f:
                for p in pieces:
                    yield from self._lines(f, p)

    def _lines(self, f, p: Piece) -> Iterator[tuple[str, int, str]]:
        where = p.start
        if p.mark is not None and self._mark(f, where) != p.mark:
            where = 0
        if where:
            f.seek(where - 1)
            if f.read(1) != b"\n":  # in the middle of a line of the range before
                where = self._next(f, where, p.end)
        rest, f_at = b"", where
        while where < p.stop:
            cut = rest.find(b"\n")
            if cut < 0:
                f.seek(f_at)
                more = f.read(min(1 << 20, p.end - f_at))
                if not more:
                    return
                f_at, rest = f_at + len(more), rest + more
                continue
            yield p.path, where, rest[:cut].decode("utf-8", "replace")
            where, rest = where + cut + 1, rest[cut + 1 :]

    @staticmethod
    def _next(f, at: int, end: int) -> int:
        f.seek(at)
        while at < end:
            block = f.read(min(1 << 16, end - at))
            cut = block.find(b"\n")
            if cut >= 0:
                return at + cut + 1
            at += len(block)
        return end


def append_lines(folder: str, rows: Iterator) -> None:
    """Appends each row's line to its file below folder, or begins the file anew if the row says so; rows come file by file."""
    at, root = _open(folder)
    at.create_dir(root, recursive=True)
    for (name, anew), mine in itertools.groupby(rows, key=lambda r: (r["file"], "anew" in r and r["anew"])):
        with (at.open_output_stream if anew else at.open_append_stream)(f"{root}/{name}") as f:
            for r in mine:
                f.write(f"{r['line']}\n".encode())
