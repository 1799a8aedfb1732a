"""A live source of captures: a Python data source, batch and stream, over a folder into which programs write.

Option ``mode``: ``whole`` gives a file as one row once it has been there for a listing without growing, ``lines`` gives the lines of files that
grow, as far as they are complete. Partitions are made by size: small files go together, a large file's lines are cut into ranges of bytes. A stream's offset is the number of bytes
taken of each file, so a stream that is started again goes on where it was, and reads no capture twice.

Options: ``path`` (any file system that pyarrow opens), ``cap`` (bytes; a whole capture beyond it is a row with ``error`` instead of its text, or with ``overflow=fail`` ends the query),
``split`` (bytes of a partition), ``suffix`` (of the files' names). Register with ``spark.dataSource.register(Captures)``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .readers import STDIN_CAP

WHOLE = "file string, size long, text string, error string"
LINES = "file string, at long, line string"
_BLOCK = 1 << 20


@dataclass
class Ranges(InputPartition):
    """(file, from, to, size) of each file that a task reads."""

    parts: list[tuple[str, int, int, int]]


def _text(raw: bytes) -> str:
    return raw.decode("utf-8", "replace").replace("\r\n", "\n").replace("\r", "\n")


class _Folder:
    def __init__(self, options: dict):
        if "path" not in options:
            raise ValueError("captures need a path")
        self.mode = options.get("mode", "whole")
        self.fails = options.get("overflow", "row") == "fail"
        if self.mode not in ("whole", "lines") or options.get("overflow", "row") not in ("row", "fail"):
            raise ValueError("mode is whole or lines, overflow row or fail")
        path = options["path"]
        self.path = path if "://" in path else f"file://{path}"
        self.cap, self.split, self.suffix = int(options.get("cap", STDIN_CAP)), int(options.get("split", 64 << 20)), options.get("suffix", "")

    def _open(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path)

    def sizes(self) -> dict[str, int]:
        """Bytes of each file, by its path below the folder; names that begin with a dot or an underscore are being written."""
        system, base = self._open()
        base = base.rstrip("/")
        found = system.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True))
        return {i.path[len(base) + 1 :]: i.size for i in found if i.type == fs.FileType.File and i.base_name.endswith(self.suffix) and i.base_name[0] not in "._"}

    def ends(self, sizes: dict[str, int]) -> dict[str, int]:
        """How far files are taken: whole captures to their end, files of lines to the end of their last complete line."""
        return sizes if self.mode == "whole" else {f: self._line_end(f, n) for f, n in sizes.items()}

    def _line_end(self, file: str, size: int) -> int:
        system, base = self._open()
        with system.open_input_file(f"{base.rstrip('/')}/{file}") as f:
            at = size
            while at > 0:
                k = max(0, at - _BLOCK)
                f.seek(k)
                if (cut := f.read(at - k).rfind(b"\n")) >= 0:
                    return k + cut + 1
                at = k
        return 0

    def plan(self, start: dict[str, int], end: dict[str, int]) -> list[Ranges]:
        """Tasks of about ``split`` bytes."""
        pieces = []
        for file, to in sorted(end.items()):
            at = start.get(file, 0)
            if self.mode == "whole":
                pieces += [(file, 0, to, to)] if file not in start else []
            else:
                pieces += [(file, k, min(k + self.split, to), to) for k in range(at, to, self.split)]
        out, held = [], self.split
        for p in pieces:
            n = min(p[2] - p[1], self.cap) if self.mode == "whole" else p[2] - p[1]
            if held + n > self.split:
                out.append([])
                held = 0
            out[-1].append(p)
            held += max(n, 1)
        return [Ranges(p) for p in out]

    def rows(self, part: Ranges) -> Iterator[tuple]:
        system, base = self._open()
        for file, at, to, size in part.parts:
            path = f"{base.rstrip('/')}/{file}"
            if self.mode == "lines":
                yield from self._lines(system, path, file, at, to, size)
            elif size > self.cap:
                error = f"{file} exceeds {self.cap} byte limit"
                if self.fails:
                    raise ValueError(error)
                yield file, size, None, error
            else:
                with system.open_input_stream(path) as f:
                    yield file, size, _text(f.read(size)), None

    @staticmethod
    def _lines(system: fs.FileSystem, path: str, file: str, at: int, to: int, end: int) -> Iterator[tuple]:
        """Lines that begin in a range, read to their end; a range that begins within a line leaves that line to the one before."""
        with system.open_input_file(path) as f:
            f.seek(max(at - 1, 0))
            held, begin, inside = b"", max(at - 1, 0), at > 0
            read = begin
            while begin < to or inside:
                cut = held.find(b"\n")
                while cut < 0 and read < end:
                    block = f.read(min(_BLOCK, end - read))
                    if not block:
                        return
                    seen, held, read = len(held), held + block, read + len(block)
                    cut = held.find(b"\n", seen)
                if cut < 0:
                    return
                if not inside:
                    yield file, begin, held[:cut].removesuffix(b"\r").decode("utf-8", "replace")
                held, begin, inside = held[cut + 1 :], begin + cut + 1, False


class _Batch(DataSourceReader):
    def __init__(self, folder: _Folder):
        self.folder = folder

    def partitions(self) -> list[Ranges]:
        return self.folder.plan({}, self.folder.ends(self.folder.sizes())) or [Ranges([])]

    def read(self, partition: Ranges) -> Iterator[tuple]:
        return self.folder.rows(partition)


class _Stream(DataSourceStreamReader):
    def __init__(self, folder: _Folder):
        self.folder, self.seen, self.offered = folder, None, set()

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """Bytes taken of each file. A whole capture counts when it has the size that it had at the listing before (all files do at the first listing), and from then on, even if it grows: it isn't read again."""
        sizes = self.folder.sizes()
        before, self.seen = (sizes if self.seen is None else self.seen), sizes
        found = {f: n for f, n in self.folder.ends(sizes).items() if self.folder.mode == "lines" or before.get(f) == n or f in self.offered}
        self.offered |= found.keys()
        return found

    def partitions(self, start: dict, end: dict) -> list[Ranges]:
        return self.folder.plan(start, end)

    def read(self, partition: Ranges) -> Iterator[tuple]:
        return self.folder.rows(partition)

    def commit(self, end: dict) -> None:
        """Nothing is held: files stay where they are."""


class Captures(DataSource):
    """``spark.read.format("captures")`` and ``spark.readStream.format("captures")``; see the module."""

    @classmethod
    def name(cls) -> str:
        return "captures"

    def schema(self) -> str:
        return LINES if _Folder(self.options).mode == "lines" else WHOLE

    def reader(self, schema) -> DataSourceReader:
        return _Batch(_Folder(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(_Folder(self.options))
