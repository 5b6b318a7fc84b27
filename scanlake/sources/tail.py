"""A stream over files that grow: what is appended to a log comes out once.

The offset of the stream is a byte position for each file, always behind a line end, so a line that is still being written waits.
Files that grew are cut into ranges of ``range_bytes``, which are read side by side; a line belongs to the range it begins in.
Rows are blocks of whole lines: file, offset (in bytes), text.

``spark.dataSource.register(LogTail)``, then ``spark.readStream.format("log-tail").option("path", folder)``; options: ``suffix``
(files' names end with it; all by default), ``range_bytes``, ``block_bytes``. The folder is a path or an address that pyarrow opens, on the driver
and on executors. The offset names every file of the folder, so finished logs belong elsewhere. A file that became shorter is
read from its start. Bytes that are no UTF-8 become U+FFFD.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "file string, offset bigint, text string"


def _open(path: str):
    """File system and path within it."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:/"):
        return fs.FileSystem.from_uri(path if "://" in path else path.replace("file:/", "file:///", 1))
    return fs.LocalFileSystem(), path


class Range(InputPartition):
    def __init__(self, file: str, start: int, end: int):
        self.file, self.start, self.end = file, start, end


class LogTail(DataSource):
    @classmethod
    def name(cls) -> str:
        return "log-tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return LogTailReader(self.options)


class LogTailReader(DataSourceStreamReader):
    def __init__(self, options):
        self.path, self.suffix = options["path"].rstrip("/"), options.get("suffix", "")
        self.range_bytes, self.block_bytes = int(options.get("range_bytes", 32 << 20)), int(options.get("block_bytes", 64 << 10))
        self.ends: dict[str, tuple[int, int]] = {}  # size when last looked at, and the line end found then

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """Behind the last line end of each file; only files that changed since the last look are opened."""
        from pyarrow import fs

        system, root = _open(self.path)
        out = {}
        for info in system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
            name = info.path.rsplit("/", 1)[-1]
            if info.type != fs.FileType.File or not name.endswith(self.suffix) or name[0] in "._":
                continue
            if self.ends.get(info.path, (-1,))[0] != info.size:
                self.ends[info.path] = info.size, _last_line_end(system, info.path, info.size)
            out[info.path[len(root) :].lstrip("/")] = self.ends[info.path][1]
        return out

    def partitions(self, start: dict, end: dict) -> list[Range]:
        out = []
        for file, stop in sorted(end.items()):
            low = start.get(file, 0)
            low = 0 if stop < low else low
            out += [Range(file, at, min(at + self.range_bytes, stop)) for at in range(low, stop, self.range_bytes)]
        return out

    def read(self, partition: Range) -> Iterator[tuple[str, int, str]]:
        system, root = _open(self.path)
        with system.open_input_file(f"{root}/{partition.file}") as log:
            at = partition.start
            if at:  # a line that is open here belongs to the range before
                at = _behind_line_end(log, at - 1)
            while at < partition.end:
                log.seek(at)
                block = log.read(min(self.block_bytes, partition.end - at))
                stop = _behind_line_end(log, at + len(block) - 1) if block else at
                block += log.read_at(stop - at - len(block), at + len(block)) if stop > at + len(block) else b""
                if stop <= at:
                    return
                yield partition.file, at, block[: stop - at].decode("utf-8", "replace")
                at = stop

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        pass


def _last_line_end(system, path: str, size: int, step: int = 1 << 16) -> int:
    with system.open_input_file(path) as log:
        high = size
        while high:
            low = max(0, high - step)
            found = log.read_at(high - low, low).rfind(b"\n")
            if found >= 0:
                return low + found + 1
            high = low
    return 0


def _behind_line_end(log, at: int, step: int = 1 << 12) -> int:
    """Place behind the first line end at or after ``at``, or the end of the file."""
    size = log.size()
    while at < size:
        part = log.read_at(min(step, size - at), at)
        found = part.find(b"\n")
        if found >= 0:
            return at + found + 1
        at += len(part)
    return size
