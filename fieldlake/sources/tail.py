"""``growing_text``: a source for text files that are still being appended to.

Spark's file source takes files as finished.  This one keeps a byte offset per
file: a micro-batch holds the complete lines added since the last one, a final
line without a line break waits, and a new file starts at zero.

Offsets are ``{"files": {path: [end, generation, head, digest]}}``.  A file that
became shorter, or whose first ``head`` bytes no longer have that digest, was
replaced: its generation grows and it is read from its start.

``maxBytes`` bounds a batch: what files have beyond it is left to the next one, at
a line break, and files with little to read come before those with much.  The
driver only probes files that changed, side by side; the bytes themselves are
read by tasks, in ranges of at most ``splitBytes`` cut at line breaks.  With ``tasks``
a batch is dealt out to about so many tasks: small ranges share one, large ones shrink.
"""

from __future__ import annotations

import fnmatch
import hashlib
import json
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

FORMAT = "growing_text"
SCHEMA = "path string, range_start bigint, range_end bigint, pos bigint, line string"
SPLIT_BYTES = 128 * 1024 * 1024
READ_BYTES = 8 * 1024 * 1024
LEAST_TASK_BYTES = 4 * 1024 * 1024
PROBE_BYTES = 64 * 1024
HEAD_BYTES = 4096
PROBES = 32  # listings and probes that the driver has under way at once
QUARANTINE = "_quarantine"

_ARROW = pa.schema(
    [
        ("path", pa.string()),
        ("range_start", pa.int64()),
        ("range_end", pa.int64()),
        ("pos", pa.int64()),
        ("line", pa.string()),
    ]
)


@dataclass
class FileRange(InputPartition):
    """One task: the lines that begin in ``[begin, end)`` of a file range."""

    path: str
    range_start: int
    range_end: int
    begin: int
    end: int


@dataclass
class Ranges(InputPartition):
    """Several ranges for one task."""

    ranges: list[FileRange] = field(default_factory=list)


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    scheme, mark, rest = path.partition("://")
    if mark and scheme in ("s3a", "s3n"):
        return pafs.FileSystem.from_uri(f"s3://{rest}")
    if mark and scheme != "file":
        return pafs.FileSystem.from_uri(path)
    local = rest if mark else path.removeprefix("file:")
    return pafs.LocalFileSystem(), local


def _has_wildcard(part: str) -> bool:
    return any(mark in part for mark in "*?[")


def _side_by_side(function, items: list) -> list:
    """Results of many small reads; a few of them run at once."""
    if len(items) < 2:
        return [function(item) for item in items]
    with ThreadPoolExecutor(min(PROBES, len(items))) as pool:
        return list(pool.map(function, items))


def list_matches(pattern: str) -> dict[str, tuple[int, int]]:
    """Files matching one pattern as ``{path: (size, modified ns)}``, not recursive; folders of a level are listed side by side.

    A path that exists as it is written counts as that file, whatever signs it has.
    """
    filesystem, path = _filesystem(pattern)
    prefix = pattern[: len(pattern) - len(path)] if pattern.endswith(path) else ""
    parts = path.split("/")
    fixed = next((i for i, part in enumerate(parts) if _has_wildcard(part)), len(parts))
    literal = filesystem.get_file_info(path)
    if fixed == len(parts) or literal.type == pafs.FileType.File:
        infos = [literal]
    else:
        level = ["/".join(parts[:fixed])]
        infos = []
        for depth, part in enumerate(parts[fixed:], start=fixed):
            listed = _side_by_side(
                lambda folder: filesystem.get_file_info(pafs.FileSelector(folder or ".", allow_not_found=True)), level
            )
            infos = [
                info
                for found in listed
                for info in found
                if fnmatch.fnmatchcase(info.base_name, part) and (part.startswith(".") or not info.base_name.startswith("."))
            ]
            if depth < len(parts) - 1:
                level = [info.path for info in infos if info.type == pafs.FileType.Directory]
    return {
        prefix + info.path: (info.size, info.mtime_ns or 0)
        for info in infos
        if info.type == pafs.FileType.File and QUARANTINE not in info.path.split("/")
    }


def last_line_end(path: str, size: int, probe: int = PROBE_BYTES) -> int:
    """Offset just after the last line break, found backwards from the end."""
    filesystem, local = _filesystem(path)
    with filesystem.open_input_file(local) as handle:
        end = size
        while end > 0:
            begin = max(0, end - probe)
            handle.seek(begin)
            found = handle.read(end - begin).rfind(b"\n")
            if found >= 0:
                return begin + found + 1
            end = begin
    return 0


def first_line_end(path: str, begin: int, end: int, probe: int = PROBE_BYTES) -> int:
    """Offset just after the first line break from ``begin`` on, ``end`` if there is none."""
    filesystem, local = _filesystem(path)
    with filesystem.open_input_file(local) as handle:
        while begin < end:
            handle.seek(begin)
            found = handle.read(min(probe, end - begin)).find(b"\n")
            if found >= 0:
                return begin + found + 1
            begin += probe
    return end


def head_digest(path: str, length: int) -> str:
    """Digest of the first ``length`` bytes."""
    filesystem, local = _filesystem(path)
    with filesystem.open_input_file(local) as handle:
        return hashlib.sha256(handle.read(length)).hexdigest()[:16]


def as_entry(value) -> list:
    """An offset entry ``[end, generation, head, digest]``; a bare number has no head to compare."""
    return list(value) if isinstance(value, (list, tuple)) else [int(value), 0, 0, ""]


def probe_file(path: str, state: tuple[int, int], known: list | None) -> list:
    """The entry of a file up to its last line break, given the entry reached so far."""
    size = state[0]
    end, generation, head, digest = as_entry(known or 0)
    # Offsets from elsewhere may have no head; then only the size tells.
    if known is not None and (size < end or (head and head_digest(path, head) != digest)):
        end, generation, head, digest = 0, generation + 1, 0, ""
    stop = max(end, last_line_end(path, size))
    grown = min(stop, HEAD_BYTES)
    if grown > head:
        head, digest = grown, head_digest(path, grown)
    return [stop, generation, head, digest]


def begin_of(start: list | None, end: list) -> int:
    """Where a batch begins to read a file: where the last one ended, or at zero in a new generation."""
    return start[0] if start is not None and start[1] == end[1] else 0


def plan_batch(start: dict[str, list], ready: dict[str, list], max_bytes: int) -> dict[str, list]:
    """Entries that one batch of at most ``max_bytes`` reaches; without a bound all that is ready.

    Every file gets an equal share of what the smaller ones left over, cut at a line
    break; a single line that is longer than the share goes whole, so each file with
    something to read moves on as long as a byte is left.
    """
    planned = {path: [begin_of(start.get(path), entry), *entry[1:]] for path, entry in ready.items()}
    waiting = sorted((entry[0] - planned[path][0], path) for path, entry in ready.items() if entry[0] > planned[path][0])
    left = max_bytes if max_bytes > 0 else sum(size for size, _ in waiting)
    for place, (size, path) in enumerate(waiting):
        if left <= 0:
            break
        share = max(1, left // (len(waiting) - place))
        begin, stop = planned[path][0], ready[path][0]
        if size > share:
            stop = last_line_end(path, begin + share)
            stop = stop if stop > begin else first_line_end(path, begin, ready[path][0])
        planned[path][0] = stop
        left -= stop - begin
    # A head that reaches past the planned end still names the same file.
    return planned


def split_range(path: str, start: int, end: int, split_bytes: int) -> list[FileRange]:
    return [
        FileRange(path, start, end, begin, min(begin + split_bytes, end)) for begin in range(start, end, split_bytes)
    ]


def pack_ranges(ranges: list[FileRange], split_bytes: int) -> list[Ranges]:
    """Tasks of about ``split_bytes``, ranges in their order: many small files share one."""
    tasks, held = [], 0
    for part in ranges:
        size = part.end - part.begin
        if not tasks or held + size > split_bytes:
            tasks.append(Ranges([]))
            held = 0
        tasks[-1].ranges.append(part)
        held += size
    return tasks


def cut_tasks(files: list[tuple[str, int, int]], split_bytes: int, tasks: int = 0) -> list[Ranges]:
    """Tasks for ``(path, begin, end)`` of files: ranges of at most ``split_bytes``.

    With ``tasks`` a task takes its share of all bytes, whatever the ranges are, but no
    more than ``SPLIT_BYTES`` (or one range), and no less than 4 MiB if ranges allow.
    """
    held = split_bytes
    if tasks:
        share = -(-sum(end - begin for _, begin, end in files) // tasks)
        held = min(max(split_bytes, SPLIT_BYTES), max(min(split_bytes, LEAST_TASK_BYTES), share))
    parts = [p for path, begin, end in files for p in split_range(path, begin, end, min(split_bytes, held))]
    return pack_ranges(parts, held)


def _decode(chunk: bytes, breaks: np.ndarray) -> list[str]:
    """Lines of a chunk that ends with a line break, without their breaks."""
    try:
        lines = chunk.decode("utf-8").split("\n")[:-1]
    except UnicodeDecodeError:
        starts = np.concatenate(([0], breaks[:-1] + 1))
        lines = [chunk[a:b].decode("utf-8", errors="replace") for a, b in zip(starts, breaks)]
    return [line[:-1] if line.endswith("\r") else line for line in lines]


def read_range(part: FileRange, read_bytes: int = READ_BYTES) -> Iterator[pa.RecordBatch]:
    """Arrow batches with the lines that begin inside the task's range.

    A range that starts inside a line leaves that line to the task before it,
    and the last line is read past the end of the range, in small steps.
    """
    filesystem, local = _filesystem(part.path)
    with filesystem.open_input_file(local) as handle:
        position = part.begin
        skip_first = False
        if part.begin > part.range_start:
            handle.seek(part.begin - 1)
            skip_first = handle.read(1) != b"\n"
        handle.seek(position)
        pending = b""
        while position < part.range_end:
            ahead = part.end - position if position < part.end else max(PROBE_BYTES, len(pending))
            data = handle.read(min(read_bytes, ahead, part.range_end - position))
            if not data:
                break
            base = position - len(pending)
            position += len(data)
            chunk = pending + data
            cut = chunk.rfind(b"\n") + 1
            pending = chunk[cut:]
            chunk = chunk[:cut]
            if skip_first and chunk:
                first = chunk.find(b"\n") + 1
                chunk, base, skip_first = chunk[first:], base + first, False
            if not chunk:
                if not skip_first and position - len(pending) >= part.end:
                    break
                continue
            breaks = np.flatnonzero(np.frombuffer(chunk, dtype=np.uint8) == 10)
            starts = np.concatenate(([0], breaks[:-1] + 1)) + base
            keep = int(np.searchsorted(starts, part.end))
            if keep:
                lines = _decode(chunk, breaks)[:keep]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part.path] * keep, pa.string()),
                        pa.array(np.full(keep, part.range_start)),
                        pa.array(np.full(keep, part.range_end)),
                        pa.array(starts[:keep]),
                        pa.array(lines, pa.string()),
                    ],
                    schema=_ARROW,
                )
            if keep < len(starts) or position - len(pending) >= part.end:
                break


class _Options:
    def __init__(self, options):
        raw = options.get("paths") or options.get("path") or "[]"
        self.patterns = json.loads(raw) if raw.startswith("[") else [raw]
        self.split_bytes = int(options.get("splitBytes", SPLIT_BYTES))
        self.max_bytes = int(options.get("maxBytes", 0))
        self.tasks = int(options.get("tasks", 0))
        self.final = options.get("final", "false").lower() == "true"
        self.known = "offsets" in options
        self.offsets = {path: as_entry(end) for path, end in json.loads(options.get("offsets") or "{}").items()}

    def files(self) -> dict[str, tuple[int, int]]:
        found: dict[str, tuple[int, int]] = {}
        for pattern in self.patterns:
            found.update(list_matches(pattern))
        return dict(sorted(found.items()))


class GrowingTextStream(DataSourceStreamReader):
    def __init__(self, options):
        self.options = _Options(options)
        self._reached = self.options.offsets
        self._known = self.options.known  # whether ``_reached`` is where the stream stands
        self._ready: dict[str, tuple[tuple[int, int], list]] = {}

    def initialOffset(self) -> dict:
        self._known = True
        return {"files": self.options.offsets}

    def latestOffset(self) -> dict:
        files, known = self.options.files(), self._ready
        changed = [path for path, state in files.items() if path not in known or known[path][0] != state]
        base = {path: known[path][1] if path in known else self._reached.get(path) for path in changed}
        probed = _side_by_side(lambda path: (files[path], probe_file(path, files[path], base[path])), changed)
        # Files that are gone drop out, so the offset does not grow for ever.
        self._ready = {path: known[path] for path in files if path in known} | dict(zip(changed, probed))
        ready = {path: entry for path, (_, entry) in self._ready.items()}
        return {"files": plan_batch(self._reached, ready, self.options.max_bytes if self._known else 0)}

    def _begin(self, path: str, start: list | None, end: list) -> int:
        if self._known or start is None:
            return begin_of(start, end)
        # The first batch after a restart, planned without knowing where the last one ended.
        reached, _, head, digest = start
        replaced = reached > end[0] or (head and head_digest(path, head) != digest)
        return 0 if replaced else reached

    def partitions(self, start: dict, end: dict) -> list[Ranges]:
        added = []
        for path, entry in end["files"].items():
            entry, before = as_entry(entry), start["files"].get(path)
            added.append((path, self._begin(path, None if before is None else as_entry(before), entry), entry[0]))
        self._reached, self._known = {path: as_entry(entry) for path, entry in end["files"].items()}, True
        return cut_tasks(added, self.options.split_bytes, self.options.tasks)

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        for part in partition.ranges:
            yield from read_range(part)


class GrowingTextBatch(DataSourceReader):
    """The same lines as one table; ``final`` also returns an unfinished last line."""

    def __init__(self, options):
        self.options = _Options(options)

    def partitions(self) -> list[Ranges]:
        files = [(path, size) for path, (size, _) in self.options.files().items()]
        stops = [size for _, size in files] if self.options.final else _side_by_side(lambda f: last_line_end(*f), files)
        whole = [(path, 0, stop) for (path, _), stop in zip(files, stops)]
        return cut_tasks(whole, self.options.split_bytes, self.options.tasks)

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        for part in partition.ranges:
            yield from read_range(part)
            if self.options.final and part.end == part.range_end:
                yield from _unfinished_batch(part)


def unfinished_line(part: FileRange) -> tuple[int, str] | None:
    """Offset and text of what follows the last line break of a range, if anything does."""
    start = last_line_end(part.path, part.range_end)
    if start >= part.range_end:
        return None
    filesystem, local = _filesystem(part.path)
    with filesystem.open_input_file(local) as handle:
        handle.seek(start)
        return start, handle.read(part.range_end - start).decode("utf-8", errors="replace")


def _unfinished_batch(part: FileRange) -> Iterator[pa.RecordBatch]:
    rest = unfinished_line(part)
    if rest is not None:
        row = [[part.path], [part.range_start], [part.range_end], [rest[0]], [rest[1]]]
        yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, _ARROW)], schema=_ARROW)


class GrowingText(DataSource):
    """Options: ``paths`` (JSON list of patterns) or ``path``, ``splitBytes``, ``tasks``, ``maxBytes``, ``final``,
    and ``offsets`` (JSON, path to entry or end): where a stream without a checkpoint starts, and from
    where the first batch after a restart is measured."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> GrowingTextStream:
        return GrowingTextStream(self.options)

    def reader(self, schema) -> GrowingTextBatch:
        return GrowingTextBatch(self.options)


def _tasks(spark: SparkSession) -> int:
    return 2 * spark.sparkContext.defaultParallelism


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GrowingText)


def tail_growing_files(
    spark: SparkSession,
    patterns: str | list[str],
    split_bytes: int = SPLIT_BYTES,
    offsets: dict | None = None,
    max_bytes: int = 0,
) -> DataFrame:
    """Streaming DataFrame of new complete lines in files matching the patterns.

    A stream without a checkpoint starts at ``offsets``, by full path; a file that is
    not named there, or is shorter than its offset, starts at zero.  With ``max_bytes`` a
    batch takes about so many bytes and leaves the rest; a stream that restarts from a
    checkpoint needs that checkpoint's offsets here, or its first batch has no bound.
    """
    register(spark)
    patterns = [patterns] if isinstance(patterns, str) else list(patterns)
    reader = spark.readStream.format(FORMAT).option("paths", json.dumps(patterns)).option("splitBytes", split_bytes)
    if offsets is not None:
        reader = reader.option("offsets", json.dumps(offsets))
    return reader.option("tasks", _tasks(spark)).option("maxBytes", max_bytes).load()


def read_growing_files(
    spark: SparkSession, patterns: str | list[str], split_bytes: int = SPLIT_BYTES, final: bool = False
) -> DataFrame:
    """The complete lines present now, as a batch table."""
    register(spark)
    patterns = [patterns] if isinstance(patterns, str) else list(patterns)
    return (
        spark.read.format(FORMAT)
        .option("paths", json.dumps(patterns))
        .option("splitBytes", split_bytes)
        .option("tasks", _tasks(spark))
        .option("final", str(final).lower())
        .load()
    )
