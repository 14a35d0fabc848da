"""Packet-capture header reader (S7, D1) with byte-range splits.

A classic capture is a chain of records, each found only through the one
before it.  Large files are read by several tasks all the same:

1. Every file is cut into byte ranges.  A range looks for its first record
   header by itself: the first place from which a chain of ``_CHAIN`` plausible
   headers leads on (``resync``).  From there it counts the records that begin in
   it and notes where the first record behind it begins.
2. *Hand-over* (``settle``): range by range, the place where the range before
   ended must be the place where this one began.  The first range begins at the
   first record for certain, so agreement proves every place of a file; a range
   that guessed wrong, or found no place, is walked again from the right one.
   Only the ranges (one row each) are gathered per file, never packets.
3. Packets are decoded range by range from proved places, and the counts of
   the ranges before give each its first ordinal.

Tasks read blocks sequentially and follow the lengths of the records; numpy
decodes all headers of a block at once.  Payloads larger than a block are
skipped by seeking.  Both byte orders are accepted; any other magic (pcapng,
nanosecond variant, junk) yields no packets and a ``bad_magic`` status.  A last
record cut short still counts.

``read_packets`` gives one row per record header (an I/O error fails the task),
``read_capture_files`` one row per file (an I/O error gives the status
``error``).  The data sources ``capture_packets`` and ``capture_files`` read whole
files, one task each.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.columns import flat_name
from ..session import cut_lineage, qualify, ship_package

# FIXED VALUES: classic capture magics (little-, big-endian).
_MAGIC_LE = bytes.fromhex("d4c3b2a1")
_MAGIC_BE = bytes.fromhex("a1b2c3d4")
_GLOBAL_HEADER = 24
_RECORD_HEADER = 16
_BATCH = 65536
_BLOCK_BYTES = 8 << 20
#: Bytes of one range, and of one step in the search for a range's first record.
SPLIT_BYTES, _SYNC_BYTES = 64 << 20, 64 << 10
#: What a task reads: ranges of so many bytes in all, where opening one counts as
#: ``_OPEN_BYTES`` more; while there are few, as many tasks as there are ranges.
_TASK_BYTES, _OPEN_BYTES, _FEW_TASKS = 64 << 20, 512 << 10, 256
#: Ranges that a task settles, about; a file's ranges stay together.
_SETTLED_RANGES = 1000
#: Headers that must follow each other, and seconds between neighbours.
_CHAIN, _APART = 16, 86_400
#: The longest record where the file's own limit is not set.
_SNAP_LENGTH = 262_144

PACKETS_SCHEMA = ("file string, ordinal bigint, ts_sec bigint, ts_frac bigint, "
                  "incl_len bigint, orig_len bigint, truncated boolean")
FILES_SCHEMA = "file string, byte_order string, packets bigint, status string"
RANGES_SCHEMA = ("file string, range bigint, start bigint, end bigint, size bigint, byte_order string, "
                 "first bigint, stop bigint, packets bigint, status string")


def _fs_and_path(path: str):
    import pyarrow.fs as pafs
    if "://" not in path and not path.startswith("file:"):
        return pafs.LocalFileSystem(), path
    if path.startswith("file:"):
        local = path[5:]
        while local.startswith("//"):
            local = local[1:]
        return pafs.LocalFileSystem(), local
    return pafs.FileSystem.from_uri(path)


def _listed(root: str, suffix: str, recursive: bool = True) -> list[tuple[str, int | None]]:
    """(path, length) of capture files under ``root``, empty ones too, sorted;
    without ``recursive`` of its own entries, directories with null."""
    import pyarrow.fs as pafs
    fs, base = _fs_and_path(root)
    infos = fs.get_file_info(pafs.FileSelector(base, recursive=recursive, allow_not_found=True))
    prefix = "" if isinstance(fs, pafs.LocalFileSystem) else root[: len(root) - len(base)]
    return sorted((prefix + i.path, None if i.type == pafs.FileType.Directory else i.size) for i in infos
                  if i.type == pafs.FileType.File and i.path.endswith(suffix)
                  or not recursive and i.type == pafs.FileType.Directory)


def list_files(root: str, suffix: str = ".pcap") -> list[str]:
    """Capture files under ``root`` (recursive), sorted."""
    return [path for path, _ in _listed(root, suffix)]


def _directories_listed(suffix: str):
    def run(batches):
        import pyarrow as pa
        for batch in batches:
            found = [x for r in batch.to_pylist() for x in
                     ([(r["file"], r["size"])] if r["size"] is not None else _listed(r["file"], suffix))]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())],
                                             names=["file", "size"])
    return run


class Capture:
    """An open capture: its size, byte order (None: not a capture) and longest record."""

    def __init__(self, path: str):
        fs, p = _fs_and_path(path)
        self.file = fs.open_input_file(p)
        self.size = self.file.size()
        head = self.file.read(_GLOBAL_HEADER)
        self.order = {_MAGIC_LE: "<", _MAGIC_BE: ">"}.get(head[:4])
        limit = int.from_bytes(head[16:20], "little" if self.order == "<" else "big")
        self.longest = limit if 0 < limit <= 1 << 26 else _SNAP_LENGTH

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.file.close()

    @property
    def byte_order(self) -> str | None:
        return {"<": "little", ">": "big"}.get(self.order)

    def blocks(self, first: int, end: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places, headers) of the records that begin in [first, end), block by
        block; headers are whole numbers, a column for each field.  ``stop`` is
        then the place of the first record behind."""
        length = struct.Struct(self.order + "I").unpack_from
        self.stop = first
        while self.stop < end and self.stop + _RECORD_HEADER <= self.size:
            self.file.seek(self.stop)
            buf = self.file.read(_BLOCK_BYTES)
            limit = min(end - self.stop, len(buf) - _RECORD_HEADER + 1)
            if limit <= 0:
                break
            places, at = [], 0
            while at < limit:
                places.append(at)
                at += _RECORD_HEADER + length(buf, at + 8)[0]
            where = np.array(places, np.int64)
            raw = np.frombuffer(buf, np.uint8)[where[:, None] + np.arange(_RECORD_HEADER)]
            yield where + self.stop, raw.view(self.order + "u4").astype(np.int64)
            self.stop += at

    def _header(self, at: int) -> tuple[int, ...] | None:
        self.file.seek(at)
        raw = self.file.read(_RECORD_HEADER)
        return struct.unpack(self.order + "IIII", raw) if len(raw) == _RECORD_HEADER else None

    def _leads_on(self, at: int) -> bool:
        """Whether a chain of plausible headers starts here, or runs to the end."""
        before = None
        for _ in range(_CHAIN):
            if at == self.size:
                return before is not None
            header = self._header(at)
            if header is None:
                return before is not None and at > self.size  # the last record is cut short
            sec, frac, incl, _ = header
            if frac >= 1_000_000 or not 0 < incl <= self.longest or before is not None and abs(sec - before) > _APART:
                return False
            before, at = sec, at + _RECORD_HEADER + incl
        return True

    def resync(self, start: int, end: int) -> int | None:
        """The likely place of the first record that begins in [start, end)."""
        for at in range(start, min(end, self.size - _RECORD_HEADER + 1), _SYNC_BYTES):
            self.file.seek(at)
            buf = self.file.read(_SYNC_BYTES + _RECORD_HEADER - 1)
            n = min(len(buf) - _RECORD_HEADER + 1, end - at)
            if n <= 0:
                return None
            frac, incl = (np.ndarray((n,), self.order + "u4", buf, k, (1,)) for k in (4, 8))
            for k in np.flatnonzero((frac < 1_000_000) & (incl > 0) & (incl <= self.longest)).tolist():
                if self._leads_on(at + k):
                    return at + k
        return None

    def walk(self, first: int, end: int) -> tuple[int, int]:
        """(records that begin in [first, end), place of the next one)."""
        n = 0
        for places, _ in self.blocks(first, end):
            n += len(places)
        return n, max(self.stop, first)


def walk_records(path: str):
    """``(byte_order, records)`` where ``records`` iterates
    ``(ordinal, ts_sec, ts_frac, incl_len, orig_len, truncated)``."""
    capture = Capture(path)
    if capture.order is None:
        capture.file.close()
        return None, iter(())

    def records():
        ordinal = 0
        with capture:
            for places, headers in capture.blocks(_GLOBAL_HEADER, capture.size):
                ends = places + _RECORD_HEADER + headers[:, 2]
                for header, cut in zip(headers.tolist(), (ends > capture.size).tolist()):
                    yield ordinal, *header, cut
                    ordinal += 1

    return capture.byte_order, records()


def _packet_batches(path: str, first: int, end: int, base: int):
    """Arrow batches of the records that begin in [first, end)."""
    import pyarrow as pa
    with Capture(path) as capture:
        if capture.order is None:
            return
        for places, headers in capture.blocks(first, end):
            cut = places + _RECORD_HEADER + headers[:, 2] > capture.size
            for at in range(0, len(places), _BATCH):
                part = slice(at, at + _BATCH)
                n = len(places[part])
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(pa.scalar(path, pa.string()), n), pa.array(np.arange(base, base + n)),
                     *[pa.array(headers[part, k]) for k in range(4)], pa.array(cut[part])],
                    names=["file", "ordinal", "ts_sec", "ts_frac", "incl_len", "orig_len", "truncated"])
                base += n


class _FilePartition(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options, mode: str):
        self.root = options.get("path")
        self.suffix = options.get("suffix", ".pcap")
        self.mode = mode

    def partitions(self):
        return [_FilePartition(p) for p in list_files(self.root, self.suffix)]

    def read(self, partition):
        if partition is None:          # no capture files: Spark asks once with None
            return
        if self.mode == "packets":
            # an OSError fails the task, which Spark retries: no capture is left out silently
            yield from _packet_batches(partition.path, _GLOBAL_HEADER, 1 << 62, 0)
            return
        try:
            with Capture(partition.path) as capture:
                n = capture.walk(_GLOBAL_HEADER, capture.size)[0] if capture.order else 0
                yield (partition.path, capture.byte_order, n, "ok" if capture.order else "bad_magic")
        except OSError:
            yield (partition.path, None, 0, "error")


class CapturePackets(DataSource):
    """``spark.read.format("capture_packets").load(root)``"""

    @classmethod
    def name(cls):
        return "capture_packets"

    def schema(self):
        return PACKETS_SCHEMA

    def reader(self, schema):
        return _Reader(self.options, "packets")


class CaptureFiles(DataSource):
    """``spark.read.format("capture_files").load(root)``"""

    @classmethod
    def name(cls):
        return "capture_files"

    def schema(self):
        return FILES_SCHEMA

    def reader(self, schema):
        return _Reader(self.options, "files")


def register(spark: SparkSession) -> None:
    ship_package(spark)
    spark.dataSource.register(CapturePackets)
    spark.dataSource.register(CaptureFiles)


# --- byte ranges ---------------------------------------------------------------

def probe(path: str, start: int, end: int) -> tuple:
    """(byte_order, first, stop, packets, status) of one range by itself;
    ``first`` is null where no place was found."""
    try:
        with Capture(path) as capture:
            if capture.order is None:
                return None, None, None, 0, "bad_magic"
            first = _GLOBAL_HEADER if start == 0 else capture.resync(start, end)
            if first is None:
                return capture.byte_order, None, None, 0, "ok"
            packets, stop = capture.walk(first, end)
            return capture.byte_order, first, stop, packets, "ok"
    except OSError:
        return None, None, None, 0, "error"


def _ranges_batch(rows: list[dict]):
    import pyarrow as pa
    kinds = {"string": pa.string(), "bigint": pa.int64()}
    names = [c.split() for c in RANGES_SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds[k]) for n, k in names], names=[n for n, _ in names])


def _probes(batches):
    found = ("byte_order", "first", "stop", "packets", "status")
    for batch in batches:
        yield _ranges_batch([r | dict(zip(found, probe(r["file"], r["start"], r["end"]), strict=True)) for r in batch.to_pylist()])


def settle(rows: list[dict]) -> list[dict]:
    """The ranges of one file with proved places: each begins where the one
    before ended, or is walked again from there."""
    rows = sorted(rows, key=lambda r: r["range"])
    capture, at, bad = None, None, {r["status"] for r in rows} - {"ok"}
    try:
        for r in [] if bad else rows:
            if at is not None and r["first"] != at:
                if at >= r["end"] or at + _RECORD_HEADER > r["size"]:   # no record begins here
                    packets, stop = 0, at
                else:
                    capture = capture or Capture(r["file"])
                    packets, stop = capture.walk(at, r["end"])
                r.update(first=at, stop=stop, packets=packets)
            at = r["stop"]
    except OSError:
        bad = {"error"}
    finally:
        if capture:
            capture.file.close()
    if bad:   # of a file that can't be read whole nothing is counted
        status = "error" if "error" in bad else "bad_magic"
        for r in rows:
            r.update(first=None, stop=None, packets=0, status=status, byte_order=None if status == "bad_magic" else r["byte_order"])
    return rows


def _settled(table):
    import pyarrow as pa
    return pa.Table.from_batches([_ranges_batch(settle(table.to_pylist()))])


def read_ranges(spark: SparkSession, root: str, suffix: str = ".pcap", split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """One row per byte range of every capture under ``root``, with proved places:
    the records that begin in [first, end), ``packets`` of them, belong to it.
    Checkpointed (one small row per range)."""
    ship_package(spark)
    # the root's own entries here, what lies below them in tasks
    top = spark.createDataFrame(_listed(qualify(spark, root), suffix, recursive=False), "file string, size bigint")
    files = top.repartition(spark.sparkContext.defaultParallelism).mapInArrow(_directories_listed(suffix), "file string, size bigint")
    starts = F.sequence(F.lit(0), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(split_bytes).cast("bigint"))
    ranges = files.select("file", "size", F.posexplode(starts).alias("range", "start"))
    ranges = ranges.select("file", F.col("range").cast("bigint").alias("range"), "start",
                           (F.col("start") + split_bytes).alias("end"), "size")
    ranges = cut_lineage(ranges)
    found = _dealt(ranges).mapInArrow(_probes, RANGES_SCHEMA)
    # a given number, or few bytes would bring all files into one task
    found = found.repartition(ranges.count() // _SETTLED_RANGES + 1, "file")
    return cut_lineage(found.groupBy("file").applyInArrow(_settled, RANGES_SCHEMA))


def _tasks(ranges: int, size: int) -> int:
    """Tasks for so many ranges of ``size`` bytes in all."""
    return max(1, min(ranges, max(_FEW_TASKS, -(-(size + ranges * _OPEN_BYTES) // _TASK_BYTES))))


def _dealt(ranges: DataFrame) -> DataFrame:
    """About the same number of neighbouring ranges per task: many small ones
    share a task, large ones have one each.  A range is never split."""
    read = F.greatest(F.least("end", "size") - F.col("start"), F.lit(0))
    n, size = ranges.agg(F.count(F.lit(1)), F.coalesce(F.sum(read), F.lit(0))).first()
    return ranges.repartitionByRange(_tasks(n, size), "file", "range")


def _decoded(batches):
    for batch in batches:
        for r in batch.to_pylist():
            if r["status"] == "error":
                raise OSError(f"{r['file']} can't be read")
            if r["first"] is not None and r["packets"]:
                yield from _packet_batches(r["file"], r["first"], r["end"], r["base"])


def _with_attack(df: DataFrame, spark: SparkSession, root: str) -> DataFrame:
    """P5: the capture directory relative to ``root`` with ``/`` -> ``_``."""
    base = qualify(spark, root)
    local = base[5:] if base.startswith("file:") else base
    path = F.col("file")
    rel_dir = F.regexp_extract(path, r"^(.*)/[^/]+$", 1)
    rel_dir = F.regexp_replace(rel_dir, "^(file:)?" + _re_escape(local) + "/?", "")
    return df.withColumn("directory", rel_dir).withColumn("attack", flat_name(rel_dir))


def _re_escape(s: str) -> str:
    import re
    return re.escape(s)


def read_packets(spark: SparkSession, root: str, suffix: str = ".pcap", split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """One row per record header, with the capture's ``directory`` and
    ``attack`` (P5 name).  A file of several ranges is read by several tasks."""
    from pyspark.sql import Window
    ranges = read_ranges(spark, root, suffix, split_bytes)
    before = Window.partitionBy("file").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("base", F.coalesce(F.sum("packets").over(before), F.lit(0)))
    rows = ranges.select("file", "range", "start", "first", "end", "size", "packets", "status", "base")
    return _with_attack(_dealt(rows).mapInArrow(_decoded, PACKETS_SCHEMA), spark, root)


def read_capture_files(spark: SparkSession, root: str, suffix: str = ".pcap", split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Per-file packet counts and status, and ``ranges``, how many tasks read it."""
    ranges = read_ranges(spark, root, suffix, split_bytes)
    df = ranges.groupBy("file").agg(F.max("byte_order").alias("byte_order"), F.sum("packets").alias("packets"),
                                    F.max("status").alias("status"), F.count(F.lit(1)).alias("ranges"))
    return _with_attack(df, spark, root)
