"""Files that the registered queries write from the driver tables, so that the
readers of captures, logs and samples have something to read."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame

from ..session import cut_lineage, release_shuffles, scratch_path, scratch_scope, ship_package
from ..sources.pcap import _fs_and_path


def capture_bytes(rows: pd.DataFrame, big_endian: bool) -> bytes:
    """Record headers, each with a payload of zeros."""
    head = rows[["ts_sec", "ts_frac", "incl_len", "orig_len"]].to_numpy(np.int64).astype(">u4" if big_endian else "<u4")
    sizes = 16 + rows["incl_len"].to_numpy(np.int64)
    starts = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), np.uint8)
    out[starts[:, None] + np.arange(16)] = np.ascontiguousarray(head).view(np.uint8).reshape(-1, 16)
    return out.tobytes()


def _written(batches: Iterator[pd.DataFrame], root: str) -> Iterator[pd.DataFrame]:
    """Task side: rows arrive sorted by (directory, file, record order); each file
    is written whole by this task.  A retried task writes the same bytes."""
    name, out, done = None, None, {}
    for pdf in batches:
        for (directory, file, big), rows in pdf.groupby(["directory", "file", "big_endian"], sort=False):
            path = f"{root}/{directory}/{file}"
            if path != name:
                if out is not None:
                    out.close()
                fs, local = _fs_and_path(path)
                fs.create_dir(local.rsplit("/", 1)[0], recursive=True)
                name, out = path, fs.open_output_stream(local)
                out.write(bytes.fromhex("a1b2c3d4" if big else "d4c3b2a1") + b"\0" * 20)
            out.write(capture_bytes(rows, big))
            done[path] = done.get(path, 0) + len(rows)
    if out is not None:
        out.close()
    yield pd.DataFrame({"path": list(done), "records": list(done.values())}, columns=["path", "records"])


def write_captures(rows: DataFrame, root: str, order: Sequence) -> str:
    """Capture files ``root/directory/file`` of ``rows`` (directory, file, ts_sec,
    ts_frac, incl_len, orig_len, big_endian), records in ``order``."""
    ship_package(rows.sparkSession)
    root = root[5:] if root.startswith("file:") else root
    (rows.repartition("directory", "file").sortWithinPartitions("directory", "file", *order)
     .mapInPandas(lambda it: _written(it, root), "path string, records long").count())  # the files exist from here on
    return root


def _lines_written(batches: Iterator[pd.DataFrame], root: str) -> Iterator[pd.DataFrame]:
    """Task side: rows arrive sorted by (path, ord); each file is written whole."""
    name, out, done = None, None, []
    for pdf in batches:
        for path, rows in pdf.groupby("path", sort=False):
            if path != name:
                if out is not None:
                    out.close()
                fs, local = _fs_and_path(f"{root}/{path}")
                fs.create_dir(local.rsplit("/", 1)[0], recursive=True)
                name, out = path, fs.open_output_stream(local)
                done.append(path)
            out.write("".join(line + "\n" for line in rows["line"]).encode())
    if out is not None:
        out.close()
    yield pd.DataFrame({"path": done}, columns=["path"])


def write_lines(rows: DataFrame, root: str) -> str:
    """Text files ``root/path`` of ``rows`` (path, ord, line)."""
    ship_package(rows.sparkSession)
    root = root[5:] if root.startswith("file:") else root
    (rows.repartition("path").sortWithinPartitions("path", "ord")
     .mapInPandas(lambda it: _lines_written(it, root), "path string").count())  # the files exist from here on
    return root


#: Rows that a task sorts for a large file.
PIECE_ROWS = 250_000


def _packed(path: str) -> bool:
    return path.endswith(".gz")


def _pieces_written(batches: Iterator[pd.DataFrame], folder: str) -> Iterator[pd.DataFrame]:
    """Task side: this task's lines of each path as a compressed file of its own
    (of a path that ends in ``.gz``, as the gzip member it becomes), numbered by
    the path's place in the task.  A retried task writes the same bytes."""
    part, name, out, done = TaskContext.get().partitionId(), None, None, []
    for pdf in batches:
        for path, rows in pdf.groupby("path", sort=False):
            if path != name:
                if out is not None:
                    out.close()
                piece = f"{folder}/{part}-{len(done)}.{'gz' if _packed(path) else 'zst'}"
                fs, local = _fs_and_path(piece)
                fs.create_dir(local.rsplit("/", 1)[0], recursive=True)
                name, out = path, fs.open_output_stream(local)  # compressed as its name says
                done.append((path, part, piece))
            out.write("".join(line + "\n" for line in rows["line"]).encode())
    if out is not None:
        out.close()
    yield pd.DataFrame(done, columns=["path", "part", "piece"])


def _joined(pieces: pd.DataFrame, root: str) -> pd.DataFrame:
    """Task side: the pieces of one file laid end to end, block by block."""
    path = pieces["path"].iloc[0]
    fs, local = _fs_and_path(f"{root}/{path}")
    fs.create_dir(local.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(local, compression=None) as out:
        for piece in pieces.sort_values("part")["piece"]:
            source, at = _fs_and_path(piece)
            with source.open_input_stream(at, compression=None if _packed(path) else "detect") as f:
                while block := f.read(4 << 20):
                    out.write(block)
    return pd.DataFrame({"path": [path]})


def write_large_files(rows: DataFrame, root: str) -> str:
    """The files of ``write_lines`` where they are few and of any length: ranges of
    (path, ord) are sorted and written by tasks of their own and appended as bytes,
    so that no task sorts a whole file.  A path that ends in ``.gz`` is compressed.
    Pieces are compressed until then, and shuffled rows go before the files are made."""
    spark = rows.sparkSession
    ship_package(spark)
    root = root[5:] if root.startswith("file:") else root
    with scratch_scope(spark):
        folder = scratch_path(spark, "pieces")
        folder = folder[5:] if folder.startswith("file:") else folder
        pieces = cut_lineage(rows.repartitionByRange(rows.count() // PIECE_ROWS + 1, "path", "ord").sortWithinPartitions("path", "ord")
                             .mapInPandas(lambda it: _pieces_written(it, folder), "path string, part int, piece string"))
        release_shuffles(spark)
        files = max(1, pieces.select("path").distinct().count())
        (pieces.repartitionByRange(files, "path").groupBy("path")
         .applyInPandas(lambda pdf: _joined(pdf, root), "path string").count())  # the files exist from here on
    return root
