"""Sorted arrays in files of the shared folder that workers map into memory.

A file holds a row count, the smallest key (or first row number) and arrays of that length behind each other; the files
of a folder are consecutive ranges. A worker maps a file when a lookup first falls into it and keeps at most ``OPEN`` maps, so descriptors stay bounded. Files
in a store that is not mounted on the worker are fetched one by one into its temporary folder, also on first use.
"""

from __future__ import annotations

import os
import struct
import tempfile
from collections import OrderedDict
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import read_blobs, write_blobs

HEAD = struct.Struct("<Qq")
OPEN = 512  #: maps that a worker keeps


def pack(first: int, **arrays: np.ndarray) -> bytes:
    """Rows and ``first``, then each array in the order given."""
    return HEAD.pack(len(next(iter(arrays.values()))), first) + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays.values())


def unpack(blob: bytes, kinds: dict[str, str]) -> dict[str, np.ndarray]:
    n, at, out = HEAD.unpack_from(blob)[0], HEAD.size, {}
    for name, kind in kinds.items():
        out[name] = np.frombuffer(blob, kind, n, at)
        at += out[name].nbytes
    return out


def head_of(blob: pa.Buffer) -> tuple[int, int]:
    """Rows and first key; no rows for what is too short to be a file."""
    return HEAD.unpack_from(blob) if len(blob) >= HEAD.size else (0, 0)


def local_file(uri: str) -> str:
    """A path that this machine can map; files of other stores are copied once to its temporary folder."""
    parts = urlparse(uri)
    if parts.scheme in ("", "file"):
        return unquote(parts.path)
    name = os.path.join(tempfile.gettempdir(), "mapped-" + os.path.basename(os.path.dirname(parts.path)) + "-" + os.path.basename(parts.path))
    if not os.path.exists(name):
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(uri)
        part = f"{name}.{os.getpid()}"
        with store.open_input_stream(path) as source, open(part, "wb") as to:
            while piece := source.read(1 << 20):
                to.write(piece)
        os.replace(part, name)
    return name


class Mapped:
    """Files of the same arrays, in order. ``files``: ``(uri, rows, smallest key)`` each, as ``written`` gives them."""

    def __init__(self, files: list[tuple[str, int, int]], kinds: dict[str, str]):
        self.files, self.kinds = files, kinds
        self.sizes = np.array([n for _, n, _ in files], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        self.firsts = np.array([k for *_, k in files], np.int64)
        self.open: OrderedDict[int, dict[str, np.ndarray]] = OrderedDict()

    def part(self, k: int) -> dict[str, np.ndarray]:
        """The arrays of file ``k``; a kind such as ``(3,)<f4`` has several values a row."""
        found = self.open.get(k)
        if found is None:
            raw = np.memmap(local_file(self.files[k][0]), np.uint8, "r")
            at, found = HEAD.size, {}
            for name, kind in self.kinds.items():
                dtype = np.dtype(kind)
                size = int(self.sizes[k]) * dtype.itemsize
                found[name] = raw[at : at + size].view(dtype.base).reshape(-1, *dtype.shape)
                at += size
            self.open[k] = found
            if len(self.open) > OPEN:
                self.open.popitem(last=False)
        else:
            self.open.move_to_end(k)
        return found

    def find(self, column: str, wanted: np.ndarray) -> np.ndarray:
        """Places of the sorted distinct ``wanted`` in the sorted ``column`` over all files, -1 where absent."""
        out = np.full(len(wanted), -1, np.int64)
        if not len(self.files) or not len(wanted):
            return out
        edges = np.concatenate([[0], np.searchsorted(wanted, self.firsts[1:]), [len(wanted)]])
        for k in np.flatnonzero(np.diff(edges)).tolist():
            a, b = edges[k], edges[k + 1]
            have = self.part(k)[column]
            at = np.searchsorted(have, wanted[a:b])
            hit = have[np.minimum(at, len(have) - 1)] == wanted[a:b]
            out[a:b] = np.where(hit, at + self.starts[k], -1)
        return out

    def take(self, column: str, places: np.ndarray) -> np.ndarray:
        """Values at ``places`` over all files; places need not be sorted."""
        out = np.zeros(len(places), np.dtype(self.kinds[column]))
        which = np.searchsorted(self.starts, places, side="right") - 1
        for k in np.unique(which).tolist():
            at = which == k
            out[at] = self.part(k)[column][places[at] - self.starts[k]]
        return out


def written(blobs: DataFrame, path: str) -> list[tuple[str, int, int]]:
    """Write ``blobs(blob)``, made by ``pack``, and name the files with their rows and first keys in ascending order: the
    driver sees 16 bytes of each."""
    spark: SparkSession = blobs.sparkSession
    write_blobs(blobs, "blob", path)

    def heads(batches):
        for batch in batches:
            found = [(p.as_py(), *head_of(x.as_buffer())) for p, x in zip(batch.column("path"), batch.column("content"))]
            columns = list(zip(*[f for f in found if f[1]])) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int64()))], names=["path", "n", "first"])

    rows = read_blobs(spark, path).mapInArrow(heads, "path string, n long, first long").collect()
    return sorted(((r["path"], r["n"], r["first"]) for r in rows), key=lambda r: r[2])
