"""Sorted hash arrays in the shared folder, mapped into memory by workers."""

from __future__ import annotations

import re
import uuid
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capturelake.llm.common import mix, written

#: Files that a worker keeps mapped, and bytes that it keeps of files that
#: cannot be mapped; the ones used longest ago go first.
MAPPED, READ_BYTES = 1024, 256 << 20
#: A count from which on an entry is written in full.
FULL = 255


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    """The shard of a hash: its upper half, scaled."""
    return ((h >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)


def shard_column(h: Column, shards: int) -> Column:
    return F.shiftrightunsigned(F.shiftrightunsigned(h, 32) * F.lit(shards).cast("long"), 32).cast("int")


def write_file(path: str, name: str, parts: list[bytes]) -> str:
    """Write a file under ``path`` and return its name.

    It gets the name, which has a token, when it is complete: a task that is
    run again leaves files that nothing names.
    """
    store, folder = fs.FileSystem.from_uri(path)
    store.create_dir(folder, recursive=True)
    name = f"{name}-{uuid.uuid4().hex}"
    with store.open_output_stream(f"{folder}/_{name}", compression=None) as f:
        for p in parts:
            f.write(p)
    store.move(f"{folder}/_{name}", f"{folder}/{name}")
    return name


def _even(data: bytes) -> bytes:
    return data + b"\0" * (-len(data) % 8)


def pack_counts(columns: list[np.ndarray]) -> list[bytes]:
    """Small counts by place, a byte a count; places with a count of FULL or
    more follow whole."""
    large = np.zeros(len(columns[0]), bool)
    for c in columns:
        large |= c >= FULL
    out = [np.array([len(large), large.sum()], np.int64).tobytes()]
    out += [_even(np.where(large, FULL, c).astype(np.uint8).tobytes()) for c in columns]
    return [*out, np.flatnonzero(large).tobytes(), *(c[large].astype(np.int64).tobytes() for c in columns)]


def _take(raw: np.ndarray, at: int, count: int, dtype: type) -> tuple[np.ndarray, int]:
    size = count * np.dtype(dtype).itemsize
    return raw[at : at + size].view(dtype), at + size + -size % 8


class Counts:
    """What :func:`pack_counts` wrote, within the bytes of a file from ``at`` on."""

    def __init__(self, raw: np.ndarray, at: int, columns: int) -> None:
        n, large = (int(x) for x in raw[at : at + 16].view(np.int64))
        at += 16
        self.small, self.large = [], []
        for _ in range(columns):
            found, at = _take(raw, at, n, np.uint8)
            self.small.append(found)
        self.places, at = _take(raw, at, large, np.int64)
        for _ in range(columns):
            found, at = _take(raw, at, large, np.int64)
            self.large.append(found)
        self.end = at

    def at(self, places: np.ndarray) -> list[np.ndarray]:
        out = [c[places].astype(np.int64) for c in self.small]
        full = np.flatnonzero(out[0] == FULL)
        if len(full):
            where = np.searchsorted(self.places, places[full])
            for o, c in zip(out, self.large, strict=True):
                o[full] = c[where]
        return out


def pack(h: np.ndarray, columns: list[np.ndarray]) -> list[bytes]:
    """Counts by hash: sorted by the upper 48 bits of the hashes."""
    order = np.argsort(h)
    key = h[order] >> np.uint64(16)
    keys = [np.array([len(key)], np.int64).tobytes(), _even((key >> np.uint64(16)).astype(np.uint32).tobytes()), _even((key & np.uint64(0xFFFF)).astype(np.uint16).tobytes())]
    return keys + pack_counts([c[order] for c in columns])


class Packed:
    """What :func:`pack` wrote, within the bytes of a file from ``at`` on."""

    def __init__(self, raw: np.ndarray, at: int, columns: int) -> None:
        n = int(raw[at : at + 8].view(np.int64)[0])
        self.high, at = _take(raw, at + 8, n, np.uint32)
        self.low, at = _take(raw, at, n, np.uint16)
        self.counts = Counts(raw, at, columns)
        self.end = self.counts.end

    def find(self, h: np.ndarray) -> list[np.ndarray]:
        """The counts of each hash, zero where there is none."""
        out = [np.zeros(len(h), np.int64) for _ in self.counts.small]
        if not len(self.high) or not len(h):
            return out
        key = h >> np.uint64(16)
        high, low = (key >> np.uint64(16)).astype(np.uint32), (key & np.uint64(0xFFFF)).astype(np.uint16)
        at = np.minimum(np.searchsorted(self.high, high), len(self.high) - 1)
        same = self.high[at] == high
        hit = same & (self.low[at] == low)
        # hashes with the same upper 32 bits follow each other
        open_ = np.flatnonzero(same & ~hit)
        while len(open_):
            at[open_] += 1
            open_ = open_[at[open_] < len(self.high)]
            open_ = open_[self.high[at[open_]] == high[open_]]
            same = self.low[at[open_]] == low[open_]
            hit[open_[same]] = True
            open_ = open_[~same]
        hit = np.flatnonzero(hit)
        for o, c in zip(out, self.counts.at(at[hit]), strict=True):
            o[hit] = c
        return out


def pack_words(h: np.ndarray, c: np.ndarray) -> list[bytes]:
    """Whole hashes in order, and a count of each."""
    return [np.array([len(h)], np.int64).tobytes(), h.tobytes(), *pack_counts([c])]


class Words:
    """What :func:`pack_words` wrote."""

    def __init__(self, raw: np.ndarray) -> None:
        n = int(raw[:8].view(np.int64)[0])
        self.h, at = _take(raw, 8, n, np.uint64)
        self.counts = Counts(raw, at, 1)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each hash, -1 where there is none, and its count."""
        at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        hit = self.h[at] == h
        return np.where(hit, at, -1), np.where(hit, self.counts.at(at)[0], 0)


class Files:
    """A worker's view of files in the shared folder: mapped into memory, or
    read where the store cannot be mapped."""

    def __init__(self, path: str, names: list[str]) -> None:
        self.store, self.folder = fs.FileSystem.from_uri(path)
        self.local = re.match(r"file:|/", path) is not None
        self.names, self.open, self.held = names, OrderedDict(), 0

    def raw(self, i: int) -> np.ndarray:
        if i in self.open:
            self.open.move_to_end(i)
            return self.open[i]
        if not self.names[i]:
            found = np.zeros(0, np.uint8)
        elif self.local:
            found = np.asarray(np.memmap(f"{self.folder}/{self.names[i]}", np.uint8, "r"))
        else:
            with self.store.open_input_file(f"{self.folder}/{self.names[i]}") as f:
                found = np.frombuffer(f.read_buffer(), np.uint8)
            self.held += len(found)
        self.open[i] = found
        while len(self.open) > 1 and (len(self.open) > MAPPED or self.held > READ_BYTES):
            gone = self.open.popitem(last=False)[1]
            self.held -= 0 if self.local else len(gone)
        return found


class Arrays:
    """Sorted arrays of hashes and doubles, a file a shard of the hash."""

    def __init__(self, path: str, names: list[str], columns: int) -> None:
        self.files, self.columns = Files(path, names), columns

    def find(self, h: np.ndarray) -> list[np.ndarray]:
        """The columns for each of the hashes, zero where there is none.  ``h``
        is sorted, so that the arrays are read in order."""
        out, shards = [np.zeros(len(h), np.float64) for _ in range(self.columns)], len(self.files.names)
        if not shards:
            return out
        edges = np.searchsorted(shard_of(h, shards), np.arange(shards + 1, dtype=np.uint64))
        for i in np.flatnonzero(np.diff(edges)):
            own, raw = h[edges[i] : edges[i + 1]], self.files.raw(int(i))
            n = len(raw) // (8 + 8 * self.columns)
            if n:
                keys = raw[: 8 * n].view(np.uint64)
                at = np.minimum(np.searchsorted(keys, own), n - 1)
                hit = keys[at] == own
                for k, o in enumerate(out):
                    c = raw[8 * n * (k + 1) : 8 * n * (k + 2)].view(np.float64)
                    o[edges[i] : edges[i + 1]] = np.where(hit, c[at], 0)
        return out


def write_arrays(rows: DataFrame, kind: str, path: str, columns: list[str], shards: int) -> DataFrame:
    """Write (h, columns) as files for :class:`Arrays`; (shard, name) of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if got:
            table = pa.Table.from_batches(got)
            h = table.column(0).to_numpy().view(np.uint64)
            order = np.argsort(h)
            of = shard_of(h[order], shards)
            edges = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1], [True]]))
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                own = order[a:b]
                name = write_file(path, f"{kind}-{int(of[a])}", [h[own].tobytes(), *(table.column(1 + i).to_numpy()[own].tobytes() for i in range(len(columns)))])
                yield pa.RecordBatch.from_arrays([pa.array([int(of[a])], pa.int64()), pa.array([name])], ["shard", "name"])

    dealt = rows.select("h", *(F.col(c).cast("double") for c in columns)).repartitionById(shards, shard_column(F.col("h"), shards))
    return written(dealt.mapInArrow(run, "shard long, name string"), kind)


def scattered(h: np.ndarray, shards: int) -> np.ndarray:
    """A shard that does not depend on the bits alone by which a file is sorted."""
    return shard_of(mix(h, 42), shards)


def scattered_column(h: Column, shards: int) -> Column:
    """:func:`scattered` of a column of hashes."""
    return shard_column(F.xxhash64(h), shards)
