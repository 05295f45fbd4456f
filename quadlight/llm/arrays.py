"""Raw arrays in the shared folder, written by tasks and memory-mapped by workers."""

from __future__ import annotations

import uuid
from collections import OrderedDict

import numpy as np

_maps: dict[str, np.ndarray] = {}
#: Files of folders that cannot be mapped, the last used last, and how many bytes of them a worker keeps.
_read: OrderedDict[str, np.ndarray] = OrderedDict()
MOST_READ = 512 << 20


class ArrayStore:
    """Files of one folder, given by URI. A file appears whole or not at all, so retried tasks do no harm."""

    def __init__(self, uri: str):
        self.uri = uri

    def _open(self):
        from pyarrow.fs import FileSystem

        return FileSystem.from_uri(self.uri if "://" in self.uri or self.uri.startswith("file:") else f"file://{self.uri}")

    def write(self, name: str, data: bytes) -> None:
        fs, base = self._open()
        fs.create_dir(base, recursive=True)
        part = f"{base}/.{name}-{uuid.uuid4().hex}"
        with fs.open_output_stream(part) as f:
            f.write(data)
        fs.move(part, f"{base}/{name}")

    def map(self, name: str) -> np.ndarray:
        """The file's bytes: mapped in place on a mounted folder, else read, and kept while others fit beside it."""
        from pyarrow.fs import LocalFileSystem

        key = f"{self.uri}/{name}"
        if key in _read:
            _read.move_to_end(key)
            return _read[key]
        if key not in _maps:
            fs, base = self._open()
            if not isinstance(fs, LocalFileSystem):
                with fs.open_input_stream(f"{base}/{name}") as f:
                    _read[key] = np.frombuffer(f.read(), np.uint8)
                while len(_read) > 1 and sum(map(len, _read.values())) > MOST_READ:
                    _read.popitem(last=False)
                return _read[key]
            _maps[key] = np.memmap(f"{base}/{name}", np.uint8, "r").view(np.ndarray) if fs.get_file_info(f"{base}/{name}").size else np.zeros(0, np.uint8)
        return _maps[key]

    def forget(self) -> None:
        for key in [k for k in _maps if k.startswith(f"{self.uri}/")]:
            del _maps[key]
        for key in [k for k in _read if k.startswith(f"{self.uri}/")]:
            del _read[key]


def squeeze(sorted_keys: np.ndarray, *counts: np.ndarray) -> bytes:
    """Sorted unsigned keys with counts, as bytes: differences split into byte planes, then zstd."""
    from zstandard import ZstdCompressor

    steps = np.diff(sorted_keys.astype("<u8"), prepend=np.uint64(0))
    columns = [steps, *(c.astype("<u8") for c in counts)]
    planes = b"".join(c.view(np.uint8).reshape(-1, 8).T.tobytes() for c in columns)
    return ZstdCompressor(level=1).compress(planes)


def expand(data: bytes, columns: int) -> list[np.ndarray]:
    from zstandard import ZstdDecompressor

    planes = np.frombuffer(ZstdDecompressor().decompress(data), np.uint8)
    n = len(planes) // (8 * columns)
    out = [np.ascontiguousarray(p.reshape(8, n).T).view("<u8").ravel() for p in planes.reshape(columns, 8 * n)]
    out[0] = np.cumsum(out[0], dtype=np.uint64)
    return out


def summed(keys: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted distinct keys with the sums of their counts (of ones, if none are given)."""
    order = np.argsort(keys)
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    if not counts:
        return keys[starts], np.diff(np.append(starts, len(keys)))
    return keys[starts], *(np.add.reduceat(c[order], starts) if len(starts) else c[:0] for c in counts)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer, so that any bits of the result can deal keys out."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: The largest value that a column of bytes holds itself; larger ones stand in a list of their own.
ESCAPE = 255
LOW = np.uint64(0xFFFFFFFF)


def pack_table(keys: np.ndarray, *columns: np.ndarray) -> bytes:
    """A sorted hash array: 64-bit hashes in buckets by their first bits, of which the next 32 bits are kept, with a byte
    for each value of each column. Two hashes that agree in all of these bits are one in 2^32 a pair of a bucket.

    Layout: 8 numbers (entries, bucket bits, columns, steps of a search, then the sizes of the lists of large values),
    bucket starts (u4), hash bits (u4), columns (u1 each, padded to 8), lists of large values (place u8, value u8)."""
    order = np.argsort(keys)
    keys = keys[order]
    bits = max(0, min(24, int(len(keys) // 16).bit_length()))
    starts = np.zeros((1 << bits) + 1, np.uint64)
    if bits:
        starts[1:] = np.cumsum(np.bincount((keys >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits))
    else:
        starts[1:] = len(keys)
    most = int(np.diff(starts).max()) if len(keys) else 0
    pad = lambda x: x + bytes(-len(x) % 8)
    kept = ((keys >> np.uint64(32 - bits)) & LOW).astype("<u4")
    small, large = [], []
    for c in columns:
        c = c[order]
        big = np.flatnonzero(c >= ESCAPE)
        small.append(pad(np.minimum(c, ESCAPE).astype(np.uint8).tobytes()))
        large.append(np.stack((big.astype("<u8"), c[big].astype("<u8"))).tobytes())
    head = np.zeros(8, "<u8")
    head[:4] = len(keys), bits, len(columns), most.bit_length()
    head[4 : 4 + len(columns)] = [len(x) // 16 for x in large]
    return b"".join((head.tobytes(), pad(starts.astype("<u4").tobytes()), pad(kept.tobytes()), *small, *large))


class Table:
    """A sorted hash array of ``pack_table``, read where it lies."""

    def __init__(self, data: np.ndarray):
        head = data[:64].view("<u8")
        self.n, self.bits, columns, self.steps = (int(x) for x in head[:4])
        at = 64
        self.starts = data[at : at + 4 * ((1 << self.bits) + 1)].view("<u4")
        at += -(-4 * ((1 << self.bits) + 1) // 8) * 8
        self.kept = data[at : at + 4 * self.n].view("<u4")
        at += -(-4 * self.n // 8) * 8
        self.small, self.large = [], []
        for _ in range(columns):
            self.small.append(data[at : at + self.n])
            at += -(-self.n // 8) * 8
        for k in range(columns):
            size = 16 * int(head[4 + k])
            self.large.append(data[at : at + size].view("<u8").reshape(2, -1))
            at += size

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each hash, or -1: a binary search in all buckets at once."""
        if not self.n:
            return np.full(len(keys), -1, np.int64)
        want = ((keys >> np.uint64(32 - self.bits)) & LOW).astype(np.uint32)
        bucket = (keys >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(keys), np.int64)
        low, high = self.starts[bucket].astype(np.int64), self.starts[bucket + 1].astype(np.int64)
        end = high
        for _ in range(self.steps):
            middle = (low + high) >> 1
            less = (middle < high) & (self.kept[np.minimum(middle, self.n - 1)] < want)
            low = np.where(less, middle + 1, low)
            high = np.where(less, high, middle)
        here = np.minimum(low, self.n - 1)
        return np.where((low < end) & (self.kept[here] == want), here, -1)

    def values(self, places: np.ndarray, column: int) -> np.ndarray:
        """The values of a column at places, 0 at -1."""
        if not self.n:
            return np.zeros(len(places), np.int64)
        out = np.where(places >= 0, self.small[column][places], 0).astype(np.int64)
        if len(big := np.flatnonzero(out == ESCAPE)):
            where, value = self.large[column]
            out[big] = value[np.searchsorted(where, places[big].astype(np.uint64))]
        return out
