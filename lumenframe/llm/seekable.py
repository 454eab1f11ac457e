"""Token files: independent zstandard frames, an index of documents by frame, and a trailing seek table.

The layout is the public seekable format of zstandard (a skippable frame at the end lists the sizes and checksum of
every frame), so plain zstandard tools can also read the files. Each frame holds whole documents:
``n_docs u32, id width u32, doc ids i64[], ids per document u32[], all ids``, little-endian. One more skippable frame
before the seek table keeps the first document of each frame, for binary search.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import numpy as np
import xxhash
import zstandard
from pyarrow import fs as pafs

# Fixed values of the seekable format.
SEEK_MAGIC = 0x184D2A5E
FOOTER_MAGIC = 0x8F92EAB1
HAS_CHECKSUM = 0x80
#: A skippable frame that other readers pass over.
INDEX_MAGIC = 0x184D2A50
FRAME_BYTES = 1 << 18


def pack_frame(doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> bytes:
    """A frame's content; ids below 65,536 take two bytes."""
    width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    return struct.pack("<II", len(doc_ids), width) + doc_ids.astype("<i8").tobytes() + counts.astype("<u4").tobytes() + ids.astype(f"<u{width}").tobytes()


def unpack_frame(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, width = struct.unpack_from("<II", raw)
    return np.frombuffer(raw, "<i8", n, 8), np.frombuffer(raw, "<u4", n, 8 + 8 * n), np.frombuffer(raw, f"<u{width}", offset=8 + 12 * n).astype("<u4")


class Writer:
    """Appends frames to a stream; ``close`` adds the index and the seek table."""

    def __init__(self, sink, level: int = 3):
        self.sink, self.pack, self.table, self.first = sink, zstandard.ZstdCompressor(level=level, write_checksum=True).compress, [], []

    def add(self, doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
        raw = pack_frame(doc_ids, counts, ids)
        packed = self.pack(raw)
        self.sink.write(packed)
        self.table.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.first.append(int(doc_ids[0]))

    def close(self) -> None:
        index = np.array(self.first, "<i8").tobytes()
        self.sink.write(struct.pack("<II", INDEX_MAGIC, len(index)) + index)
        entries = np.array(self.table, "<u4").reshape(-1, 3).tobytes()
        footer = struct.pack("<IBI", len(self.table), HAS_CHECKSUM, FOOTER_MAGIC)
        self.sink.write(struct.pack("<II", SEEK_MAGIC, len(entries) + len(footer)) + entries + footer)
        self.sink.close()


class Reader:
    """Random access to the frames of one file; reads the seek table first, then only what is asked for."""

    def __init__(self, path: str):
        where, name = pafs.FileSystem.from_uri(path)
        self.file = where.open_input_file(name)
        size = self.file.size()
        n, flags, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != FOOTER_MAGIC or not flags & HAS_CHECKSUM:
            raise ValueError(f"{path} has no seek table")
        table = np.frombuffer(self.file.read_at(12 * n, size - 9 - 12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.packed, self.sums = table[:, 0], table[:, 2]
        self.at = np.cumsum(self.packed) - self.packed
        self.first = np.frombuffer(self.file.read_at(8 * n, int(self.packed.sum()) + 8), "<i8")
        self.unpack = zstandard.ZstdDecompressor().decompress

    def frame(self, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document ids, ids per document and ids of one frame; its checksum must hold."""
        raw = self.unpack(self.file.read_at(int(self.packed[i]), int(self.at[i])))
        if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.sums[i]:
            raise ValueError(f"frame {i} fails its checksum")
        return unpack_frame(raw)

    def frames(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        return (self.frame(i) for i in range(len(self.packed)))

    def documents(self, wanted: Iterable[int]) -> Iterator[tuple[int, np.ndarray]]:
        """``(doc_id, ids)`` of the wanted documents; only frames that can hold one are decompressed."""
        want = np.unique(np.array(list(wanted), np.int64))
        lo, hi = np.maximum(np.searchsorted(self.first, want, "left") - 1, 0), np.searchsorted(self.first, want, "right")
        for i in sorted({f for a, b in zip(lo, hi) for f in range(a, b)}):
            ids, counts, values = self.frame(i)
            ends = np.cumsum(counts, dtype=np.int64)
            for k in np.flatnonzero(np.isin(ids, want)):
                yield int(ids[k]), values[ends[k] - counts[k] : ends[k]]

    def close(self) -> None:
        self.file.close()
