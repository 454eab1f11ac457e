"""Token ids of a corpus as seekable files in ascending ``doc_id`` order, and their reading.

Documents are range-partitioned by id; each task writes one file of its range and reports it. The reports are kept as
a table, the manifest: only files it lists count, so that a task that is run again, or twice, leaves at most a file
that nobody reads. ``start`` adds up the manifest's few rows, never the documents'.

Defined results: a null or empty text has the end id alone; rows without an id are left out; repeated ids follow each
other, ordered by text; an empty table gives an empty manifest and no rows. Files go to a URI that pyarrow can open
on all executors (``file:``, ``hdfs:``, ``s3:``).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.llm.blocks import binary_column, blocks, spread, texts_of
from lumenframe.llm.chunks import Distinct, distinct_chunks
from lumenframe.llm.scratch import kept, new_folder, partitions
from lumenframe.llm.seekable import FRAME_BYTES, Reader, Writer

#: Encoded words that a Python worker remembers before it starts anew: about 60 bytes each.
CACHE_WORDS = 2_000_000
BLOCK_BYTES = 2 << 20


class WordEncoder:
    """Encodes words with the tokenizers library and remembers them as sorted arrays.

    A word is known by its hash and its first bytes; one that shares the hash alone is encoded and not remembered.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.forget()

    def forget(self) -> None:
        self.keys, self.heads = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.at, self.sizes, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")

    def encoded(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words in a row, and their number per word."""
        ids, sizes = [np.zeros(0, "<u4")], [np.zeros(0, np.int64)]
        for at in range(0, len(words), 1000):
            part = [w.decode("utf-8", "replace") for w in words[at : at + 1000]]
            got = self.tokenizer.encode(part, is_pretokenized=True, add_special_tokens=False)
            ids.append(np.array(got.ids, "<u4"))
            sizes.append(np.bincount(np.array(got.word_ids, np.int64), minlength=len(part)))
        return np.concatenate(ids), np.concatenate(sizes)

    def __call__(self, found: Distinct) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids at hand, and each distinct word's first place and number of ids among them."""
        if len(self.keys) > CACHE_WORDS:
            self.forget()
        n, order = len(found.chunks), np.argsort(found.hashes)
        keys, heads = found.hashes[order], found.heads[order]
        slot = np.searchsorted(self.keys, keys)
        near = np.minimum(slot, max(len(self.keys) - 1, 0))
        taken = (slot < len(self.keys)) & (self.keys[near] == keys) if len(self.keys) else np.zeros(n, bool)
        known = taken & (self.heads[near] == heads) if len(self.keys) else taken
        at, sizes = np.zeros(n, np.int64), np.zeros(n, np.int64)
        at[order[known]], sizes[order[known]] = self.at[near[known]], self.sizes[near[known]]
        new = order[~known]
        ids, counts = self.encoded([found.chunks[i] for i in new.tolist()])
        at[new], sizes[new] = len(self.flat) + np.cumsum(counts) - counts, counts
        fresh = ~taken
        put, who = slot[fresh], order[fresh]
        self.flat = np.concatenate([self.flat, ids])
        self.keys, self.heads = np.insert(self.keys, put, keys[fresh]), np.insert(self.heads, put, heads[fresh])
        self.at, self.sizes = np.insert(self.at, put, at[who]), np.insert(self.sizes, put, sizes[who])
        return self.flat, at, sizes


@lru_cache(maxsize=1)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def encode_block(block, encoder: WordEncoder, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a block's documents in a row, each document's closed by ``end_id``, and their number per document."""
    found = distinct_chunks(block)
    flat, at, sizes = encoder(found)
    n = sizes[found.numbers]
    run, place = spread(n)
    stream = flat[at[found.numbers][run] + place]
    counts = np.diff(np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(found.counts)])])
    if end_id is None:
        return stream, counts
    return np.insert(stream, np.cumsum(counts), end_id), counts + 1


_MANIFEST = pa.schema([("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("first_doc", pa.int64()), ("last_doc", pa.int64()), ("n_frames", pa.int64())])


def write(docs: DataFrame, tokenizer_file: str, folder: str, end_id: int = 0) -> DataFrame:
    """Encodes all texts, writes one file a partition below ``folder`` and returns the manifest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, n_docs, n_tokens, first, last = None, 0, 0, 0, 0
        for block in blocks(batches, BLOCK_BYTES):
            ids, counts = encode_block(block, word_encoder(tokenizer_file), end_id)
            if writer is None:
                where, name = pafs.FileSystem.from_uri(folder)
                where.create_dir(name, recursive=True)
                file = f"{uuid.uuid4().hex}.tokens.zst"
                writer, first = Writer(where.open_output_stream(f"{name}/{file}", compression=None)), int(block.ids[0])
            ends, at = np.cumsum(counts), 0
            while at < len(counts):
                lo = ends[at] - counts[at]
                to = max(at + 1, int(np.searchsorted(ends, lo + FRAME_BYTES // 2, "right")))
                writer.add(block.ids[at:to], counts[at:to], ids[lo : ends[to - 1]])
                at = to
            n_docs, n_tokens, last = n_docs + len(counts), n_tokens + len(ids), int(block.ids[-1])
        if writer is not None:
            writer.close()
            yield pa.record_batch([[f"{folder}/{file}"], [n_docs], [n_tokens], [first], [last], [len(writer.table)]], schema=_MANIFEST)

    n = partitions(docs.sparkSession)
    ordered = texts_of(docs).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    return kept(ordered.mapInArrow(run, "path string, n_docs long, n_tokens long, first_doc long, last_doc long, n_frames long"), "manifest")


_READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])


def read(manifest: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of all documents in the manifest's files; ``start`` counts ids over all files."""
    before = F.sum("n_tokens").over(Window.orderBy("first_doc", "path").rowsBetween(Window.unboundedPreceding, -1))
    files = manifest.select("path", F.coalesce(before, F.lit(0)).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                reader = Reader(path)
                for doc_ids, counts, ids in reader.frames():
                    ends = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
                    yield pa.record_batch([pa.array(doc_ids), pa.array(base + ends[:-1]), pa.array(counts.astype(np.int64)), binary_column(ends * 4, ids)], schema=_READ)
                    base += int(ends[-1])
                reader.close()

    return files.repartition(partitions(manifest.sparkSession)).mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def write_and_read(docs: DataFrame, tokenizer_file: str, end_id: int = 0) -> DataFrame:
    """Token files in a new folder below the shared one, read back."""
    return read(write(docs, tokenizer_file, new_folder(docs.sparkSession, "tokens"), end_id))
