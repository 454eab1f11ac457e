"""Byte-level BPE encoding and decoding by a global shuffle of distinct words.

Words are the chunks of ``chunks.py``. A block of documents numbers its distinct words, sends them, packed, to the
bucket of their hash, and keeps its documents as runs of word numbers. A bucket meets each distinct word once per
block, encodes it once, and answers every block; the blocks put their documents together by position. What is
shuffled is one copy of a word per block, never one row per occurrence, so frequent words make no hot key.
Decoding looks every id up in the table of token bytes, whose size is that of the tokenizer.

Defined results: a null or empty text has no ids and decodes to no bytes; repeated rows give repeated results; an
empty table gives no rows; columns other than ``doc_id`` and ``text`` are not read. A run of text without white
space is one word, however long.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.blocks import U64, binary_column, blocks, bytes_of, spread, texts_of
from lumenframe.llm.chunks import distinct_chunks
from lumenframe.llm.scratch import partitions

#: Bytes of text in a block: larger blocks send fewer copies of frequent words and need more memory.
BLOCK_BYTES = 3 << 20
_PART = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("payload", pa.binary())])
_PART_SQL = "block long, bucket int, payload binary"
#: Never a byte of UTF-8, so it parts words.
_BETWEEN = b"\xff"


@lru_cache(maxsize=2)
def tokenizer(rank_file: str, pattern: str):
    """The tiktoken encoding of a rank file, without special tokens; kept by the Python worker."""
    import tiktoken

    with open(rank_file, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=2)
def token_bytes(rank_file: str) -> tuple[np.ndarray, np.ndarray]:
    """The token-byte table: offsets by id, and all bytes in a row."""
    with open(rank_file, "rb") as f:
        table = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, f)}
    tokens = [table.get(i, b"") for i in range(max(table) + 1)]
    return np.cumsum([0, *map(len, tokens)]), np.frombuffer(b"".join(tokens), np.uint8)


def _numbered(block, n_buckets: int) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """Distinct words by bucket, each list sorted; the documents' words as numbers in that order; words per document."""
    found = distinct_chunks(block)
    lists: list[list[tuple[bytes, int]]] = [[] for _ in range(n_buckets)]
    for bucket, pair in zip((found.hashes % U64(n_buckets)).tolist(), zip(found.chunks, range(len(found.chunks)))):
        lists[bucket].append(pair)
    for one in lists:
        one.sort()
    place = np.zeros(len(found.chunks), np.uint32)
    place[[i for one in lists for _, i in one]] = np.arange(len(found.chunks), dtype=np.uint32)
    return [[w for w, _ in one] for one in lists], place[found.numbers], found.counts


def _send(n_buckets: int, what: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for block in blocks(batches, BLOCK_BYTES):
            # by content: if the two passes over the input ever cut it differently, a block finds no answer and says so
            key = xxhash.xxh3_64_intdigest(block.ids.tobytes() + block.offsets.tobytes() + block.data.tobytes()) - 2**63
            lists, numbers, counts = _numbered(block, n_buckets)
            if what == "words":
                rows = [(b, pack(_BETWEEN.join(one))) for b, one in enumerate(lists) if one]
            else:
                # high and low bytes apart compress better
                head = np.array([len(block.ids), len(numbers)], np.int64).tobytes() + block.ids.astype(np.int64).tobytes() + counts.astype(np.int64).tobytes()
                rows = [(-1, pack(head + numbers.view(np.uint8).reshape(-1, 4).T.tobytes()))]
            yield pa.record_batch([pa.array([key] * len(rows), pa.int64()), pa.array([b for b, _ in rows], pa.int32()), pa.array([p for _, p in rows], pa.binary())], schema=_PART)

    return run


def _answer(rank_file: str, pattern: str):
    def run(group: pa.Table) -> pa.Table:
        encode = tokenizer(rank_file, pattern).encode_ordinary
        pack, unpack = zstandard.ZstdCompressor(level=3).compress, zstandard.ZstdDecompressor().decompress
        known: dict[bytes, tuple[int, bytes]] = {}
        out = []
        for payload in group.column("payload"):
            words = unpack(payload.as_py()).split(_BETWEEN)
            for w in words:
                if w not in known:
                    ids = encode(w.decode("utf-8", "replace"))
                    known[w] = (len(ids), np.array(ids, np.uint32).tobytes())
            found = [known[w] for w in words]
            counts = np.array([n for n, _ in found], np.uint32)
            ids = np.frombuffer(b"".join([b for _, b in found]), np.uint32)
            low = ids.astype(np.uint16).tobytes() if len(ids) == 0 or ids.max() < 1 << 16 else ids.tobytes()
            out.append(pack(np.array([len(counts), len(low) // max(1, len(ids))], np.int64).tobytes() + counts.tobytes() + low))
        return pa.table([group.column("block"), group.column("bucket"), pa.array(out, pa.binary())], schema=_PART)

    return run


_IDS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])


def _assemble(group: pa.Table) -> pa.Table:
    unpack = zstandard.ZstdDecompressor().decompress
    counts, flat = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
    rows = list(zip(group.column("bucket").to_pylist(), group.column("payload").to_pylist()))
    for _, payload in sorted({b: p for b, p in rows if b >= 0}.items()):
        raw = unpack(payload)
        n, width = np.frombuffer(raw, np.int64, 2)
        counts.append(np.frombuffer(raw, np.uint32, n, 16).astype(np.int64))
        flat.append(np.frombuffer(raw, np.uint16 if width == 2 else np.uint32, offset=16 + 4 * n).astype(np.uint32))
    own = [unpack(p) for b, p in rows if b < 0]  # more than one if whole blocks repeat
    if not own:
        raise RuntimeError("answers for an unknown block: its input was read in another order")
    per_word, tokens = np.concatenate(counts), np.concatenate(flat)
    return pa.concat_tables([_block_ids(x, per_word, tokens) for x in own])


def _block_ids(own: bytes, per_word: np.ndarray, tokens: np.ndarray) -> pa.Table:
    n_docs, n_words = np.frombuffer(own, np.int64, 2)
    ids = np.frombuffer(own, np.int64, n_docs, 16)
    words_in = np.frombuffer(own, np.int64, n_docs, 16 + 8 * n_docs)
    numbers = np.ascontiguousarray(np.frombuffer(own, np.uint8, offset=16 + 16 * n_docs).reshape(4, n_words).T).view(np.uint32).ravel()
    if n_words and (not len(per_word) or numbers.max() >= len(per_word)):
        raise RuntimeError("a block misses answers: its input was read in another order")
    at = np.cumsum(per_word) - per_word
    n = per_word[numbers] if n_words else np.zeros(0, np.int64)
    run, place = spread(n)
    stream = tokens[at[numbers][run] + place] if n_words else tokens
    ends = np.cumsum(n)
    doc_ends = np.concatenate([[0], np.cumsum(words_in)])
    token_ends = np.where(doc_ends > 0, ends[np.maximum(doc_ends - 1, 0)], 0) if n_words else np.zeros(n_docs + 1, np.int64)
    values = binary_column(token_ends * 4, stream.astype("<u4"))
    return pa.table([pa.array(ids), pa.array(np.diff(token_ends)), values], schema=_IDS)


def encode(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """``doc_id, n_tokens, ids``: every whole text's token ids as little-endian unsigned 32-bit integers.

    ``rank_file`` must be readable on every executor (it is a path of the tokenizer installation).
    """
    texts = texts_of(docs)
    n = partitions(docs.sparkSession)
    words = texts.mapInArrow(_send(n, "words"), _PART_SQL)
    answers = words.groupBy("bucket").applyInArrow(_answer(rank_file, pattern), _PART_SQL)
    sequences = texts.mapInArrow(_send(n, "sequences"), _PART_SQL)
    return answers.unionByName(sequences).groupBy("block").applyInArrow(_assemble, "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, rank_file: str) -> DataFrame:
    """Adds ``decoded``, the bytes of ``ids`` by the token-byte table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        offsets, table = token_bytes(rank_file)
        sizes = np.diff(offsets)
        for whole in batches:
            at = 0
            while at < whole.num_rows:
                starts, _ = bytes_of(whole.column(2).slice(at))
                to = max(1, int(np.searchsorted(starts, starts[0] + BLOCK_BYTES, "right")) - 1)
                batch = whole.slice(at, min(to, whole.num_rows - at))
                at += batch.num_rows
                starts, data = bytes_of(batch.column(2))
                ids = np.frombuffer(data[starts[0] : starts[-1]].tobytes(), "<u4")
                run_, place = spread(sizes[ids])
                ends = np.concatenate([[0], np.cumsum(sizes[ids])])[(starts - starts[0]) // 4]
                out = binary_column(ends, table[offsets[ids][run_] + place])
                yield pa.RecordBatch.from_arrays([*batch.columns, out], names=["doc_id", "n_tokens", "ids", "decoded"])

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded binary")
