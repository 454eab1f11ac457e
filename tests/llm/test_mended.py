"""Long words, long texts, repeated rows and bands taken in turns."""

import random
import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from lumenframe.llm import bpe, dart_minhash, debruijn, nbsvm, suffix_radix, token_files, winnowing
from lumenframe.llm.blocks import Block, Prefix, byte_values, span_hashes


def long_words():
    a, b = bytearray(b"q" * 70_000), bytearray(b"q" * 70_000)
    a[100], b[65_636] = ord("x"), ord("x")
    return a.decode(), b.decode()


def test_words_that_differ_by_a_swap_far_apart_have_two_hashes():
    data = np.frombuffer("".join(long_words()).encode(), np.uint8)
    assert len(set(span_hashes(data, np.array([0, 70_000]), np.array([70_000, 140_000])).tolist())) == 2


def test_long_words_through_the_operators(spark):
    import tokenizers

    one, two = long_words()
    rest = " ".join(f"w{i}" for i in range(49))
    texts = {1: f"{one} {rest}", 2: f"{two} {rest}", 3: f"{one} {rest}"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1)
    removed = {r.doc_id: r.n_removed for r in debruijn.cleaned(docs).collect()}
    assert removed == {1: 0, 2: 0, 3: 50}
    assert {r.doc_id: r.class_id for r in dart_minhash.classes(docs).collect()}[3] == 1
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    decoded = bpe.decode(bpe.encode(docs, ranks, public_tokenizers.PATTERN), ranks)
    assert {r.doc_id: bytes(r.decoded).decode() for r in decoded.collect()} == texts
    files = {r.doc_id: bytes(r.ids) for r in token_files.write_and_read(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()}
    coder = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert files == {d: np.array([*coder.encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes() for d, t in texts.items()}


def plain_winnow(text, k=winnowing.K, w=winnowing.W):
    """Positions by the hashes that the operator gives each gram alone."""
    points = np.array([ord(c) for c in text], np.uint32)
    gram = [int(winnowing.winnow(points[i : i + k], np.array([0, k])).hash[0]) for i in range(len(text) - k + 1)]
    kept = []
    for i in range(len(gram) - w + 1):
        j = max(range(i, i + w), key=lambda x: (-gram[x], x))
        if not kept or kept[-1] != j:
            kept.append(j)
    return kept


@pytest.mark.parametrize("longest", [1, 2, 5, 16, 1 << 23])
def test_windows_in_stretches_are_the_same(longest):
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab") for _ in range(n)) for n in (0, 3, 8, 15, 16, 40, 90)] + ["a" * 50]
    points = np.array([ord(c) for t in texts for c in t], np.uint32)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    found = winnowing.winnow(points, offsets, longest=longest)
    for i, t in enumerate(texts):
        if len(t) >= winnowing.K + winnowing.W - 1:
            assert found.position[found.doc == i].tolist() == plain_winnow(t)
    whole = winnowing.winnow(points, offsets)
    assert found.hash.tolist() == whole.hash.tolist() and found.doc.tolist() == whole.doc.tolist()


def test_positions_beyond_24_bits():
    text = np.tile(np.arange(97, 119, dtype=np.uint32), (1 << 24) // 22 + 40)
    found = winnowing.winnow(text, np.array([0, len(text)]))
    assert found.position[-1] > 1 << 24 and (np.diff(found.position) > 0).all()


def test_repeated_rows_stay_as_many(spark):
    shared = "the same passage of more than fifty bytes that two documents hold, word for word"
    rows = [(1, shared, "a")] * 3 + [(2, "before " + shared, "b")] * 2 + [(2, "another text of this id", "c"), (3, None, "d"), (3, None, "d")]
    out = sorted((r.doc_id, r.text, r.lang) for r in suffix_radix.without_repeats(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect() if r.text is not None)
    assert [o[0] for o in out] == [1, 1, 1, 2, 2, 2] and out[:3] == [(1, shared, "a")] * 3
    assert [o[1] for o in out[3:]] == ["another text of this id", "before ", "before "]


def test_classes_with_few_first_bands_equal_brute_force(spark, monkeypatch):
    rng = random.Random(2)
    base = [[f"v{rng.randrange(5000)}" for _ in range(60)] for _ in range(6)]
    texts = []
    for words in base:
        for _ in range(25):
            own = list(words)
            for _ in range(rng.randrange(0, 4)):
                own[rng.randrange(60)] = f"n{rng.randrange(9)}"
            texts.append(" ".join(own))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    shingles = [{tuple(t.split()[i : i + 5]) for i in range(56)} for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(shingles[i] & shingles[j]) / len(shingles[i] | shingles[j]) >= 0.95:
                root = [root[j] if r == root[i] else r for r in root] if root[j] < root[i] else [root[i] if r == root[j] else r for r in root]
    found = {}
    for first in (1, 8):
        monkeypatch.setattr(dart_minhash, "FIRST_BANDS", first)
        found[first] = {r.doc_id: r.class_id for r in dart_minhash.classes(docs).collect()}
    assert found[1] == found[8]
    assert all(found[8][i] == found[8][r] for i, r in enumerate(root))


def test_label_ratios_equal_plain_counts(spark, monkeypatch):
    """Every training row counts, by what its text holds; held-out and unlabelled ones don't."""
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("Word x "), F.repeat(F.lit("ab "), (F.col("id") % 7).cast("int")), F.col("id").cast("string")).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality")).filter("doc_id % 3 > 0")
    seen, fit = [], nbsvm.fit
    monkeypatch.setattr(nbsvm, "fit", lambda ratio, sample: seen.append(ratio) or fit(ratio, sample))
    nbsvm.train(docs, labels)
    counts = np.full((2, nbsvm.DIM), nbsvm.SMOOTHING)
    for r in docs.collect():
        if r.doc_id % 3 and zlib.crc32(str(r.doc_id).encode()) % 4 != 2:
            raw = np.frombuffer(r.text.encode(), np.uint8)
            np.add.at(counts[r.doc_id % 2], nbsvm.indicators(Block(np.array([r.doc_id]), np.array([0, len(raw)]), raw))[1], 1)
    assert np.abs(seen[0] - np.log(counts[1] / counts[1].sum()) + np.log(counts[0] / counts[0].sum())).max() < 1e-12


def test_runs_and_hashes_by_stretches_are_the_same(monkeypatch):
    rng = np.random.default_rng(7)
    sizes = np.r_[0, 0, rng.integers(0, 400, 60), 5000, 0]
    offsets = np.r_[0, np.cumsum(sizes)]
    block = Block(np.arange(len(sizes)), offsets, rng.integers(97, 100, offsets[-1]).astype(np.uint8))
    values = byte_values(block.data)
    place = rng.integers(0, offsets[-1] - 50, 500)
    whole = suffix_radix.runs_of(values, suffix_radix.to_ends(sizes), suffix_radix.DEPTH, suffix_radix.GRAM)
    hashes = Prefix(block.data, byte_values).hashes(place, 50)
    for stretch in (1, 300, 1 << 20):
        monkeypatch.setattr(suffix_radix, "STRETCH_BYTES", stretch)
        assert all((a == b).all() for a, b in zip(suffix_radix._runs(block), whole))
        assert (Prefix(block.data, byte_values, stretch).hashes(place, 50) == hashes).all()
    nothing = Block(np.arange(2), np.zeros(3, np.int64), np.zeros(0, np.uint8))
    assert not len(suffix_radix._runs(nothing).first)


def test_first_digits_fall_evenly_on_buckets():
    data = np.random.default_rng(3).integers(97, 123, 200_000).astype(np.uint8)
    digits = suffix_radix._judged(Block(np.arange(1), np.array([0, len(data)]), data), {}).digits
    share = np.bincount((digits >> np.uint64(32)) * np.uint64(80) >> np.uint64(32), minlength=80) / len(digits)
    assert len(share) == 80 and 0.5 / 80 < share.min() and share.max() < 2 / 80


def test_fit_holds_no_vector_of_every_text():
    """The driver's memory beside the sample follows the number of texts, not of places."""
    rng = np.random.default_rng(2)
    rows = [(np.unique(rng.integers(0, nbsvm.DIM, 2000)).astype(np.uint16), i % 2) for i in range(300)]
    tracemalloc.start()
    model = nbsvm.fit(rng.normal(size=nbsvm.DIM), rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.isfinite(model.weights).all() and peak < 8 * sum(len(f) for f, _ in rows) / 2


def test_components_are_read_from_one_table(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 5), (7, 8)], "u long, v long")
    found = dart_minhash._components(links)
    assert {r.doc_id: r.root for r in found.collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 7: 7, 8: 7}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Union" not in plan
