import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lumenframe.llm import bpe, chunks, crf, dart_minhash, debruijn, mixing, nbsvm, outliers, seekable, suffix_radix, token_files, winnowing
from lumenframe.llm.blocks import Block
from lumenframe.llm.scratch import new_folder

WORD = re.compile(r"[^\x20\x09-\x0D]+")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
HF = public_tokenizers.path("byte_bpe_50k.json")


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def block_of(texts):
    raw = [t.encode() for t in texts]
    return Block(np.arange(len(raw)), np.cumsum([0, *map(len, raw)]), np.frombuffer(b"".join(raw), np.uint8))


def test_chunks_encode_like_whole_texts():
    rng = random.Random(3)
    parts = ["a", "Bc", " ", "  ", "\n", "\r\n", "\t", "'s", "'", "é", " ", " ", "　", "漢字", "9", "!?", "\x1c", "\x85", "𝒳", "ñ"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(400)]
    encode = bpe.tokenizer(RANKS, public_tokenizers.PATTERN).encode_ordinary
    found = chunks.distinct_chunks(block_of(texts))
    ids = [encode(c.decode()) for c in found.chunks]
    at = 0
    for text, n in zip(texts, found.counts):
        assert [i for k in found.numbers[at : at + n] for i in ids[k]] == encode(text)
        at += n


def test_bpe_round_trip(awkward, rows_of, empty):
    encode = bpe.tokenizer(RANKS, public_tokenizers.PATTERN).encode_ordinary
    out = by_id(bpe.decode(bpe.encode(awkward, RANKS, public_tokenizers.PATTERN), RANKS))
    assert set(out) == set(rows_of)
    for i, text in rows_of.items():
        assert np.frombuffer(out[i].ids, "<u4").tolist() == encode(text) and bytes(out[i].decoded) == text.encode()
    assert bpe.encode(empty, RANKS, public_tokenizers.PATTERN).count() == 0
    twice = bpe.encode(awkward.filter("doc_id = 33").unionByName(awkward.filter("doc_id = 33")), RANKS, public_tokenizers.PATTERN)
    assert twice.count() == 2


def test_token_files(spark, awkward, rows_of, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(HF)
    manifest = token_files.write(awkward, HF, new_folder(spark, "test-tokens"))
    out, start = by_id(token_files.read(manifest)), 0
    for i in sorted(rows_of):
        want = [*tok.encode(rows_of[i], add_special_tokens=False).ids, 0]
        assert np.frombuffer(out[i].ids, "<u4").tolist() == want and (out[i].start, out[i].n_tokens) == (start, len(want))
        start += len(want)
    first = manifest.orderBy("first_doc").first()
    reader = seekable.Reader(first.path)
    assert [i for i, _ in reader.documents([first.first_doc, -5])] == [first.first_doc]
    reader.sums = reader.sums + 1
    with pytest.raises(ValueError, match="checksum"):
        reader.frame(0)
    assert token_files.write_and_read(empty, HF).count() == 0


def brute_windows(texts, units, size):
    """First document of every window, in ascending order of ids."""
    seen = {}
    for i in sorted(texts):
        u = units(texts[i])
        for p in range(len(u) - size + 1):
            seen.setdefault(u[p : p + size] if isinstance(u, bytes) else tuple(u[p : p + size]), i)
    return seen


def covered(u, i, seen, size):
    gone = [False] * len(u)
    for p in range(len(u) - size + 1):
        if seen[u[p : p + size] if isinstance(u, bytes) else tuple(u[p : p + size])] < i:
            gone[p : p + size] = [True] * size
    return gone


def test_repeated_bytes(awkward, rows_of, empty):
    out = by_id(suffix_radix.cleaned(awkward))
    seen = brute_windows(rows_of, lambda t: t.encode(), 50)
    for i, t in rows_of.items():
        u = t.encode()
        gone = covered(u, i, seen, 50)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        assert bytes(out[i].kept) == bytes(b for b, g in zip(u, gone) if not g)
        assert (out[i].n_bytes, out[i].n_removed, out[i].n_spans) == (len(u), sum(gone), spans)
    assert suffix_radix.cleaned(empty).count() == 0
    rest = suffix_radix.without_repeats(awkward)
    assert rest.columns == awkward.columns and rest.filter("doc_id = 36").count() == 0 and rest.filter("doc_id = 0").first().text is None


def test_ties_across_places_of_anchors():
    """Repetitive units: the same windows are found wherever their block starts."""
    from lumenframe.llm.anchors import runs_of, to_ends
    from lumenframe.llm.blocks import byte_values

    body = b"ab" * 400 + bytes(range(97, 123)) * 8
    at = {}
    for lead in (0, 65_536 - 300, 65_536 - 17):
        data = np.frombuffer(b"x" * lead + body, np.uint8)
        sizes = np.array([lead, len(body)]) if lead else np.array([len(body)])
        runs = runs_of(byte_values(data), to_ends(sizes), 50, 16)
        own = {p - lead: (int(a), s - lead) for a, s, f, n in zip(runs.anchor, runs.at, runs.first, runs.count) for p in range(f, f + n) if f >= lead}
        at.setdefault("want", own)
        assert own == at["want"] and len(own) == len(body) - 49


def test_repeated_words(awkward, rows_of, empty):
    out = by_id(debruijn.cleaned(awkward))
    seen = brute_windows(rows_of, WORD.findall, 50)
    for i, t in rows_of.items():
        u = WORD.findall(t)
        gone = covered(u, i, seen, 50)
        assert (out[i].n_words, out[i].n_removed) == (len(u), sum(gone))
        assert out[i].kept_text == " ".join(w for w, g in zip(u, gone) if not g)
    assert debruijn.cleaned(empty).count() == 0


def shingles(t):
    w = WORD.findall(t)
    return collections.Counter([tuple(w[i : i + 5]) for i in range(len(w) - 4)] or ([tuple(w)] if w else []))


def test_near_duplicate_classes(awkward, rows_of, empty):
    out = by_id(dart_minhash.classes(awkward))
    ids, sets = sorted(rows_of), {i: shingles(t) for i, t in rows_of.items()}
    root = {i: i for i in ids}
    for i in ids:
        for j in ids:
            both = sum((sets[i] & sets[j]).values())
            if i < j and both and both >= 0.8 * (sum(sets[i].values()) + sum(sets[j].values()) - both):
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = {k: new if r == old else r for k, r in root.items()}
    assert {i: out[i].class_id for i in ids} == root
    assert dart_minhash.classes(empty).count() == 0
    assert dart_minhash.deduplicated(awkward).columns == awkward.columns


def test_links_past_the_pivot(spark):
    """Copies of one text with up to seven words changed: many reach a copy but not the original."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(150)]
    texts = [words]
    for _ in range(120):
        copy = list(words)
        for _ in range(rng.randrange(1, 8)):
            copy[rng.randrange(len(copy))] = f"x{rng.randrange(30)}"
        texts.append(copy)
    sets = [shingles(" ".join(t)) for t in texts]
    root = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            both = sum((a & b).values())
            if both >= 0.8 * (sum(a.values()) + sum(b.values()) - both):
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    out = by_id(dart_minhash.classes(docs))
    assert [out[i].class_id for i in range(len(texts))] == root
    assert len(set(root)) > 1


def test_signatures_estimate_weighted_similarity():
    a, b = ["x y z u v " * 3 + " ".join(f"k{i}" for i in range(300))], ["x y z u v " * 3 + " ".join(f"k{i}" for i in range(60, 360))]
    docs, keys, _ = dart_minhash.unit_cells(block_of(a + b))
    sig = dart_minhash.signatures(docs, keys, 2)
    both = sum((shingles(a[0]) & shingles(b[0])).values())
    want = both / (2 * sum(shingles(a[0]).values()) - both)
    assert sig.all() and abs((sig[0] == sig[1]).mean() - want) < 0.2


def test_winnowing(awkward, rows_of, empty):
    out = by_id(winnowing.edited_likeness(awkward))
    order = sorted(rows_of, reverse=True)
    for at, i in enumerate(order):
        text, after = rows_of[i], rows_of[order[(at + 1) % len(order)]]
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        assert out[i].n_chars == len(text) and out[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= out[i].near_next <= 1 and out[i].widest_gap <= winnowing.W
    same = collections.defaultdict(set)
    for i, t in rows_of.items():
        same[t].add(out[i].fingerprint)
    assert all(len(v) == 1 for v in same.values())
    prints = by_id(winnowing.fingerprints(awkward))
    shared = set(prints[42].hashes) & set(prints[45].hashes) & set(prints[48].hashes)
    assert shared and len(prints[42].hashes) == len(prints[42].positions)
    assert winnowing.edited_likeness(empty).count() == 0


def test_languages(spark, awkward, empty):
    rng = random.Random(1)
    sounds = {"aa": ["ba", "ko", "ta", "mi"], "bb": ["xen", "zor", "qui", "wyx"]}
    say = lambda k, n: " ".join("".join(rng.choices(sounds[k], k=rng.randint(1, 3))) for _ in range(n))
    rows = [(i, say(k, 60), k) for i, k in enumerate(["aa", "bb"] * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = crf.train(docs)
    out = by_id(crf.predict(docs, model))
    assert all(out[i].lang_pred == k for i, _, k in rows)
    assert any(out[i].held_out for i in out) and out[3].held_out == (zlib.crc32(b"3") % 4 == 2)
    mixed = block_of([say("aa", 30) + " " + say("bb", 30)])
    x, gamma = crf.label_words(mixed, model)
    assert (gamma.argmax(1) == np.repeat([0, 1], 30)).mean() > 0.9
    odd = by_id(crf.predict(awkward, model))
    assert all(odd[i].lang_pred == "und" and odd[i].score == 0 for i in (0, 3, 6, 30))
    assert crf.train(empty) is None and crf.predict(empty, None).count() == 0
    assert {r.lang_pred for r in crf.predict(awkward, None).collect()} == {"und"}


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(2)
    scores, t, b = rng.normal(size=(5, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    starts = np.array([True, False, False, True, False])
    total, sums = 0.0, np.zeros((5, 3))
    for path in np.ndindex(3, 3, 3, 3, 3):
        p = np.exp(sum(scores[i, y] + (b[y] if starts[i] else t[path[i - 1], y]) for i, y in enumerate(path)))
        total += p
        for i, y in enumerate(path):
            sums[i, y] += p
    assert np.allclose(crf.forward_backward(scores, starts, t, b)[0], sums / total)


def test_outlier_statistics(awkward, rows_of, empty):
    out = by_id(outliers.judge(awkward))
    for i, t in rows_of.items():
        w, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
        c = collections.Counter(zip(w, w[1:], w[2:]))
        again = {k for j in range(len(w) - 2) if c[w[j], w[j + 1], w[j + 2]] > 1 for k in (j, j + 1, j + 2)}
        r = out[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(x in outliers.SYMBOLS for x in t), len(lines) - len(set(lines)), len(again))
        assert r.base_failed == (len(w) < 50 or 100 * len(again) > 50 * len(w)) and not (r.base_failed and r.kept)
    assert outliers.judge(empty).count() == 0


def test_outliers_are_rejected(spark):
    rng = random.Random(5)
    text = lambda symbol: " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) + (symbol if rng.random() < 0.6 else "") for _ in range(120))
    docs = spark.createDataFrame([(i, text("|" if i % 25 == 0 else ""), "en", "s") for i in range(400)], "doc_id long, text string, lang string, source string")
    assert {r.doc_id for r in outliers.judge(docs).filter("not kept").collect()} == {i for i in range(400) if i % 25 == 0}


def test_quality(spark, awkward, empty):
    rng = random.Random(6)
    good = lambda: " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(60))
    docs = spark.createDataFrame([(i, good() if i % 3 else good().upper().replace(" ", "!! ")) for i in range(240)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(240)] + [(None, 1), (5000, 0), (7, None)], "doc_id long, quality int")
    model = nbsvm.train(docs, labels)
    out = by_id(nbsvm.score(docs, model))
    assert all(r.predicted == int(i % 3 > 0) for i, r in out.items())
    assert {r.doc_id for r in nbsvm.accepted(docs, model).collect()} == {i for i in out if i % 3}
    odd = by_id(nbsvm.score(awkward, model))
    assert odd[0].score == odd[3].score and all(0 <= r.score <= 1 for r in odd.values())
    none = nbsvm.train(docs, labels.limit(0))
    assert nbsvm.score(empty, none).count() == 0 and nbsvm.score(docs, none).first().score == 0.5


def test_mixing(spark, awkward, empty):
    docs = spark.createDataFrame([(i, "word " * (10 + i % 7), ("en", "fr", None)[i % 3], "hot" if i % 2 else f"s{i % 5}") for i in range(300)], "doc_id long, text string, lang string, source string")
    out = mixing.weighted(docs)
    rows = out.collect()
    total = sum(r._n_tokens for r in rows)
    assert abs(sum(r._n_tokens * r.prob for r in rows) - mixing.BUDGET * total) < 1e-6 * total
    for dim in ("_source", "_lang"):
        now, before = collections.Counter(), collections.Counter()
        for r in rows:
            now[r[dim]] += r.weight * r._n_tokens
            before[r[dim]] += r._n_tokens
        power = {k: v**0.7 for k, v in before.items()}
        assert all(abs(now[k] / sum(now.values()) - p / sum(power.values())) < 1e-3 for k, p in power.items())
    drawn = mixing.sample(awkward)
    assert drawn.columns == awkward.columns and drawn.count() > 0
    assert mixing.sample(empty).count() == 0


def test_sample_has_target_shares(spark):
    """A budget that a rare language can't meet: the expected sample keeps the target shares, as large as they allow."""
    langs = ["en"] * 80 + ["fr"] * 15 + ["es"] * 5
    docs = spark.createDataFrame([(i, f"{'abcdefgh'[i % 8] * 6} word " * (10 + i % 7), langs[i % 100], f"s{i % 3}") for i in range(1200)], "doc_id long, text string, lang string, source string")
    rows = mixing.weighted(docs).collect()
    total = sum(r._n_tokens for r in rows)
    for dim, power in (("_source", 0.7), ("_lang", 0.7), ("_topic", 0.0)):
        drawn, before = collections.Counter(), collections.Counter()
        for r in rows:
            drawn[r[dim]] += r.prob * r._n_tokens
            before[r[dim]] += r._n_tokens
        goal = {k: v**power for k, v in before.items()}
        assert all(abs(drawn[k] / sum(drawn.values()) / (g / sum(goal.values())) - 1) < 1e-5 for k, g in goal.items())
    assert all(r.prob <= 1 for r in rows) and max(r.prob for r in rows) > 0.99
    assert 0.25 * total < sum(r.prob * r._n_tokens for r in rows) < 0.8 * total


def test_small_groups_have_their_own_estimates(spark):
    """Clean texts of small groups in a language of longer words are no outliers; the languages' own outliers are."""
    rng = random.Random(7)
    def text(low, high, symbol=""):
        return " ".join("".join(rng.choices("abcdefgh", k=rng.randint(low, high))) + symbol for _ in range(120))

    rows = [(i, text(2, 7), "en", "s") for i in range(600)]  # over three quarters of the table
    rows += [(1000 + i, text(8, 16, "|" if i % 20 == 0 else ""), "de", "s") for i in range(60)]  # a group of its own
    rows += [(2000 + i, text(8, 16, "|" if i % 20 == 0 else ""), "fi", f"s{i % 6}") for i in range(60)]  # ten a source: the language's
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert {r.doc_id for r in outliers.judge(docs).filter("not kept").collect()} == {b + i for b in (1000, 2000) for i in (0, 20, 40)}


def test_short_texts_are_like_their_edits():
    """A text keeps a likeness to its first two thirds with another end; texts of 23 code points on share 15 in a row."""
    rng = random.Random(8)
    say = lambda n: "".join(rng.choices("abcdefgh é", k=n))
    texts = [say(n) for n in range(23, 127) for _ in range(5)]
    edited = [t[: len(t) - len(t) // 3] + say(len(t) // 3) for t in texts]
    printed = lambda ts: winnowing.distinct(winnowing.winnow(np.frombuffer("".join(ts).encode("utf-32-le"), np.uint32), np.cumsum([0, *map(len, ts)])))
    alike = winnowing.likeness(printed(texts), printed(edited), len(texts))
    assert (alike > 0).all() and 0.5 < alike.mean() < 0.75
