"""Filter ranks, disguised identifiers and source divergence against plain Python."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumenframe.llm import deobfuscation, divergence, removal_ranks

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def table(spark, rows, extra="n string, good string, part string, digest string, p string, none string, item string, value string"):
    """``(doc_id, text, lang, source)`` rows beside columns that clash with the operators' own."""
    n = len(extra.split(","))
    rows = [(*r, *["x"] * n) for r in rows]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, {extra}").repartition(3)


# ---- op11 -------------------------------------------------------------------------------------------------------------


def plain_audit(rows, marks):
    good, toxic = defaultdict(int), defaultdict(int)
    for d, q, t in marks:
        good[d], toxic[d] = max(good[d], int(q == 1)), max(toxic[d], int(t == 1))
    judged = []
    for d, text, _, source in rows:
        text = text or ""
        words = WORD.findall(text)
        failed = "A" * (len(words) < 50) + "B" * (100 * len(set(words)) < 65 * len(words))
        failed += "C" * (100 * len(re.findall("[A-Z]", text)) > 5 * len(text)) + "D" * bool(re.search(r"[#$%&*|]", text))
        failed += "E" * any(o[0] is not None and d is not None and o[0] < d and (o[1] or "") == text for o in rows)
        judged.append((source or "", failed, good[d] if d is not None else 0, toxic[d] if d is not None else 0))
    out, worth = {}, Counter()
    for part in {j[0] for j in judged}:
        for order in permutations("ABCDE"):
            left = [j[1:] for j in judged if j[0] == part]
            every = list(left)
            for step, f in enumerate(order, 1):
                here = [j for j in left if f in j[0]]
                left = [j for j in left if f not in j[0]]
                out[part, "".join(order), step] = [len(left), len(here), sum(f in j[0] for j in every) - len(here), sum(j[0] == f for j in every), sum(j[1] for j in here), sum(j[2] for j in here)]
                worth[part, f] += len(here)
    return {(part, order, step): (*v, worth[part, order[step - 1]]) for (part, order, step), v in out.items()}


def audited(docs, labels):
    return {(r.part, r.filter_order, r.step): tuple(r[c] for c in removal_ranks.COUNTS) for r in removal_ranks.audit(docs, labels).collect()}


def test_min_plus_product_and_ranks():
    left = np.array([[0.0, np.inf], [1.0, 2.0]])
    assert removal_ranks.min_plus(left, np.array([[3.0, 1.0], [0.0, 5.0]])).tolist() == [[3.0, 1.0], [2.0, 2.0]]
    ranks = removal_ranks.ranks("AB")
    assert ranks.names == ["AB", "BA"] and ranks.removal.tolist() == [[2, 2], [0, 1], [1, 0], [0, 0]]


def test_removal_ranks_against_python(spark):
    rng = random.Random(5)
    long = [" ".join(f"w{rng.randrange(40 if i % 2 else 400)}" for _ in range(60)) for i in range(12)]
    texts = [None, "", "short", "SHOUT AND SHOUT", "a # b", long[0] + " $", *long, "é" * 70_000 + " Z"]
    rows = [(rng.choice([None, *range(60)]), rng.choice(texts), "en", rng.choice([None, "", "s1", "s1", "s2"])) for _ in range(150)]
    rows += [rows[3], rows[3], (7, "same", "en", "s1"), (7, "same", "en", "s2"), (7, "same", "en", "s1"), (9, "same", "en", "s1")]
    marks = [(d, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for d in range(0, 60, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    assert audited(table(spark, rows), labels) == plain_audit(rows, marks)


def test_removal_ranks_of_empty_tables(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert not audited(table(spark, []), labels)
    one = audited(table(spark, [(1, None, None, None)]), labels)
    assert len(one) == 600 and one["", "ABCDE", 1] == (0, 1, 0, 1, 0, 0, 120) and one["", "BACDE", 1][:2] == (1, 0)


# ---- op12 -------------------------------------------------------------------------------------------------------------

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            doubled = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(digits[::-1]))
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else 0, "card": 12 <= len(digits) <= 19 and doubled % 10 == 0, "phone": 9 <= len(digits) <= 15}
            if ok[kind]:
                out.append((m.start(), list(PATTERNS).index(kind), kind, m.end()))
    return [(kind, start, end) for start, _, kind, end in sorted(out)]


def test_base_spans_equal_the_patterns():
    rng = random.Random(3)
    alphabet = ["@", ".", "-", " ", "a", "b.c", "x@y.z", "1", "23", "255", "256", "+", "+1 ", "(0", ")", "4111 1111 1111 1111", "\n", "é", "0001", "%", "_", "4", "9"]
    for _ in range(4000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 30)))
        assert [s[:3] for s in deobfuscation.spans_of(text) if s[4]] == plain_spans(text), text


@pytest.mark.parametrize(
    ("text", "kind", "surface", "value"),
    [
        ("write john (at) example (dot) com now", "email", "john (at) example (dot) com", "john@example.com"),
        ("j dot smith at example dot org", "email", "j dot smith at example dot org", "j.smith@example.org"),
        ("john [at] mail.example.com!", "email", "john [at] mail.example.com", "john@mail.example.com"),
        ("née jоhn@example.com", "email", "jоhn@example.com", "john@example.com"),
        ("jo​hn@exa​mple.com", "email", "jo​hn@exa​mple.com", "john@example.com"),
        ("bob＠example．com", "email", "bob＠example．com", "bob@example.com"),
        ("a&#64;b.com, a", "email", "a&#64;b.com", "a@b.com"),
        ("x 4111–1111–1111–1111", "card", "4111–1111–1111–1111", "4111-1111-1111-1111"),
        ("41l1 1111 1111 1111", "card", "41l1 1111 1111 1111", "4111 1111 1111 1111"),
        ("call plus four nine one seven one two three four five", "phone", "plus four nine one seven one two three four five", "+491712345"),
        ("+٤٤ 20 7946 0958", "phone", "+٤٤ 20 7946 0958", "+44 20 7946 0958"),
        ("on 192 dot 168 dot 0 dot 1", "ip", "192 dot 168 dot 0 dot 1", "192.168.0.1"),
        ("on 192[.]168[.]0[.]1", "ip", "192[.]168[.]0[.]1", "192.168.0.1"),
    ],
)
def test_disguises_are_undone_and_mapped_back(text, kind, surface, value):
    found = [(k, text[a:b], v) for k, a, b, v, base in deobfuscation.spans_of(text) if not base]
    assert (kind, surface, value) in found


@pytest.mark.parametrize("text", ["look at example.com for more", "we met at one point two of them", "at five point six", "one two three", "un deux trois, chez nous point final", "(at) dot"])
def test_prose_is_left_alone(text):
    assert not deobfuscation.spans_of(text)


def test_tapes_lead_back_through_every_rewrite():
    rng = random.Random(11)
    for _ in range(300):
        source = "".join(rng.choice("abcdef") for _ in range(40))
        edits, at = [], 0
        while at < 36:
            start = at + rng.randrange(1, 4)
            at = start + rng.randrange(1, 3)
            edits.append((start, at, rng.choice(["", "X", "YZ"])))
        tape = deobfuscation.Tape(source, edits)
        origin = []
        for i, c in enumerate(source):
            for start, end, put in edits:
                if i == start:
                    origin += [(start, end)] * len(put)
            if not any(s <= i < e for s, e, _ in edits):
                origin.append((i, i + 1))
                assert tape.text[len(origin) - 1] == c
        assert len(origin) == len(tape.text)
        for a in range(len(origin)):
            for b in range(a + 1, len(origin) + 1):
                assert tape.back((a, b)) == (origin[a][0], origin[b - 1][1])


def test_long_texts_take_linear_time():
    for unit in ["a", "1", "a.", "a@", "a dot ", "one ", "４", "(at) a dot ", "1l", "+1("]:
        deobfuscation.spans_of(unit * 100_000)


def test_deobfuscation_query(spark):
    texts = [None, "", "a@b.cd and 1.2.3.4", "a@b.cd and 1.2.3.4", "é jоhn@example.com", "x" * 70_000 + " +1 (017) 555-7713"]
    rows = [(i, t, None, None) for i, t in enumerate(texts)] + [(None, "z@z.zz", "en", "s"), (3, texts[3], "en", "s")]
    found = deobfuscation.found(table(spark, rows))
    out = deobfuscation.digests(found).collect()
    assert sorted(r.doc_id for r in out) == [0, 1, 2, 3, 3, 4, 5]
    for r in out:
        base = plain_spans(texts[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in base) for k in PATTERNS]
    assert {r.doc_id: r.spans for r in out}[4] == "email:2:18,email:4:18" and {r.doc_id: r.n_disguised for r in out}[4] == 1
    text = {r.doc_id: r.text for r in deobfuscation.masked(found).collect()}
    assert text[2] == "<email> and <ip>" and text[4] == "é <email>" and text[5].endswith("x <phone>") and text[0] == ""
    assert deobfuscation.digests(deobfuscation.found(table(spark, []))).count() == 0


# ---- op13 -------------------------------------------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain_divergence(rows, min_docs=3, top=200):
    low = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        terms = TERM.findall((text or "").translate(low))
        groups.add((lang or "", source or ""))
        counts[lang or "", source or ""].update(terms)
        docs[lang or ""].update(set(terms))
    out = set()
    for lang in {g[0] for g in groups}:
        keep = [t for t, n in docs[lang].items() if n >= min_docs]
        of = {s: Counter({t: counts[lang, s][t] for t in keep}) for x, s in groups if x == lang}
        of[None] = Counter({t: sum(c[t] for c in list(of.values())) for t in keep})
        share = {s: {t: 1 + 1_000_000_000 * (c[t] + 1) // (sum(c.values()) + len(keep)) for t in keep} for s, c in of.items()}
        value = {(a, b): {t: (p[t] - q[t]) ** 2 // q[t] for t in keep} for a, p in share.items() for b, q in share.items()}
        for s in of.keys() - {None}:
            pairs = sorted(((-sum(value[s, o].values()), o.encode(), o) for o in of.keys() - {None, s}))
            raised = sorted((-v, t.encode(), t) for t, v in value[s, None].items() if of[s][t] and share[s][t] > share[None][t])
            for part, found in (("pair", pairs), ("term", raised[:top])):
                out |= {(lang, s, part, item, -v, i) for i, (v, _, item) in enumerate(found, 1)}
    return out


@pytest.mark.parametrize("block_bytes", [2_000, divergence.BLOCK_BYTES])
def test_divergence_against_python(spark, block_bytes, monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK_BYTES", block_bytes)
    rng = random.Random(9)
    vocabulary = [f"{'aé'[i % 2]}{'xyzuv'[i % 5] * (i % 7 + 1)}{chr(97 + i % 26)}" for i in range(400)] + ["Ünï", "b" * 70_000]
    rows = []
    for i in range(250):
        lang, source = rng.choice(["en", "en", "fr", None]), rng.choice(["s0"] * 6 + ["s1", "s2", "", None, "ß"])
        words = [vocabulary[min(int(rng.expovariate(0.02)), 401)] for _ in range(rng.randrange(0, 60))]
        rows.append((rng.choice([None, i]), rng.choice([" ".join(words), "THE the-The 1 " + " ".join(words), None]), lang, source))
    rows += [rows[2]] * 3 + [(1, "only words once", "xx", "s0"), (2, None, "xx", "s1"), (3, "", "yy", "s1")]
    found = divergence.pair_values  # noqa: F841 - the audit below runs it
    freq = divergence.frequencies(table(spark, rows), 3, block_bytes)
    assert freq.groupBy("lang", "term", "source").count().filter("count > 1").count() == 0
    got = {tuple(r) for r in divergence.audit(table(spark, rows), 3, 40).collect()}
    want = plain_divergence(rows, 3, 40)
    assert got == want
    assert ("xx", "s0", "pair", "s1", 0, 1) in got


def test_frequencies_of_terms_across_batches(spark):
    """One term in more sources than a batch holds rows stays whole."""
    rows = [(i, f"word w{i % 7}", "en", f"s{i % 900}") for i in range(2_000)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        got = {tuple(r) for r in divergence.audit(table(spark, rows[:400]), 3, 5).collect()}
        freq = {(r.term, r.source): (r.n, r.lang_n) for r in divergence.frequencies(table(spark, rows)).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)
    assert got == plain_divergence(rows[:400], 3, 5)
    assert len([k for k in freq if k[0] == "word"]) == 900 and freq["word", "s0"] == (3, 2_000)


def test_sources_over_several_blocks_of_the_pair_join(spark, monkeypatch):
    monkeypatch.setattr(divergence, "_OTHERS", 4)
    monkeypatch.setattr(divergence, "_STEP", 50)
    rows = [(i, f"w{i % 5} w{i % 3} v{i % 11} the", ("en", "fr")[i % 2], f"s{i % 17}") for i in range(300)]
    assert {tuple(r) for r in divergence.audit(table(spark, rows)).collect()} == plain_divergence(rows)


def test_divergence_of_an_empty_table(spark):
    assert divergence.audit(table(spark, [])).count() == 0


def test_shares_are_exact_beyond_longs(spark):
    big = 12_345_678_901
    row = spark.range(1).select(divergence._share(F.lit(big), F.lit(3 * big), F.lit(1_000_003)).alias("p")).first()
    assert row.p == 1 + 1_000_000_000 * (big + 1) // (3 * big + 1_000_003)


def test_gap_of_arrays():
    assert divergence.gap(np.array([5, 1]), np.array([2, 4])).tolist() == [4, 2]
    assert pa.array([1]).type == pa.int64()
