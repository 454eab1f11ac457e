"""Personal data in texts, disguised or not, with offsets into the source.

A disguised identifier is undone by a chain of transducers. Each one rewrites stretches of its input and keeps where
every output character came from: look-alike characters become ASCII (and invisible ones nothing), character references become their
characters, digits spelled as words become digits, and words for "at" and "dot" become signs. The detectors that find
plain identifiers then run on the normalised text, and a span found there is mapped back through the chain.

Spans found in the text as it stands are the base and always stay; a mapped span is added unless a base span of its
kind covers it. Rewrites are careful, since ordinary prose holds "at", "one" and "point": a spelled digit counts beside
another digit only, an unbracketed "at" only where a whole domain follows whose every dot is disguised and whose last label is a known one.

Defined results: a null text is empty and has no spans, rows without an id go, repeated rows give a row each, texts of
any length are searched whole in time that grows with their length; spans that start together are sorted by kind. An empty
table gives no row; other columns are not read. Offsets count code points, ends are exclusive.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.blocks import release, texts_of

KINDS = ["email", "ip", "card", "phone"]
Span = tuple[int, int]
Edit = tuple[int, int, str]

# ---- detectors: leftmost matches that don't overlap; a failing match is dropped and not retried -------------------

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# A run of digits that starts no address can't hold one further on, so it is passed over whole: no quadratic search.
_IP = re.compile(r"([0-9]++(?:\.[0-9]++){3})|[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def emails(text: str) -> Iterator[Span]:
    """Every sign is met once: the address reaches left over local characters, but not into the address before."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL.match(text, start - 1):
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        done = domain.end() if domain else at + 1
        if domain:
            yield start, done
        at = text.find("@", done)


def ips(text: str) -> Iterator[Span]:
    for m in _IP.finditer(text):
        if m.group(1) and all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in m.group(1).split(".")):
            yield m.span()


def luhn(digits: str) -> bool:
    """Check digit of card numbers: from the right, every second digit counts double, less 9 from 10 on."""
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def cards(text: str) -> Iterator[Span]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() < 40:
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def phones(text: str) -> Iterator[Span]:
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                yield m.span()


DETECTORS: dict[str, Callable[[str], Iterator[Span]]] = {"email": emails, "ip": ips, "card": cards, "phone": phones}

# ---- transducers ------------------------------------------------------------------------------------------------------

# Letters of other scripts that look like a Latin one, as pairs of look-alike and Latin letter.
LOOKALIKES = (
    "Аa Вb Еe Кk Мm Нh Оo Рp Сc Тt Хx Іi Јj Ѕs аa еe оo рp сc уy хx іi јj ѕs ԁd ԛq ԝw һh ӏl "
    "Αa Βb Εe Ζz Ηh Ιi Κk Μm Νn Οo Ρp Τt Υy Χx αa οo ρp νv ιi κk υu ɑa ɡg ɩi ʏy ᴏo ᴄc ᴇe ı1i"
)
# The ten digits as words, per language.
DIGIT_WORDS = {
    "en": "zero one two three four five six seven eight nine",
    "de": "null eins zwei drei vier fünf sechs sieben acht neun",
    "fr": "zéro un deux trois quatre cinq six sept huit neuf",
    "es": "cero uno dos tres cuatro cinco seis siete ocho nueve",
}
# Words for the signs of an address.
AT_WORDS = "at arobase arroba ät chez"
DOT_WORDS = "dot punkt point punto"
PLUS_WORDS = "plus más"
# Last labels that an address written without brackets must end in, so that prose isn't taken for one.
LAST_LABELS = "com org net edu gov info biz io dev app co de fr es uk eu us ch at it nl be pl pt mx ar ca jp cn in br"


@lru_cache(maxsize=1 << 16)
def plain(char: str) -> str:
    """ASCII that a character stands for; itself if there is none, nothing for invisible ones.

    Compatibility forms (full width, superscript, enclosed, mathematical letters) follow their decomposition, digits
    of any script their value, dashes and spaces their category.
    """
    code = ord(char)
    if code < 128:
        return char
    if char in _LATIN:
        return _LATIN[char]
    kind = unicodedata.category(char)
    if kind == "Cf" or code == 0x034F:
        return ""
    if kind == "Nd":
        return str(unicodedata.digit(char))
    if kind == "Zs":
        return " "
    if kind == "Pd" or code == 0x2212:
        return "-"
    folded = unicodedata.normalize("NFKC", char)
    if folded != char and folded.isascii() and len(folded) <= 3:
        return folded.strip("()") if kind in ("No", "So") else folded
    return char


_LATIN = {pair[0]: pair[-1] for pair in LOOKALIKES.split()} | {"․": ".", "。": ".", "。": "."}
_FOREIGN = re.compile(r"[^\x00-\xff]+|[\xa0\xad\xb2\xb3\xb9]+")
_REFERENCE = re.compile(r"&#0*(\d{2,6});|&#[xX]0*([0-9a-fA-F]{2,5});|&(commat|period|plus|nbsp|hyphen);|%(40|2[eEbB])")
_REFERENCE_NAMES = {"commat": "@", "period": ".", "plus": "+", "nbsp": " ", "hyphen": "-"}
_DIGIT_OF = {word: str(i) for words in DIGIT_WORDS.values() for i, word in enumerate(words.split())}


def _either(words: Iterable[str]) -> str:
    return "|".join(sorted(words, key=len, reverse=True))


_SPELLED = rf"(?:{_either(_DIGIT_OF)})"
_SPELLED_RUN = re.compile(
    rf"(?<!\w)(?:(?P<plus>{_either(PLUS_WORDS.split())})[ ]|\+[ ]?)?(?P<run>(?:{_SPELLED}(?!\w)|[0-9]++)(?:[ -](?:{_SPELLED}(?!\w)|[0-9]++))+)", re.IGNORECASE
)
_SPELLED_WORD = re.compile(rf"{_SPELLED}(?!\w)", re.IGNORECASE)
_LETTER_DIGIT = re.compile(r"(?<=[0-9])[OoIl]{1,3}(?=[ -]?[0-9])")
_HAS_SPELLED = re.compile(rf"(?<!\w){_SPELLED}[ -](?:[0-9]|{_SPELLED}(?!\w))|[0-9][ -]{_SPELLED}(?!\w)|(?<!\w)(?:{_either(PLUS_WORDS.split())}) [0-9]", re.IGNORECASE)

_OPEN, _SHUT = r"[ ]?[(\[{<][ ]?", r"[ ]?[)\]}>][ ]?"
_AT, _DOT = _either(AT_WORDS.split()), _either(DOT_WORDS.split())
_NAME, _LABEL = r"[A-Za-z0-9_%+-]{1,64}", r"[A-Za-z0-9-]{1,63}"
_MARKED_AT, _MARKED_DOT = rf"{_OPEN}(?:{_AT}|@){_SHUT}", rf"{_OPEN}(?:{_DOT}|\.){_SHUT}"
_PLAIN_DOT = rf"[ ](?:{_DOT})[ ]"
_SIGN = re.compile(
    rf"(?:(?P<at>{_MARKED_AT}|[ ]@[ ]?|@[ ])|(?P<bare>[ _-](?:{_AT})[ _-]))(?P<domain>{_LABEL}(?:(?:{_MARKED_DOT}|{_PLAIN_DOT}|\.){_LABEL})+)|@(?P<after>{_LABEL}(?:(?:{_MARKED_DOT}|{_PLAIN_DOT}){_LABEL})+)",
    re.IGNORECASE,
)
_LAST = frozenset(LAST_LABELS.split())
_DOTS = re.compile(rf"{_MARKED_DOT}|{_PLAIN_DOT}", re.IGNORECASE)
_MARKED_BEFORE = re.compile(rf"(?:{_NAME})(?:{_MARKED_DOT}|{_PLAIN_DOT}|\.)$", re.IGNORECASE)
_HAS_SIGN = re.compile(rf"[(\[{{<][ ]?(?:{_AT}|@)[ ]?[)\]}}>]|@|[ _-](?:{_AT})[ _-]{_LABEL}(?:{_PLAIN_DOT}|{_MARKED_DOT})", re.IGNORECASE)
_IP_DOTS = re.compile(rf"(?<![0-9.])[0-9]{{1,3}}(?:(?:{_MARKED_DOT}|{_PLAIN_DOT}|\.)[0-9]{{1,3}}){{3}}(?![0-9])", re.IGNORECASE)
_HAS_IP_DOT = re.compile(rf"[0-9](?:{_OPEN}(?:{_DOT}|\.){_SHUT}|{_PLAIN_DOT})[0-9]", re.IGNORECASE)


class Tape:
    """A text after rewriting: its characters, and where each stretch of them came from in the text before."""

    def __init__(self, source: str, edits: list[Edit]):
        self.pieces: list[tuple[int, int, int, bool]] = []  # (output start, source start, source end, rewritten)
        out, parts, at = 0, [], 0
        for start, end, put in edits:
            if at < start:
                self.pieces.append((out, at, start, False))
                parts.append(source[at:start])
                out += start - at
            if put:
                self.pieces.append((out, start, end, True))
            parts.append(put)
            out += len(put)
            at = end
        self.pieces.append((out, at, len(source), False))
        parts.append(source[at:])
        self.text = "".join(parts)
        self.starts = [p[0] for p in self.pieces]

    def back(self, span: Span) -> Span:
        """The source characters that a span's characters came from."""
        out, start, _, rewritten = self.pieces[bisect_right(self.starts, span[0]) - 1]
        first = start if rewritten else start + span[0] - out
        out, start, end, rewritten = self.pieces[bisect_right(self.starts, span[1] - 1) - 1]
        return first, end if rewritten else start + span[1] - out


def lookalikes(text: str) -> Iterator[Edit]:
    if text.isascii():
        return
    for m in _FOREIGN.finditer(text):
        for i, char in enumerate(m.group(), m.start()):
            if (put := plain(char)) != char:
                yield i, i + 1, put


def references(text: str) -> Iterator[Edit]:
    if "&" in text or "%" in text:
        for m in _REFERENCE.finditer(text):
            decimal, hexa, name, escaped = m.groups()
            if name:
                put = _REFERENCE_NAMES[name]
            else:
                code = int(decimal) if decimal else int(hexa or escaped, 16)
                put = chr(code) if 32 <= code < 127 else ""
            if put:
                yield m.start(), m.end(), put


def spelled_digits(text: str) -> Iterator[Edit]:
    """Digits as words beside other digits, a word for plus before digits, letters that stand for a digit between digits."""
    edits = [(m.start(), m.end(), m.group().translate(_AS_DIGIT)) for m in _LETTER_DIGIT.finditer(text)] if _LETTER_DIGIT.search(text) else []
    if _HAS_SPELLED.search(text):
        for m in _SPELLED_RUN.finditer(text):
            plus = m.start("plus")
            words = list(_SPELLED_WORD.finditer(text, m.start("run"), m.end("run")))
            if plus >= 0:
                edits.append((plus, m.end("plus") + 1, "+"))
            elif words and text[m.start()] == "+" and text[m.start() + 1] == " ":
                edits.append((m.start(), m.start() + 2, "+"))
            for i, w in enumerate(words):
                joined = i + 1 < len(words) and words[i + 1].start() == w.end() + 1
                edits.append((w.start(), w.end() + joined, _DIGIT_OF[w.group().lower()]))
        edits.sort()
    yield from edits


_AS_DIGIT = str.maketrans("OoIl", "0011")


def signs(text: str) -> Iterator[Edit]:
    """Words and brackets for "at" and "dot" of an address, and for the dots of an IP address."""
    edits: list[Edit] = []
    if _HAS_SIGN.search(text):
        for m in _SIGN.finditer(text):
            domain = "after" if m.group("after") else "domain"
            if m.group("bare") and ("." in _DOTS.sub("", m.group("domain")) or _DOTS.split(m.group("domain"))[-1].lower() not in _LAST):
                continue  # "look at example.com" and "met at one point two" are prose
            if domain == "domain":
                edits.append((m.start(), m.start(domain), "@"))
            edits += [(d.start(), d.end(), ".") for d in _DOTS.finditer(text, m.start(domain), m.end(domain))]
            left = m.start()
            while before := _MARKED_BEFORE.search(text, max(0, left - 160), _name_start(text, left)):
                dot = list(_DOTS.finditer(text, before.start(), before.end()))
                left = before.end() - (dot[-1].end() - dot[-1].start() if dot and dot[-1].end() == before.end() else 1)
                if left + 1 < before.end():
                    edits.append((left, before.end(), "."))
    if _HAS_IP_DOT.search(text):
        for m in _IP_DOTS.finditer(text):
            edits += [(d.start(), d.end(), ".") for d in _DOTS.finditer(text, m.start(), m.end())]
    at = 0
    for edit in sorted(edits):
        if edit[0] >= at:
            yield edit
            at = edit[1]


def _name_start(text: str, end: int) -> int:
    """First character of the name that ends here."""
    at = end
    while at > max(0, end - 64) and (text[at - 1].isascii() and text[at - 1].isalnum() or text[at - 1] in "_%+-"):
        at -= 1
    return at


CHAIN: list[Callable[[str], Iterator[Edit]]] = [lookalikes, references, spelled_digits, signs]


def normalised(text: str) -> tuple[str, list[Tape]]:
    """The text with its disguises undone, and the tapes that lead back."""
    tapes: list[Tape] = []
    for transducer in CHAIN:
        if edits := list(transducer(text)):
            tapes.append(Tape(text, edits))
            text = tapes[-1].text
    return text, tapes


def spans_of(text: str) -> list[tuple[str, int, int, str, bool]]:
    """``(kind, start, end, value, base)`` of every identifier, by start and kind; ``value`` is its undisguised form."""
    found = [(kind, start, end, text[start:end], True) for kind, find in DETECTORS.items() for start, end in find(text)]
    clear, tapes = normalised(text)
    if tapes:
        reach: dict[str, tuple[list[int], list[int]]] = {k: ([], []) for k in KINDS}
        for kind, start, end, *_ in found:
            reach[kind][0].append(start)
            reach[kind][1].append(end)
        for kind, find in DETECTORS.items():
            starts, ends = reach[kind]
            for span in find(clear):
                value = clear[span[0] : span[1]]
                for tape in reversed(tapes):
                    span = tape.back(span)
                near = bisect_right(starts, span[0]) - 1
                if near < 0 or ends[near] < span[1]:
                    found.append((kind, *span, value, False))
        found.sort(key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
    else:
        found.sort(key=lambda s: (s[1], KINDS.index(s[0])))
    return found


# ---- tables -----------------------------------------------------------------------------------------------------------

_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string()), ("base", pa.bool_())])
_SPAN_SQL = "array<struct<kind: string, start: bigint, end: bigint, value: string, base: boolean>>"


def found(docs: DataFrame) -> DataFrame:
    """``doc_id, text, spans``: every text with its identifiers."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[dict(zip(("kind", "start", "end", "value", "base"), s, strict=True)) for s in spans_of(text.as_py())] for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.list_(_SPAN))], ["doc_id", "text", "spans"])
        release()

    return texts_of(docs).mapInArrow(search, f"doc_id long, text string, spans {_SPAN_SQL}")


def masked(spans: DataFrame) -> DataFrame:
    """``doc_id, text`` with ``<kind>`` in place of every identifier; of spans that overlap the first stands for both."""

    def step(state: Column, span: Column) -> Column:
        new = span["start"] >= state["at"]
        between = F.substr("text", (state["at"] + 1).cast("int"), (span["start"] - state["at"]).cast("int"))
        put = F.concat(state["out"], between, F.lit("<"), span["kind"], F.lit(">"))
        return F.struct(F.when(new, put).otherwise(state["out"]).alias("out"), F.greatest(state["at"], span["end"]).alias("at"))

    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    text = F.aggregate("spans", start, step, lambda s: F.concat(s["out"], F.substr("text", (s["at"] + 1).cast("int"))))
    return spans.select("doc_id", text.alias("text"))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(spans: DataFrame) -> DataFrame:
    """Counts of base spans per kind, the digest of the base list, and the list of all spans."""
    base = F.filter("spans", lambda s: s["base"])
    kinds = F.transform(base, lambda s: s["kind"])
    per_kind = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    added = F.size(F.filter("spans", lambda s: ~s["base"])).cast("long").alias("n_disguised")
    return spans.select("doc_id", *per_kind, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"), added)
