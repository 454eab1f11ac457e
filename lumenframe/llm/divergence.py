"""Source divergence audit: how far each source's words lie from every other source's of its language.

Indexing is single-pass: a task counts terms of its texts in memory, per language and source, until its block is full,
and then puts the block out as a run sorted by term. Runs are shuffled by the hash of language and term; inside each
shard Spark's external sorter merges them through its heap, and one pass over the merged stream folds equal neighbours
into frequencies and drops rare terms. No task holds a vocabulary.

Divergences of pairs come from what differs from "no occurrence in either source". A pair's sum is written as the
value of a term that neither has, times the vocabulary; plus a correction for each term that one of them has, which
depends on its count only and is taken from each source's counts of counts; plus a correction for each term that both have,
which is streamed from the frequencies: a task adds up matrices of sources batch by batch, so pairs are never rows per term.

Defined results: null text, language and source are the empty string; a row is a document whether or not it has an id, and
repeated rows count each; texts of any length are whole; ties of a rank go to the smaller item by UTF-8 bytes. An empty
table gives no row, a language without kept terms has pairs of value 0 and no terms. Other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.llm.blocks import release, spread
from lumenframe.llm.scratch import kept

SCALE = 1_000_000_000
MIN_DOCS = 3
TOP_TERMS = 200
#: Bytes of a block before it is put out as a run, by the estimate of ``_ENTRY`` bytes a counted term.
BLOCK_BYTES = 96 << 20
_ENTRY = 300
#: Pairs of one numpy step, and sources that one key of the pair join holds.
_STEP = 1 << 20
_OTHERS = 512

#: Bytes that separate terms become spaces, A to Z become lower case.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_RUN = pa.schema([("lang", pa.string()), ("term", pa.string()), ("source", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def runs(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``lang, term, source, n, docs``: occurrences and documents per block, each block sorted by language, term and source."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        held = 0
        for batch in batches:
            for lang, source, text in zip(*(batch.column(i) for i in range(3)), strict=True):
                terms = text.as_buffer().to_pybytes().translate(_TERMS).split()
                counts = block.get(key := (lang.as_py(), source.as_py()))
                if counts is None:
                    counts = block[key] = (Counter(), Counter())
                before, kinds = len(counts[0]), set(terms)
                counts[0].update(terms)
                counts[1].update(kinds)
                if new := len(counts[0]) - before:
                    held += _ENTRY * new + (sum(map(len, kinds)) if len(terms) < 1000 * new else 0)
                if held > block_bytes:
                    yield from _sorted_run(block)
                    held = 0
        yield from _sorted_run(block)
        release()

    columns = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    return docs.select(*columns).mapInArrow(index, "lang string, term string, source string, n long, docs long")


def _sorted_run(block: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
    """Empties a block and puts it out sorted."""
    pieces = []
    for lang, source in list(block):
        n, docs = block.pop((lang, source))
        size = len(n)
        terms = pa.array(n.keys(), pa.binary(), size=size).cast(pa.string())
        named = [pa.array([v]).take(pa.array(np.zeros(size, np.int64))) for v in (lang, source)]
        pieces.append(pa.table([named[0], terms, named[1], pa.array(n.values(), pa.int64(), size=size), pa.array(map(docs.__getitem__, n), pa.int64(), size=size)], schema=_RUN))
    if pieces:
        run = pa.concat_tables(pieces)
        yield from run.sort_by([("lang", "ascending"), ("term", "ascending"), ("source", "ascending")]).to_batches(max_chunksize=20_000)


def frequencies(docs: DataFrame, min_docs: int = MIN_DOCS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``lang, term, source, n, lang_n, first``: occurrences of every term that enough documents of its language hold.

    ``lang_n`` is the term's count in the language, ``first`` marks one row of each term.
    """

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch.cast(_RUN)])
            table = pa.concat_tables([rest, table]).combine_chunks() if rest is not None else table
            new = _starts(table, ["lang", "term"])
            if len(new) == 1:  # the last term may go on in the next batch: fold what is equal already
                rest = _folded(table)
                continue
            rest = table.slice(new[-1])
            yield from _frequent(_folded(table.slice(0, new[-1])), min_docs)
        if rest is not None and len(rest):
            yield from _frequent(_folded(rest), min_docs)
        release()

    spread_runs = runs(docs, block_bytes).repartition("lang", "term").sortWithinPartitions("lang", "term", "source")
    return spread_runs.mapInArrow(merge, "lang string, term string, source string, n long, lang_n long, first boolean")


def _starts(table: pa.Table, columns: list[str]) -> np.ndarray:
    """Rows of a sorted table at which one of the columns changes, the first one included."""
    new = np.ones(len(table), bool)
    for i, c in enumerate(columns):
        values = table.column(c).combine_chunks()
        changed = pc.not_equal(values.slice(1), values.slice(0, len(values) - 1)).to_numpy(zero_copy_only=False)
        new[1:] = changed if i == 0 else new[1:] | changed
    return np.flatnonzero(new)


def _folded(table: pa.Table) -> pa.Table:
    """Equal neighbours as one row."""
    at = _starts(table, ["lang", "term", "source"])
    sums = {c: pa.array(np.add.reduceat(table.column(c).to_numpy(), at)) for c in ("n", "docs")}
    picked = table.select(["lang", "term", "source"]).take(pa.array(at))
    return picked.append_column("n", sums["n"]).append_column("docs", sums["docs"])


def _frequent(table: pa.Table, min_docs: int) -> Iterator[pa.RecordBatch]:
    at = _starts(table, ["lang", "term"])
    lengths = np.diff(np.r_[at, len(table)])
    keep = np.repeat(np.add.reduceat(table.column("docs").to_numpy(), at) >= min_docs, lengths)
    first = np.zeros(len(table), bool)
    first[at] = True
    lang_n = np.repeat(np.add.reduceat(table.column("n").to_numpy(), at), lengths)
    out = table.drop_columns(["docs"]).append_column("lang_n", pa.array(lang_n)).append_column("first", pa.array(first))
    yield from out.filter(pa.array(keep)).combine_chunks().to_batches(max_chunksize=20_000)


def _share(n: Column, total: Column, kinds: Column) -> Column:
    """``1 + floor(SCALE * (n + 1) / (total + kinds))``, exact at any count."""
    return F.lit(1) + F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (n + 1).cast("decimal(20,0)"), (total + kinds).cast("decimal(20,0)"))


def _gap(p: Column, q: Column) -> Column:
    """``floor((p - q)^2 / q)``."""
    return F.call_function("div", (p - q) * (p - q), q)


def shares(docs: DataFrame, freq: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every occurring group with its total ``(lang, source, total, kinds, lang_total, none)``, and frequencies with ``p`` and ``q``.

    ``none`` is the share of a kept term that the group doesn't have (null where the language keeps no term).
    """
    named = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    totals = freq.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = freq.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.sum(F.col("first").cast("long")).alias("kinds"))
    groups = named.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["total", "kinds", "lang_total"])
    groups = kept(groups.withColumn("none", F.when(F.col("kinds") > 0, _share(F.lit(0), F.col("total"), F.col("kinds")))), "groups")
    scaled = freq.join(groups, ["lang", "source"])
    return groups, scaled.withColumns({"p": _share(F.col("n"), F.col("total"), F.col("kinds")), "q": _share(F.col("lang_n"), F.col("lang_total"), F.col("kinds"))})


def pair_values(groups: DataFrame, scaled: DataFrame) -> DataFrame:
    """``lang, source, item, value`` for every ordered pair of sources of a language."""
    counted = scaled.groupBy("lang", "source", "p").agg(F.count("*").alias("k"))
    absent = groups.join(counted.groupBy("lang", "source").agg(F.sum("k").alias("had")), ["lang", "source"], "left")
    absent = absent.select("lang", "source", F.coalesce("none", F.lit(1)).alias("p"), (F.col("kinds") - F.coalesce("had", F.lit(0))).alias("k"))
    blocks = max(1, -(-groups.count() // _OTHERS))
    block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    ours = counted.unionByName(absent).join(groups.select("lang", "source", F.coalesce("none", F.lit(1)).alias("none")), ["lang", "source"]).select("*", block)
    theirs = groups.select("lang", F.col("source").alias("item"), F.coalesce("none", F.lit(1)).alias("other"), F.pmod(F.xxhash64("source"), F.lit(blocks)).cast("int").alias("block"))
    met = ours.join(theirs, ["lang", "block"]).filter("source <> item")
    gone = _gap(F.col("other"), F.col("none"))
    both_ways = F.array(
        F.struct(F.col("source"), F.col("item"), (F.col("k") * _gap(F.col("p"), F.col("other"))).alias("value")),
        F.struct(F.col("item").alias("source"), F.col("source").alias("item"), (F.col("k") * (_gap(F.col("other"), F.col("p")) - gone)).alias("value")),
    )
    single = met.select("lang", F.explode(both_ways).alias("w")).select("lang", "w.*")
    shared = scaled.select("lang", "term", "source", "p", "none").repartition("lang", "term").sortWithinPartitions("lang", "term")
    double = shared.mapInArrow(_corrections, "lang string, source string, item string, value long")
    return single.unionByName(double).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def _corrections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums over the terms of sorted batches of what two sources that share a term add beyond each one's own correction."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([rest, table]).combine_chunks() if rest is not None else table
        new = _starts(table, ["lang", "term"])
        rest = table.slice(new[-1])
        if new[-1]:
            yield from _pair_sums(table.slice(0, new[-1]), new)
    if rest is not None and len(rest):
        yield from _pair_sums(rest, np.r_[0, len(rest)])
    release()


def _pair_sums(table: pa.Table, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Sums per ordered pair of sources over terms whose rows lie between the bounds."""
    langs, sources = (pc.dictionary_encode(table.column(c).combine_chunks()) for c in ("lang", "source"))
    n_sources = len(sources.dictionary)
    group = langs.indices.to_numpy().astype(np.int64) * n_sources + sources.indices.to_numpy()
    p, none = table.column("p").to_numpy(), table.column("none").to_numpy()
    lengths = np.diff(bounds)
    first, partners = np.repeat(bounds[:-1], lengths), np.repeat(lengths, lengths)
    ends = np.cumsum(partners)
    at = 0
    while at < len(p):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _STEP, "right")))
        run, place = spread(partners[at:to])
        i, j = run + at, first[at:to][run] + place
        i, j = i[i != j], j[i != j]
        value = gap(p[i], p[j]) - gap(p[i], none[j]) - gap(none[i], p[j]) + gap(none[i], none[j])
        key = group[i] * n_sources + group[j] % n_sources
        order = np.argsort(key, kind="stable")
        if len(key):
            cut = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]])
            lang, pair = np.divmod(key[order][cut], n_sources * n_sources)
            named = [langs.dictionary.take(pa.array(lang)), *(sources.dictionary.take(pa.array(x)) for x in np.divmod(pair, n_sources))]
            yield pa.RecordBatch.from_arrays([*named, pa.array(np.add.reduceat(value[order], cut))], ["lang", "source", "item", "value"])
        at = to


def gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """``floor((p - q)^2 / q)`` of whole numbers."""
    d = p - q
    return d * d // q


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """``lang, source, part, item, value, rank``: divergences of pairs, and each source's most raised terms."""
    freq = kept(frequencies(docs, min_docs), "frequencies")
    groups, scaled = shares(docs, freq)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pair_values(groups, scaled).withColumn("rank", F.row_number().over(order))
    raised = scaled.filter("p > q").select("lang", "source", F.col("term").alias("item"), _gap(F.col("p"), F.col("q")).alias("value"))
    terms = raised.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_terms)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(columns).unionByName(terms.withColumn("part", F.lit("term")).select(columns))
