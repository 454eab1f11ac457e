"""Near-duplicate classes by DartMinHash over weighted five-word shingles.

A text is its multiset of ``SHINGLE``-word runs, the weight of a run being how often it occurs; a text of fewer words
is one run. Two texts are linked if their weighted Jaccard similarity (sum of least weights over sum of greatest) is
``THRESHOLD`` or more; classes are the connected groups of links.

Signatures: each unit of an element's weight owns a strip of ranks, into whose unit cells hashing throws a Poisson
number of darts, each with a rank and a coordinate. A text takes the darts of its strips below the rank at which
about ``COORDINATES * (ln COORDINATES + 3)`` are expected, whatever its size, and keeps the earliest dart of each
coordinate; if a coordinate has none, the rank is doubled for that text. Two texts agree in a coordinate with the
probability of their similarity. Bands of three coordinates make candidates: at 0.8 a pair misses all 32 bands with
a probability of 1e-10.

Candidates are never all pairs of a band's group. Texts with equal words are one text. In every group each text is
compared with two pivots, the text that shares most bands with others and the least by a hash (one of eight by band),
and the links make components. Where a group still
holds several components, the texts outside its largest are compared with those of other components, so that no link
between candidates is lost. Comparison is exact, on the words of both texts, and skips pairs whose sizes alone rule
out the threshold.

Defined results: texts without words are a class each; null texts are empty; rows without an id are left out; rows of
one id and equal words are one document; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.blocks import U64, Block, blocks, bytes_of, mix, release, rolling, spread, texts_of, word_hashes, words_of
from lumenframe.llm.scratch import kept
from lumenframe.operators.components import connected

SHINGLE, THRESHOLD = 5, 0.8
COORDINATES, ROWS = 96, 3
BANDS = COORDINATES // ROWS
PIVOTS = 8
#: Bands whose pivots every text of a group asks; in the others only texts that these left apart ask.
FIRST_BANDS = 8
#: Shingle units of the texts that one task compares with each other.
TILE_WEIGHT = 1 << 15
_ODD = [U64(int(x) | 1) for x in np.random.default_rng(5).integers(1, 2**63, 8)]
_POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(9)])


def unit_cells(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document and key of every unit of shingle weight, and two-part hashes ``(documents, 2)`` of the word sequences."""
    n = len(block.ids)
    words = words_of(block)
    hashes = word_hashes(block, words)
    first = np.cumsum(words.counts) - words.counts
    if len(hashes) >= SHINGLE:
        runs = mix(rolling(hashes, SHINGLE))
        whole = words.doc[: len(runs)] == words.doc[SHINGLE - 1 :]
        doc, key = words.doc[: len(runs)][whole], runs[whole]
    else:
        doc, key = np.zeros(0, np.int64), np.zeros(0, U64)
    place = np.arange(len(hashes)) - first[words.doc] if len(hashes) else np.zeros(0, np.int64)
    scaled = [hashes * (mix(place.astype(U64) + odd) | U64(1)) for odd in _ODD[:2]]
    some = np.flatnonzero(words.counts)
    content = np.zeros((n, 2), U64)
    for i, x in enumerate(scaled):
        if len(some):
            content[some, i] = mix(np.add.reduceat(x, first[some]) + words.counts[some].astype(U64))
    few = np.flatnonzero((words.counts > 0) & (words.counts < SHINGLE))
    doc, key = np.concatenate([doc, few]), np.concatenate([key, content[few, 0]])
    own = key + doc.astype(U64) * _ODD[2]
    order = np.argsort(own, kind="stable")
    own = own[order]
    new = np.ones(len(own), bool)
    new[1:] = own[1:] != own[:-1]
    at = np.arange(len(own))
    again = at - np.maximum.accumulate(np.where(new, at, 0))
    return doc[order], mix(key[order] + again.astype(U64) * _ODD[3]), content


def signatures(doc: np.ndarray, key: np.ndarray, n: int) -> np.ndarray:
    """``(n, COORDINATES)``: identity of the earliest dart by coordinate; zeros for documents without weight."""
    weight = np.bincount(doc, minlength=n)[:n]
    out = np.zeros((n, COORDINATES), U64)
    reach = COORDINATES * (math.log(COORDINATES) + 3) / np.maximum(weight, 1)
    todo = weight > 0
    while todo.any():
        here = todo[doc]
        d, k = doc[here], key[here]
        run, strip = spread(np.ceil(reach[d]).astype(np.int64))
        cell = mix(k[run] + (strip.astype(U64) + U64(1)) * _ODD[4])
        darts = np.searchsorted(_POISSON, (cell >> U64(11)).astype(np.float64) / 2.0**53, "right")
        which, nth = spread(darts)
        dart = mix(cell[which] + (nth.astype(U64) + U64(1)) * _ODD[5])
        of = d[run[which]]
        rank = strip[which] + (dart >> U64(20)).astype(np.float64) / 2.0**44
        slot = of * COORDINATES + ((dart & U64(0xFFFFF)) % U64(COORDINATES)).astype(np.int64)
        near = rank < reach[of]
        rank, slot, dart = rank[near], slot[near], dart[near]
        best = np.full(n * COORDINATES, np.inf)
        np.minimum.at(best, slot, rank)
        win = rank == best[slot]
        flat = np.zeros(n * COORDINATES, U64)
        flat[slot[win]] = dart[win]
        full = todo & np.isfinite(best.reshape(n, COORDINATES)).all(1)
        out[full] = flat.reshape(n, COORDINATES)[full]
        todo &= ~full
        reach[todo] *= 2
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """``(n, BANDS)``: one hash for each band of a signature."""
    parts = sig.reshape(-1, BANDS, ROWS) * np.array([_ODD[5], _ODD[6], _ODD[7]])
    return mix(mix(parts.sum(2)) + np.arange(BANDS, dtype=U64) * _ODD[3])


def signed(docs: DataFrame) -> DataFrame:
    """``doc_id, c0, c1`` (hashes of the word sequence), ``weight`` and ``bands`` (empty without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, 1 << 20, 2000):
            n = len(block.ids)
            doc, key, content = unit_cells(block)
            keys = band_keys(signatures(doc, key, n)).view(np.int64)
            weight = np.bincount(doc, minlength=n)[:n]
            ends = np.concatenate([[0], np.cumsum(np.where(weight > 0, BANDS, 0))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[weight > 0].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(block.ids), *[pa.array(np.ascontiguousarray(content[:, i]).view(np.int64)) for i in (0, 1)], pa.array(weight.astype(np.int64)), lists], names=["doc_id", "c0", "c1", "weight", "bands"])

    return texts_of(docs).mapInArrow(run, "doc_id long, c0 long, c1 long, weight long, bands array<long>")


def similarities(pairs: DataFrame) -> DataFrame:
    """``u, v, similarity`` of ``u, v, text_u, text_v``: exact weighted Jaccard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets = bytes_of(batch.column(2))[0] + bytes_of(batch.column(3))[0]
            at = 0
            while at < batch.num_rows:
                to = min(batch.num_rows, max(at + 1, int(np.searchsorted(offsets, offsets[at] + (1 << 20), "right")) - 1))
                sides = []
                for c in (2, 3):
                    ends, data = bytes_of(batch.column(c).slice(at, to - at))
                    doc, key, _ = unit_cells(Block(np.arange(to - at), ends - ends[0], data[ends[0] : ends[-1]]))
                    sides.append((doc, key))
                own = [mix(key) + doc.astype(U64) * _ODD[2] for doc, key in sides]
                both = np.isin(own[0], own[1], assume_unique=True)
                shared = np.bincount(sides[0][0][both], minlength=to - at)
                total = sum(np.bincount(doc, minlength=to - at) for doc, _ in sides)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), batch.column(1).slice(at, to - at), pa.array(shared / np.maximum(total - shared, 1))], names=["u", "v", "similarity"])
                at = to
                del sides, own, both
        release()

    return pairs.select("u", "v", "text_u", "text_v").mapInArrow(run, "u long, v long, similarity double")


def _linked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs ``u, v`` whose texts reach the threshold."""
    one = pairs.join(texts.select(F.col("doc_id").alias("u"), F.col("text").alias("text_u")), "u")
    two = one.join(texts.select(F.col("doc_id").alias("v"), F.col("text").alias("text_v")), "v")
    return similarities(two).filter(F.col("similarity") >= THRESHOLD - 1e-12).select("u", "v")


def _near_in_size(a: str, b: str):
    return F.least(a, b) >= F.greatest(a, b) * (THRESHOLD - 1e-9)


def _tiled(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` of one ``home`` dealt by hash to tiles of about ``TILE_WEIGHT`` units: adds ``name``."""
    counts = rows.groupBy("home").agg(F.ceil(F.sum("weight") / TILE_WEIGHT).alias("tiles"))
    return rows.join(counts, "home").withColumn(name, F.xxhash64("home", F.pmod(F.xxhash64("doc_id"), "tiles"))).drop("tiles")


def _met(table: pa.Table) -> pa.Table:
    """Links ``u, v`` between the texts of a tile that ask and all its texts of other components."""
    n = table.num_rows
    ids, root = table["doc_id"].to_numpy(), table["root"].to_numpy()
    ends, data = bytes_of(table["text"].combine_chunks())
    doc, key, _ = unit_cells(Block(np.arange(n), ends - ends[0], data[ends[0] : ends[-1]]))
    order = np.argsort(doc, kind="stable")
    names, unit = np.unique(key[order], return_inverse=True)
    weight = np.bincount(doc, minlength=n)
    stop = np.cumsum(weight)
    u, v = [], []
    for a in np.flatnonzero(table["asks"].to_numpy(zero_copy_only=False)):
        has = np.zeros(len(names), bool)
        has[unit[stop[a] - weight[a] : stop[a]]] = True
        before = np.concatenate([[0], np.cumsum(has[unit])])
        common = before[stop] - before[stop - weight]
        near = (common >= (THRESHOLD - 1e-12) * np.maximum(weight[a] + weight - common, 1)) & (root != root[a])
        v.append(ids[near])
        u.append(np.full(len(v[-1]), ids[a]))
    del doc, key, order, names, unit
    release()
    none = [np.zeros(0, np.int64)]
    return pa.table({"u": np.concatenate(u or none), "v": np.concatenate(v or none)})


def _across(split: DataFrame, texts: DataFrame) -> DataFrame:
    """Links ``u, v`` between components that share a band.

    ``split``: ``key, doc_id, weight, root`` and the group's largest component ``main`` of ``n`` texts. The texts
    outside it ask all texts of the group. Both are dealt to tiles of bounded size, and a text travels once to each
    tile that holds a text it shares a band with; pairs are never rows.
    """
    outside = F.max(F.col("root") != F.col("main")).alias("asks")
    homes = kept(split.groupBy("doc_id", "weight", "root").agg(F.max(F.struct("n", "main")).alias("h"), outside).select("doc_id", "weight", "root", "asks", F.col("h.main").alias("home")), "homes")
    answering = _tiled(homes.select("doc_id", "weight", "home"), "tile").select("doc_id", "tile")
    asking = _tiled(homes.filter("asks").select("doc_id", "weight", "home"), "ask_tile").select("doc_id", "ask_tile")
    members = split.select("key", "doc_id").join(answering, "doc_id")
    askers = split.filter(F.col("root") != F.col("main")).select("key", "doc_id").join(asking, "doc_id")
    told = members.join(askers.select("key", "ask_tile").distinct(), "key").select("ask_tile", "tile", "doc_id", F.lit(False).alias("asks")).distinct()
    told = told.unionByName(askers.join(members.select("key", "tile").distinct(), "key").select("ask_tile", "tile", "doc_id", F.lit(True).alias("asks")).distinct())
    told = told.join(homes.select("doc_id", "root"), "doc_id").join(texts.select("doc_id", "text"), "doc_id")
    return told.groupBy("ask_tile", "tile").applyInArrow(_met, "u long, v long").distinct()


def _asked_pivots(rows: DataFrame, asks: Column | None = None) -> DataFrame:
    """Pairs ``u, v`` of texts and a pivot of a group they are in: of all texts, or of those that ``asks`` names.

    Of a star of copies the original shares most bands; the pivot by hash serves groups without a centre.
    """
    central = rows.groupBy("doc_id").agg(F.sum("size").alias("degree"))
    ranked = rows.join(central, "doc_id")
    hub = F.max(F.struct("degree", (-F.col("doc_id")).alias("minus"), "weight"))
    drawn = F.min(F.struct(F.xxhash64("doc_id", F.pmod("band", F.lit(PIVOTS))).alias("h"), F.col("doc_id"), F.col("weight")))
    pivots = ranked.groupBy("key").agg(hub.alias("a"), drawn.alias("b"))
    both = F.array_distinct(F.array(F.struct((-F.col("a.minus")).alias("pivot"), F.col("a.weight").alias("pivot_weight")), F.struct(F.col("b.doc_id").alias("pivot"), F.col("b.weight").alias("pivot_weight"))))
    asking = rows if asks is None else rows.filter(asks)
    tried = asking.join(pivots.select("key", both.alias("both")), "key").select("doc_id", "weight", F.explode("both").alias("p")).select("doc_id", "weight", "p.*")
    tried = tried.filter((F.col("doc_id") != F.col("pivot")) & _near_in_size("weight", "pivot_weight"))
    return kept(tried.select(F.least("doc_id", "pivot").alias("u"), F.greatest("doc_id", "pivot").alias("v")).distinct(), "tried")


def classes(docs: DataFrame) -> DataFrame:
    """``doc_id, class_id``: the least id of each document's class."""
    texts = texts_of(docs)
    sets = kept(signed(docs).dropDuplicates(["doc_id", "c0", "c1"]), "signed")
    wordy = sets.filter("weight > 0")
    lowest = wordy.groupBy("c0", "c1").agg(F.min("doc_id").alias("rep"))
    named = kept(wordy.select("doc_id", "c0", "c1").join(lowest, ["c0", "c1"]).select("doc_id", "rep"), "same-words")
    reps = wordy.join(lowest.select(F.col("rep").alias("doc_id"), "c0", "c1"), ["doc_id", "c0", "c1"], "left_semi")
    bands = reps.select("doc_id", "weight", F.posexplode("bands").alias("band", "key"))

    sizes = bands.groupBy("key").agg(F.count("*").alias("size"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").select("key", "size")
    shared = kept(bands.join(sizes, "key"), "shared-bands")
    # first few bands link most copies to a pivot; of the other bands only what those links left apart asks a pivot
    first = kept(_linked(_asked_pivots(shared.filter(F.col("band") < FIRST_BANDS)), texts), "links")
    found = _components(first)
    placed = shared.join(found, "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))
    parts = placed.groupBy("key", "root").agg(F.count("*").alias("n"))
    main = parts.groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.count("*").alias("parts")).filter("parts > 1").select("key", "main")
    apart = kept(placed.join(main, "key"), "apart")
    links = first.unionByName(kept(_linked(_asked_pivots(apart, F.col("root") != F.col("main")), texts), "links"))
    found = _components(links)

    # groups that still hold several components
    placed = shared.join(found, "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))
    placed = kept(placed.select("key", "doc_id", "weight", "root"), "placed")
    parts = placed.groupBy("key", "root").agg(F.count("*").alias("n"))
    main = parts.groupBy("key").agg(F.max(F.struct("n", "root")).alias("m"), F.count("*").alias("parts")).filter("parts > 1").select("key", "m.n", F.col("m.root").alias("main"))
    more = kept(_across(placed.join(main, "key"), texts), "more-links")
    same = named.filter("doc_id != rep").select(F.col("rep").alias("u"), F.col("doc_id").alias("v"))
    final = _components(links.unionByName(more).unionByName(same))
    ids = sets.select("doc_id").distinct()
    return ids.join(final, "doc_id", "left").select("doc_id", F.coalesce("root", "doc_id").alias("class_id"))


def _components(links: DataFrame) -> DataFrame:
    """``doc_id, root`` of linked documents.

    Written, as the plan of ``connected`` holds a join, and the driver a broadcast, for each of its rounds, once per use.
    """
    found = connected(links.select(F.lit(0).alias("case_id"), F.col("u"), F.col("v")))
    return kept(found.select(F.col("node").alias("doc_id"), "root"), "components")


def deduplicated(docs: DataFrame) -> DataFrame:
    """One document of each class, that of the least id, with its columns; of rows of one id one stays."""
    firsts = classes(docs).filter("doc_id = class_id").select("doc_id")
    return docs.join(firsts, "doc_id", "left_semi").dropDuplicates(["doc_id"])
