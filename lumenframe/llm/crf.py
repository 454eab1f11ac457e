"""Language identification by a linear-chain conditional random field over words.

A word's scores come from hashed byte n-grams of the word between its boundaries (those that touch a boundary are
its affixes) and from a lexicon of the training words; transitions between the labels of neighbouring words are
learned with them. Forward-backward gives every word's label probabilities, so words of a text that switches
languages are labelled each; a document's language has the largest mean probability.

Training reads a bounded sample of documents with a language that are not held out (``max_docs``, drawn by hash).
As only whole documents are labelled, their spans are shuffled into sequences that switch languages.

All documents of a block form one chain that starts anew at each document. It is cut into equal lanes: products of
the lanes' transfer matrices give the state between lanes, then all lanes go forward and backward in step. The result
is exact, and one very long text costs no more steps than many short ones.

Defined results: null texts and texts without a letter are ``und`` with score 0, as is every text if nothing could be
learned; rows without an id are left out; repeated rows are predicted each. No column but ``text`` is an input.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.blocks import Block, blocks, spread, texts_of, word_hashes, words_of
from lumenframe.llm.nbsvm import is_held_out

DIM, GRAMS = 1 << 17, 4
MAX_DOCS, SPAN, ROUNDS, RATE, DECAY = 1500, 24, 14, 0.4, 1e-3
_LANES = 1024
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


class Lexemes(NamedTuple):
    """A block's words: distinct hashes, number of each word, document of each word, hashed grams by length, first gram of each distinct word."""

    hashes: np.ndarray
    numbers: np.ndarray
    doc: np.ndarray
    grams: list[np.ndarray]
    first: np.ndarray
    widths: np.ndarray


def lexemes(block: Block) -> Lexemes:
    words = words_of(block)
    numbers, found = pd.factorize(word_hashes(block, words))
    top = np.maximum.accumulate(numbers) if len(numbers) else numbers
    rep = np.concatenate([[0], np.flatnonzero(top[1:] > top[:-1]) + 1]) if len(numbers) else np.zeros(0, np.int64)
    sizes = words.end[rep] - words.start[rep]
    word, place = spread(sizes + 2)
    at = words.start[rep][word] + place - 1
    inside = (place > 0) & (place <= sizes[word])
    letters = np.where(inside, _LOWER[block.data[np.clip(at, 0, max(len(block.data) - 1, 0))]] if len(block.data) else 0, 32).astype(np.uint64)
    left = sizes[word] + 2 - place
    grams, code = [], letters
    for n in range(1, GRAMS + 1):
        if n > 1:
            code = (code[:-1] << np.uint64(8)) | letters[n - 1 :]
        hashed = (((code + np.uint64(n << 40)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 17)).astype(np.int32)
        full = np.zeros(len(letters), np.int32)  # place 0 weighs nothing
        full[: len(hashed)] = np.where(left[: len(hashed)] >= n, np.maximum(hashed, 1), 0)
        grams.append(full)
    return Lexemes(found, numbers, words.doc, grams, np.cumsum(sizes + 2) - sizes - 2, sizes)


class Model(NamedTuple):
    labels: list[str]
    weights: np.ndarray
    transitions: np.ndarray
    begin: np.ndarray
    known: np.ndarray
    shares: np.ndarray

    def emissions(self, x: Lexemes) -> np.ndarray:
        """Label scores of the distinct words."""
        if not len(x.hashes):
            return np.zeros((0, len(self.labels)))
        total = sum(np.add.reduceat(self.weights[g], x.first) for g in x.grams)
        return total / np.sqrt(x.widths + 2)[:, None] + self.lexicon(x.hashes)

    def lexicon(self, hashes: np.ndarray) -> np.ndarray:
        """Logarithms of the label shares of known words; 0 for others."""
        out = np.zeros((len(hashes), len(self.labels)))
        if len(self.known):
            near = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
            hit = self.known[near] == hashes
            out[hit] = self.shares[near[hit]]
        return out


def forward_backward(scores: np.ndarray, starts: np.ndarray, transitions: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label probabilities of every word, and expected transitions summed over all pairs of neighbours.

    ``scores`` are log potentials; ``starts`` marks words that begin a document.
    """
    n, k = scores.shape
    if n == 0:
        return np.zeros((0, k)), np.zeros((k, k))
    lanes = min(_LANES, n)
    m = -(-n // lanes)
    e = np.ones((lanes * m, k))
    e[:n] = np.exp(scores - scores.max(1, keepdims=True))
    fresh = np.ones(lanes * m, bool)
    fresh[:n] = starts
    e, fresh = np.ascontiguousarray(e.reshape(lanes, m, k).transpose(1, 0, 2)), np.ascontiguousarray(fresh.reshape(lanes, m).T)
    a, b = np.exp(transitions), np.exp(begin)
    first = np.broadcast_to(b, (k, k))

    def matrices(t: int) -> np.ndarray:
        return np.where(fresh[t][:, None, None], first, a) * e[t][:, None, :]

    product = np.broadcast_to(np.eye(k), (lanes, k, k))
    for t in range(m):
        product = product @ matrices(t)
        product /= product.max((1, 2), keepdims=True)
    into, after = np.empty((lanes, k)), np.empty((lanes, k))
    state = np.full(k, 1 / k)
    for i in range(lanes):
        into[i] = state
        state = state @ product[i]
        state /= state.sum()
    state = np.ones(k)
    for i in range(lanes - 1, -1, -1):
        after[i] = state
        state = product[i] @ state
        state /= state.sum()
    alpha, beta = np.empty((m, lanes, k)), np.empty((m, lanes, k))
    state = into
    for t in range(m):
        state = np.where(fresh[t][:, None], b, state @ a) * e[t]
        state /= state.sum(1, keepdims=True)
        alpha[t] = state
    state = after
    for t in range(m - 1, -1, -1):
        beta[t] = state
        onward = state * e[t]
        state = np.where(fresh[t][:, None], (onward @ b)[:, None], onward @ a.T)
        state = state / state.sum(1, keepdims=True)
    flat = lambda x: x.transpose(1, 0, 2).reshape(-1, k)[:n]
    alpha, beta, e = flat(alpha), flat(beta), flat(e)
    gamma = alpha * beta
    gamma /= gamma.sum(1, keepdims=True)
    inner = np.flatnonzero(~starts)
    pair = alpha[inner - 1][:, :, None] * a * (e[inner] * beta[inner])[:, None, :]
    expected = (pair / pair.sum((1, 2), keepdims=True)).sum(0) if len(inner) else np.zeros((k, k))
    return gamma, expected


def fit(texts: list[str], langs: list[str]) -> Model | None:
    """Learns from documents with one language each; None without any word."""
    raw = [t.encode() for t in texts]
    block = Block(np.arange(len(raw)), np.cumsum([0, *map(len, raw)]), np.frombuffer(b"".join(raw), np.uint8))
    x = lexemes(block)
    labels = sorted(set(langs))
    if not len(x.numbers):
        return None
    k = len(labels)
    own = np.array([labels.index(v) for v in langs])[x.doc]
    # spans of about SPAN words in a random order: sequences in which languages change
    rng = np.random.default_rng(11)
    new = np.ones(len(own), bool)
    new[1:] = (x.doc[1:] != x.doc[:-1]) | (rng.random(len(own) - 1) < 1 / SPAN)
    span = np.cumsum(new) - 1
    order = np.argsort(rng.permutation(span[-1] + 1)[span], kind="stable")
    numbers, y = x.numbers[order], own[order]
    starts = np.zeros(len(y), bool)
    starts[::400] = True
    n_words = len(x.hashes)
    seen = np.stack([np.bincount(numbers[y == i], minlength=n_words) for i in range(k)], 1)
    often = np.flatnonzero(seen.sum(1) >= 4)
    often = often[np.argsort(x.hashes[often])]
    shares = np.log((seen[often] + 0.5) / (seen[often].sum(1, keepdims=True) + 0.5 * k))
    shares -= shares.mean(1, keepdims=True)
    weights, transitions, begin = np.zeros((DIM, k)), np.zeros((k, k)), np.zeros(k)
    model = Model(labels, weights, transitions, begin, x.hashes[often], 0.5 * shares)
    pairs = ~starts[1:]
    real = np.bincount(y[:-1][pairs] * k + y[1:][pairs], minlength=k * k).reshape(k, k)
    sums, pair_sums = np.full((DIM, k), 1e-8), np.full((k, k), 1e-8)
    scale = np.repeat(1 / np.sqrt(x.widths + 2), x.widths + 2)
    word_at = np.repeat(np.arange(n_words), x.widths + 2)
    for _ in range(ROUNDS):
        gamma, expected = forward_backward(model.emissions(x)[numbers], starts, transitions, begin)
        error = -gamma
        error[np.arange(len(y)), y] += 1
        for i in range(k):
            by_word = np.bincount(numbers, error[:, i], n_words)
            value = by_word[word_at] * scale
            g = sum(np.bincount(gram, value, DIM) for gram in x.grams) - DECAY * weights[:, i]
            g[0] = 0
            sums[:, i] += g * g
            weights[:, i] += RATE * g / np.sqrt(sums[:, i])
        g = real - expected - DECAY * transitions
        pair_sums += g * g
        transitions += RATE * g / np.sqrt(pair_sums)
    return model._replace(weights=weights.astype(np.float32))


def train(docs: DataFrame, max_docs: int = MAX_DOCS) -> Model | None:
    """Learns from about ``max_docs`` documents that have a language and aren't held out."""
    usable = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id").cast("long")))
    share = min(1.0, max_docs / max(usable.count(), 1))
    drawn = usable.filter(F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.lit("languages")), F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = sorted((r.doc_id, r.lang, r.text) for r in drawn.select("doc_id", F.col("lang").cast("string").alias("lang"), "text").collect())
    return fit([r[2] for r in rows], [r[1] for r in rows]) if rows else None


def _has_letter(block: Block, words_doc: np.ndarray) -> np.ndarray:
    """Documents with a letter; bytes beyond ASCII are looked at as characters only where no ASCII letter is found."""
    has = np.zeros(len(block.ids), bool)
    has[block.docs_at(np.flatnonzero(_LETTER[block.data]))] = True
    for i in np.unique(words_doc[~has[words_doc]]).tolist():
        has[i] = any(c.isalpha() for c in block.text(i).decode("utf-8", "replace"))
    return has


def label_words(block: Block, model: Model) -> tuple[Lexemes, np.ndarray]:
    """Words of a block and the label probabilities of each."""
    x = lexemes(block)
    starts = np.ones(len(x.doc), bool)
    starts[1:] = x.doc[1:] != x.doc[:-1]
    return x, forward_backward(model.emissions(x)[x.numbers], starts, model.transitions, model.begin)[0]


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, second_lang, second_share`` of every document."""
    labels = np.array([*(model.labels if model else []), "und"], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, 1 << 21):
            n, k = len(block.ids), len(labels) - 1
            mean, letter = np.zeros((n, max(k, 1))), np.zeros(n, bool)
            if model is not None:
                x, gamma = label_words(block, model)
                count = np.bincount(x.doc, minlength=n)
                for i in range(k):
                    mean[:, i] = np.bincount(x.doc, gamma[:, i], n) / np.maximum(count, 1)
                letter = _has_letter(block, x.doc)
            order = np.argsort(-mean, 1, kind="stable")
            best = np.where(letter, order[:, 0], k)
            second = np.where(letter & (k > 1), order[:, min(1, order.shape[1] - 1)], k)
            score = np.where(letter, mean.max(1), 0.0)
            share = np.where(second < k, mean[np.arange(n), np.minimum(second, max(k - 1, 0))], 0.0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(block.ids), pa.array(labels[best], pa.string()), pa.array(np.clip(score, 0, 1)), pa.array(labels[second], pa.string()), pa.array(np.clip(share, 0, 1))],
                names=["doc_id", "lang_pred", "score", "second_lang", "second_share"],
            )

    found = texts_of(docs).mapInArrow(run, "doc_id long, lang_pred string, score double, second_lang string, second_share double")
    return found.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "second_lang", "second_share")
