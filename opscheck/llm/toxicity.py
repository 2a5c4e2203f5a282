"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word is the bag of its own hash and its character 3- and 4-grams, so an unseen
misspelling or inflection shares most vectors with the words seen in training. The
vectors of ``window`` consecutive words are averaged into a bag, a two-class softmax
reads the bag, and a text takes its highest bag: a few toxic words in a long text
are not diluted. Embeddings and softmax weights are trained jointly with Adam in
numpy on the driver, on at most ``max_rows`` labelled rows taken in the order of a
hash of their ids; every row is scored.

Defined results: NULL and empty texts (and texts without a word) have one empty bag and
get the softmax of the biases; a row whose id is NULL is scored and never trained on; of repeated
labels of one id the highest counts, NULL labels are left out; without a usable toxic label
nothing is known to be toxic and every score is 0; texts of any length are scored whole; repeated rows are scored alike; further columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opscheck.llm.common import map_rows, texts

_WORD = re.compile(r"\w+")
_MEMO = 150_000
_BLOCK_WORDS, _BLOCK_TOKENS = 20_000, 250_000


@dataclass(frozen=True)
class ToxicityParameters:
    dims: int = 8
    buckets: int = 1 << 16
    shortest: int = 3
    longest: int = 4
    window: int = 3
    max_rows: int = 6_000
    average_epochs: int = 15
    window_epochs: int = 70
    learning_rate: float = 0.05
    decay: float = 2e-6
    threshold: float = 0.3
    seed: int = 7


@dataclass(frozen=True)
class ToxicityModel:
    """``logits`` holds, per bucket, its embedding's product with the difference of the two softmax rows."""
    logits: np.ndarray
    bias: float
    parameters: ToxicityParameters


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def subwords(words: list[str], p: ToxicityParameters) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of every word itself and of every character n-gram of ``<word>``, and the number of each word's."""
    marked = [f"<{w}>" for w in words]
    sizes = np.array([len(m) for m in marked], dtype=np.int64)
    owner = np.repeat(np.arange(len(words)), sizes)
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    buckets = [np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words], dtype=np.uint64)]
    owners, grams = [np.arange(len(words))], np.zeros(len(codes), dtype=np.uint64)
    for n in range(1, p.longest + 1):
        grams = grams[:len(codes) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1:]
        if n >= p.shortest:
            inside = owner[:len(codes) - n + 1] == owner[n - 1:]
            mixed = grams[inside] ^ (grams[inside] >> np.uint64(29))
            buckets.append((mixed * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(32))
            owners.append(owner[:len(codes) - n + 1][inside])
    order = np.argsort(np.concatenate(owners), kind="stable")
    return ((np.concatenate(buckets) % np.uint64(p.buckets)).astype(np.int64)[order],
            np.bincount(np.concatenate(owners), minlength=len(words)))


def _bags(words: np.ndarray, window: int) -> np.ndarray:
    """Mean of every ``window`` consecutive values; of all of them where there are fewer."""
    if len(words) <= window:
        return np.array([words.mean() if len(words) else 0.0])
    sums = np.concatenate(([0.0], np.cumsum(words)))
    return (sums[window:] - sums[:-window]) / window


def _sliced(values: list, sizes: np.ndarray, limit: int) -> list[list]:
    """Consecutive parts of ``values`` whose sizes sum up to about ``limit``."""
    cuts = np.flatnonzero(np.diff((np.cumsum(sizes) - 1) // limit)) + 1
    return [values[a:b] for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(values)], strict=True)]


class _WordBlock:
    """Subwords of some words. Work by blocks bounds what the driver holds beside the indices."""

    def __init__(self, words: list[str], p: ToxicityParameters):
        buckets, self.sizes = subwords(words, p)
        self.flat = buckets.astype(np.int32)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def values(self, direction: np.ndarray) -> np.ndarray:
        return np.add.reduceat(direction[self.flat], self.starts) / self.sizes

    def gradient(self, pull: np.ndarray, buckets: int) -> np.ndarray:
        return np.bincount(self.flat, np.repeat(pull / self.sizes, self.sizes), buckets)


class _TextBlock:
    """The words of some texts, one after the other."""

    def __init__(self, docs: list[np.ndarray]):
        self.tokens = np.concatenate(docs)
        self.lengths = np.array([len(d) for d in docs])
        self.first = np.cumsum(self.lengths) - self.lengths

    def means(self, by_word: np.ndarray) -> np.ndarray:
        return np.add.reduceat(by_word[self.tokens], self.first) / self.lengths

    def spread(self, error: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.tokens, np.repeat(error / self.lengths, self.lengths), size)

    def highest_bags(self, by_word: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
        """Value of every text's highest bag, and the words of its first such bag."""
        sums = np.concatenate(([0.0], np.cumsum(by_word[self.tokens])))
        value = (sums[window:] - sums[:-window]) / window
        ends = np.column_stack((self.first, self.first + self.lengths - window + 1)).ravel()[:-1]
        best = np.maximum.reduceat(value, ends)[::2]
        # a bag that runs on into the next text comes after all of its own text's bags
        owner = np.repeat(np.arange(len(best)), self.lengths)[:len(value)]
        hits = np.flatnonzero(value == best[owner])
        _, once = np.unique(owner[hits], return_index=True)
        return best, self.tokens[hits[once][:, None] + np.arange(window)]


def fit(rows: list[tuple[str, int]], p: ToxicityParameters = ToxicityParameters()) -> ToxicityModel:
    """Train on (text, label) rows: first on the average over each text, then on each text's highest bag."""
    vocabulary: dict[str, int] = {}
    docs = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words_of(text)], dtype=np.int32)
            for text, _ in rows]
    labels = np.array([label for (_, label), d in zip(rows, docs, strict=True) if len(d)], dtype=float)
    docs = [d for d in docs if len(d)]
    if not labels.sum():
        return ToxicityModel(np.zeros(p.buckets), -np.inf, p)
    words = [_WordBlock(block, p) for block in _sliced(list(vocabulary), np.ones(len(vocabulary)), _BLOCK_WORDS)]
    n_words = len(vocabulary)
    del vocabulary
    # a text shorter than the window is padded with a word of value zero
    docs = [d if len(d) >= p.window else np.concatenate((d, np.full(p.window - len(d), n_words, np.int32))) for d in docs]
    blocks = [_TextBlock(block) for block in _sliced(docs, np.array([len(d) for d in docs]), _BLOCK_TOKENS)]
    del docs

    random = np.random.default_rng(p.seed)
    embeddings = random.normal(0, 0.1, (p.buckets, p.dims))
    softmax = random.normal(0, 0.5, p.dims)  # the difference of the two rows
    bias = float(np.log((labels.sum() + 1) / (len(labels) - labels.sum() + 1)))
    state = [np.zeros_like(embeddings), np.zeros_like(embeddings), np.zeros(p.dims), np.zeros(p.dims), 0.0, 0.0]

    def adam(value, gradient, k, step):
        state[k] = 0.9 * state[k] + 0.1 * gradient
        state[k + 1] = 0.99 * state[k + 1] + 0.01 * gradient * gradient
        return value - p.learning_rate * (state[k] / (1 - 0.9 ** step)) / (
            np.sqrt(state[k + 1] / (1 - 0.99 ** step)) + 1e-8)

    for step in range(1, p.average_epochs + p.window_epochs + 1):
        direction = embeddings @ softmax
        by_word = np.concatenate([*[w.values(direction) for w in words], [0.0]])
        if step <= p.average_epochs:
            logits = np.concatenate([t.means(by_word) for t in blocks]) * 10
            error = (1 / (1 + np.exp(-(logits + bias))) - labels) / len(labels)
            pull, low = np.zeros(n_words + 1), 0
            for t in blocks:
                pull += t.spread(error[low:low + len(t.first)] * 10, n_words + 1)
                low += len(t.first)
        else:
            tops = [t.highest_bags(by_word, p.window) for t in blocks]
            best, chosen = np.concatenate([x for x, _ in tops]), np.concatenate([x for _, x in tops])
            error = (1 / (1 + np.exp(-(best + bias))) - labels) / len(labels)
            pull = np.zeros(n_words + 1)
            for k in range(p.window):
                pull += np.bincount(chosen[:, k], error / p.window, n_words + 1)
        by_bucket, low = np.zeros(p.buckets), 0
        for w in words:
            by_bucket += w.gradient(pull[low:low + len(w.sizes)], p.buckets)
            low += len(w.sizes)
        towards = by_bucket[:, None] * softmax + p.decay * embeddings
        softmax_towards = by_bucket @ embeddings + p.decay * softmax
        embeddings = adam(embeddings, towards, 0, step)
        softmax = adam(softmax, softmax_towards, 2, step)
        bias = adam(bias, float(error.sum()), 4, step)
    return ToxicityModel((embeddings @ softmax).astype(np.float32), float(bias), p)


def score_texts(model: ToxicityModel, values, memo: dict[str, float]) -> np.ndarray:
    """Probability of the toxic class per text; ``memo`` keeps the values of words between calls."""
    p, out = model.parameters, np.empty(len(values))
    for k, text in enumerate(values):
        words = words_of(text)
        if len(memo) > _MEMO:
            memo.clear()
        if new := [w for w in set(words) if w not in memo]:
            buckets, sizes = subwords(new, p)
            sums = np.add.reduceat(model.logits[buckets], np.concatenate(([0], np.cumsum(sizes)[:-1])))
            memo.update(zip(new, (sums / sizes).tolist(), strict=True))
        best = _bags(np.array([memo[w] for w in words]), p.window).max()
        out[k] = 0.0 if model.bias == -np.inf else 1 / (1 + np.exp(-(best + model.bias)))
    return out


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that are never trained on: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def labelled_rows(docs: DataFrame, labels: DataFrame, p: ToxicityParameters) -> list[tuple[str, int]]:
    """At most ``max_rows`` labelled texts that are not held out.

    The ids are chosen from the labels first; their number bounds the broadcast.
    """
    usable = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    usable = usable.dropna().filter(F.col("toxic").isin(0, 1) & ~held_out())
    chosen = (usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(p.max_rows))
    rows = texts(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic")
    rows = rows.orderBy(F.xxhash64("doc_id", "text"), "text").limit(p.max_rows)  # ids may repeat
    return [(r.text, r.toxic) for r in rows.collect()]


def toxicity_scores(docs: DataFrame, labels: DataFrame,
                    p: ToxicityParameters = ToxicityParameters()) -> DataFrame:
    """``doc_id``, ``text``, ``held_out``, ``score`` (0 to 1) and ``predicted`` for every row of ``docs``."""
    model = docs.sparkSession.sparkContext.broadcast(fit(labelled_rows(docs, labels, p), p))

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo: dict[str, float] = {}
        for batch in batches:
            yield batch.assign(score=score_texts(model.value, batch["text"], memo))

    rows = texts(docs).withColumn("held_out", held_out())
    scores = map_rows(rows, scored, "doc_id bigint, text string, held_out boolean, score double")
    return scores.withColumn("predicted", (F.col("score") >= p.threshold).cast("int"))
