"""Phrase collocations: frequent phrases of 2 to 5 words, scored by their loosest cut, per language.

A text is lower-cased (A-Z only), cut into pieces at punctuation and line ends, and these into words. A phrase is a
run of words within a piece; its count takes every place, overlaps included.

1. Words are counted; those with at least ``least`` places get ids. A phrase with a rarer word is itself rarer
   (Apriori), so texts are kept as arrays of ids in which rarer words and the ends of pieces are gaps.
2. Level by level, a phrase of k words is a candidate if its first and its last k - 1 words are frequent. All
   positions of an array go through a double-array trie of the frequent phrases at once, so a candidate is a pair of the states
   of neighbouring positions. Pairs are summed over the whole corpus, and those that reach ``least`` extend the trie.
3. The whole trie goes to every task; numpy advances the states of all positions word by word, counts the states that are
   reached with ``bincount``, and Spark sums these vectors over all tasks. These are the counts of all phrases.
4. Cuts, scores, dropping and ranking are joins and windows over the counts.

The trie is broadcast as two integer arrays, the vocabulary as a dictionary; both are bounded by ``max_nodes`` and
``max_words``, which are compared with counts before anything is collected. Beyond them phrases are counted, with
the same result, by a plain aggregate over all runs of words.

Defined results: a NULL language is ``und``, together with rows that name it so; NULL and empty texts have no words; repeated rows count
each; a text of any length is read whole; equal scores are ranked by count, then by the phrase's bytes; an empty table gives an empty result;
further columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opscheck.operators.keyed import probe
from opscheck.session import stored

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ENDS = ".,;:!?\n\x0b\x0c\r"  # fixed values: what ends a piece
_TO_BYTES = bytes.maketrans(_UPPER.encode() + _ENDS.encode(), _LOWER.encode() + b"." * len(_ENDS))
_CHUNK, _HELD_WORDS, _HELD_CODES = 2_000_000, 300_000, 1_000_000


@dataclass(frozen=True)
class CollocationParameters:
    least: int = 100
    longest: int = 5
    first: int = 2000
    max_words: int = 1_000_000
    max_nodes: int = 8_000_000


class DoubleArray:
    """A trie over word ids in two arrays: a child by ``word`` of ``state`` stands at ``base[state] + word`` and names its parent in ``check``.

    States 1 to ``n_words`` are the words themselves; 0 is none.
    """

    def __init__(self, n_words: int):
        self.n_words = n_words
        self.base = np.zeros(n_words + 1, dtype=np.int32)
        self.check = np.full(n_words + 1, -1, dtype=np.int32)

    def _grow(self, size: int) -> None:
        if size > len(self.base):
            more = max(size, len(self.base) * 3 // 2) - len(self.base)
            self.base = np.concatenate((self.base, np.zeros(more, dtype=np.int32)))
            self.check = np.concatenate((self.check, np.zeros(more, dtype=np.int32)))

    def add(self, parents: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Give every (parent, word) a state; a parent's children come in one call."""
        order = np.lexsort((words, parents))
        parents, words = parents[order].astype(np.int64), words[order].astype(np.int64)
        firsts = np.flatnonzero(np.diff(parents, prepend=-1))
        sizes = np.diff(firsts, append=len(parents))
        states = np.zeros(len(parents), dtype=np.int64)
        low = reset_at = 0
        for k in np.argsort(-sizes, kind="stable")[:np.count_nonzero(sizes > 1)]:  # parents with many children first
            if not low or 2 * sizes[k] < reset_at:  # smaller ones fit into the gaps that larger ones left
                low, reset_at = self.n_words + 1, sizes[k]
            own = slice(firsts[k], firsts[k] + sizes[k])
            states[own], low = self._place(int(parents[firsts[k]]), words[own], low)
        single = firsts[sizes == 1]
        free = self._free(len(single))
        self.base[parents[single]] = free - words[single]  # may be negative
        self.check[free] = parents[single]
        states[single] = free
        result = np.empty_like(states)
        result[order] = states
        return result

    def _free(self, n: int) -> np.ndarray:
        free = np.flatnonzero(self.check == 0)[:n]  # words have -1 there
        if len(free) < n:
            old = len(self.base)
            self._grow(old + n - len(free))
            free = np.concatenate((free, np.arange(old, old + n - len(free))))
        return free

    def _place(self, parent: int, words: np.ndarray, low: int, window: int = 8192) -> tuple[np.ndarray, int]:
        """The first free slots from ``low`` on that fit all children of ``parent``, and where they were looked for."""
        offsets = words - words[0]
        while True:  # ends behind the last slot in use at the latest
            self._grow(low + window + int(offsets[-1]) + 1)
            tried = np.flatnonzero(self.check[low:low + window] == 0) + low
            for k in range(0, len(tried), 256):
                slots = tried[k:k + 256, None] + offsets[None, :]
                fits = np.flatnonzero((self.check[slots] == 0).all(axis=1))
                if len(fits):
                    found = slots[fits[0]]
                    self.base[parent] = found[0] - words[0]
                    self.check[found] = parent
                    return found, low
            low += window


def advance(base: np.ndarray, check: np.ndarray, states: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The states after one more word each; 0 where the trie has no such child."""
    slots = base[states].astype(np.int64) + words
    inside = (states > 0) & (words > 0) & (slots > 0) & (slots < len(check))
    slots[~inside] = 0
    return np.where(inside & (check[slots] == states), slots, 0)


def _words(texts: list[str]) -> list[bytes]:
    """The words of all texts, with a full stop between pieces."""
    return b".".join([t.encode() for t in texts]).translate(_TO_BYTES).replace(b".", b" . ").split()


def _chunks(batch: pd.DataFrame) -> Iterator[tuple[str, list[str]]]:
    """The texts of a batch by language, about ``_CHUNK`` characters at a time."""
    for lang, texts in batch.groupby("lang")["text"]:
        held, size = [], 0
        for text in texts:
            held.append(text)
            size += len(text)
            if size >= _CHUNK:
                yield lang, held
                held, size = [], 0
        if held:
            yield lang, held


def word_counts(rows: DataFrame) -> DataFrame:
    """``lang``, ``phrase`` (a word) and ``a``, its number of places."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()

        def out() -> pd.DataFrame:
            made = pd.DataFrame({"lang": [k[0] for k in held], "phrase": [k[1].decode() for k in held], "a": list(held.values())})
            held.clear()
            return made

        for batch in batches:
            for lang, texts in _chunks(batch):
                found = Counter(_words(texts))
                found.pop(b".", None)
                for word, n in found.items():
                    held[lang, word] += n
                if len(held) >= _HELD_WORDS:
                    yield out()
        if held:
            yield out()

    partial = rows.mapInPandas(count, "lang string, phrase string, a bigint")
    return stored(partial.groupBy("lang", "phrase").agg(F.sum("a").alias("a")))


def _encoded(rows: DataFrame, vocabulary) -> DataFrame:
    """Arrays of word ids, 0 between pieces and for rarer words; words without a neighbour are left out."""
    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = _by_lang(vocabulary.value)
        for batch in batches:
            for lang, texts in _chunks(batch):
                if lang in ids:
                    words = _words(texts)
                    found = np.fromiter(map(ids[lang].get, words, repeat(0)), dtype=np.int32, count=len(words))
                    padded = np.concatenate(([0], found, [0])).astype(np.int32)
                    padded[1:-1][(padded[:-2] == 0) & (padded[2:] == 0)] = 0
                    kept = padded[1:][(padded[1:] > 0) | (padded[:-1] > 0)]
                    yield pd.DataFrame({"ids": [kept.tobytes()]})

    return stored(rows.mapInPandas(encode, "ids binary"))


_known: dict = {}


def _by_lang(vocabulary: list[tuple[str, list[str]]]) -> dict[str, dict[bytes, int]]:
    """Ids by language and word; kept for the tasks that a Python worker runs one after the other."""
    if _known.get("of") is not vocabulary:
        made, next_id = {}, 1
        for lang, words in vocabulary:
            made[lang] = {w.encode(): i for i, w in enumerate(words, next_id)}
            next_id += len(words)
        _known.update(of=vocabulary, ids=made)
    return _known["ids"]


def _arrays(batches: Iterator[pd.DataFrame]) -> Iterator[np.ndarray]:
    for batch in batches:
        for content in batch["ids"]:
            yield np.frombuffer(content, dtype="<i4")


def _pairs(arrays: DataFrame, trie: DoubleArray, k: int, p: CollocationParameters) -> DataFrame:
    """The candidates of ``k`` words as pairs of neighbouring states of ``k`` - 1 words, summed over the corpus, that reach ``least``."""
    shared = arrays.sparkSession.sparkContext.broadcast((trie.base, trie.check))  # at most max_nodes, checked

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base, check = shared.value
        held, size = [], 0

        def out() -> pd.DataFrame:
            codes, n = np.unique(np.concatenate(held), return_counts=True)
            return pd.DataFrame({"code": codes, "a": n})

        for ids in _arrays(batches):
            states = ids.astype(np.int64)
            for d in range(1, k - 1):
                states = advance(base, check, states[:-1], ids[d:])
            both = (states[:-1] > 0) & (states[1:] > 0)
            held.append((states[:-1][both] << 32) | states[1:][both])
            size += len(held[-1])
            if size >= _HELD_CODES:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    counted = arrays.mapInPandas(pairs, "code bigint, a bigint").groupBy("code").agg(F.sum("a").alias("a"))
    return stored(counted.filter(F.col("a") >= p.least).select("code"))


def _vectors(arrays: DataFrame, shared, p: CollocationParameters) -> DataFrame:
    """``state`` and ``a``, its number of places, from every task; as many tasks as slots, since each of more would send a vector of its own.

    As rows of an RDD a task's arrays come one after the other, while a batch of ``mapInPandas`` would grow with the input.
    """
    def count(rows: Iterator) -> Iterator[tuple[int, int]]:
        base, check = shared.value
        totals = np.zeros(len(check), dtype=np.int64)
        for row in rows:
            ids = np.frombuffer(row.ids, dtype="<i4")
            states = ids.astype(np.int64)
            for d in range(1, p.longest):
                states = advance(base, check, states[:-1], ids[d:])
                totals += np.bincount(states[states > 0], minlength=len(totals))
        reached = np.flatnonzero(totals)
        return zip(reached.tolist(), totals[reached].tolist(), strict=True)

    spark = arrays.sparkSession
    sent = arrays.rdd.coalesce(spark.sparkContext.defaultParallelism).mapPartitions(count)
    return spark.createDataFrame(sent, "state bigint, a bigint", verifySchema=False)


def _counted(arrays: DataFrame, trie: DoubleArray, vocabulary, p: CollocationParameters) -> DataFrame:
    """``lang``, ``phrase``, ``k`` and ``a`` of every phrase of the trie, by bincounts of the accepting states."""
    shared = arrays.sparkSession.sparkContext.broadcast((trie.base, trie.check))  # at most max_nodes, checked

    def name(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        check = shared.value[1]
        langs = [lang for lang, words in vocabulary.value for _ in words]
        words = [w for _, known in vocabulary.value for w in known]
        base = shared.value[0]
        for batch in batches:
            states, phrases, firsts, sizes = batch["state"].to_numpy(), [], [], []
            for state in states:
                parts = []
                while check[state] > 0:
                    parent = int(check[state])
                    parts.append(words[state - int(base[parent]) - 1])
                    state = parent
                parts.append(words[state - 1])
                phrases.append(" ".join(reversed(parts)))
                firsts.append(langs[state - 1])
                sizes.append(len(parts))
            yield pd.DataFrame({"lang": firsts, "phrase": phrases, "k": sizes, "a": batch["a"]})

    summed = _vectors(arrays, shared, p).groupBy("state").agg(F.sum("a").alias("a"))
    return summed.filter(F.col("a") >= p.least).mapInPandas(name, "lang string, phrase string, k int, a bigint")


def _by_trie(rows: DataFrame, frequent: DataFrame, p: CollocationParameters) -> DataFrame | None:
    """Counts of all frequent phrases, or None where the words or phrases pass the bounds of a broadcast."""
    if frequent.count() > p.max_words:
        return None
    context = rows.sparkSession.sparkContext
    known: dict[str, list[str]] = {}
    for row in frequent.orderBy("lang", "phrase").select("lang", "phrase").collect():  # at most max_words
        known.setdefault(row.lang, []).append(row.phrase)
    vocabulary = context.broadcast(list(known.items()))
    trie = DoubleArray(sum(map(len, known.values())))
    arrays, nodes = _encoded(rows, vocabulary), 0
    for k in range(2, p.longest + 1):
        found = _pairs(arrays, trie, k, p)
        nodes += found.count()
        if nodes > p.max_nodes or len(trie.check) > 4 * p.max_nodes:
            return None
        codes = found.toPandas()["code"].to_numpy()  # at most max_nodes
        if not len(codes):
            break
        words = codes & 0xFFFFFFFF
        if k > 2:
            words = words - trie.base[trie.check[words]]
        trie.add(codes >> 32, words)
    return _counted(arrays, trie, vocabulary, p)


def _by_aggregate(rows: DataFrame, p: CollocationParameters) -> DataFrame:
    """The same counts by a plain aggregate over all runs of words."""
    text = F.translate("text", _UPPER, _LOWER)
    pieces = rows.select("lang", F.explode(F.split(text, "[.,;:!?\\x0A-\\x0D]")).alias("piece"))
    words = pieces.select("lang", F.expr("filter(split(piece, '[ \\\\t]+'), w -> w <> '')").alias("words"))
    runs = words.select("lang", "words", F.explode(F.sequence(F.lit(2), F.lit(p.longest))).alias("k")).filter(F.size("words") >= F.col("k"))
    phrases = runs.select("lang", "k", F.explode(F.expr(
        "transform(sequence(1, size(words) - k + 1), i -> array_join(slice(words, i, k), ' '))")).alias("phrase"))
    return phrases.groupBy("lang", "phrase", "k").agg(F.count("*").alias("a")).filter(F.col("a") >= p.least)


def phrase_counts(docs: DataFrame, p: CollocationParameters = CollocationParameters()) -> tuple[DataFrame, DataFrame]:
    """Counts of words and frequent phrases (``lang``, ``phrase``, ``k``, ``a``), and of all words per language (``lang``, ``n``)."""
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    words = word_counts(rows)
    frequent = words.filter(F.col("a") >= p.least)
    phrases = _by_trie(rows, frequent, p)
    if phrases is None:
        phrases = _by_aggregate(rows, p)
    counts = stored(phrases.unionByName(frequent.select("lang", "phrase", F.lit(1).alias("k"), "a")))
    return counts, words.groupBy("lang").agg(F.sum("a").alias("n"))


def collocations(docs: DataFrame, p: CollocationParameters = CollocationParameters()) -> DataFrame:
    """The first phrases of every language: ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``.

    Of a phrase's cuts into two parts with ``l`` and ``r`` places, the one with the lowest score counts, the first of
    equal ones. A phrase that stands within a longer frequent one with as many places is dropped; since no phrase has more places
    than a part of it, the phrases of one word more decide.
    """
    counts, totals = phrase_counts(docs, p)
    phrases = counts.filter("k > 1")
    parts = counts.select("lang", "phrase", "a")
    cuts = phrases.withColumn("words", F.split("phrase", " ")).select(
        "lang", "phrase", "a", "words", F.explode(F.expr("sequence(1, k - 1)")).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", F.expr("array_join(slice(words, 1, cut), ' ')").alias("left"),
                       F.expr("array_join(slice(words, cut + 1, size(words) - cut), ' ')").alias("right"))
    cuts = probe(cuts, parts.select("lang", F.col("phrase").alias("left"), F.col("a").alias("l")), ["lang", "left"])
    cuts = probe(cuts, parts.select("lang", F.col("phrase").alias("right"), F.col("a").alias("r")), ["lang", "right"])
    cuts = probe(cuts, totals, "lang")
    wide = "CAST({} AS DECIMAL(19, 0))"
    score = F.expr(f"(1000BD * {wide.format('a')} * {wide.format('n')}) div ({wide.format('l')} * {wide.format('r')})")
    lowest = (cuts.groupBy("lang", "phrase").agg(F.min(F.struct(score.alias("score"), "cut", "a", "l", "r", "n")).alias("best"))
              .select("lang", "phrase", "best.*"))

    longer = phrases.filter("k > 2").withColumn("words", F.split("phrase", " "))
    inner = longer.select("lang", "a", F.explode(F.expr(
        "array(array_join(slice(words, 1, k - 1), ' '), array_join(slice(words, 2, k - 1), ' '))")).alias("phrase"))
    covered = inner.groupBy("lang", "phrase").agg(F.max("a").alias("within"))
    kept = probe(lowest, covered, ["lang", "phrase"], "left").filter("within IS NULL OR 100 * within < 100 * a")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= p.first)
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
