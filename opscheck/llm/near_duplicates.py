"""Near-duplicate texts by Order MinHash, verified by banded alignment.

A text is the sequence of its shingles of ``shingle`` lower-cased words, each labelled with
its occurrence number. Every one of ``sketches`` hash functions samples the ``minima``
smallest labelled shingles and keeps them in text order, so texts collide only if they
share shingles in the same order. Texts of equal words are one class from the start.

Within a bucket of equal sketches, members are compared with hubs instead of with each
other: the member that meets most others over all its buckets, and for members dealt into
small random groups the first of each group, ``orders`` times. Every candidate that
could still join two classes is verified: the longest common subsequence M of two
shingle sequences of lengths A and B, found in a band that no acceptable alignment leaves, must
give M / (A + B - M) >= ``similarity``. Linked texts form classes (connected components).

What sketches and hubs miss is then found exactly. In one order of all labelled shingles two texts similar enough
share one of their first A - ceil(``similarity`` A) + 1; pairs of different classes that share as many of
these as they need are verified too, so no link between two classes is left out. The
shingles that are frequent in a sample come last in that order; this decides the time only.

Defined results: texts of equal words (NULL, empty and wordless texts among them: no words)
are one class; a text of fewer words than a shingle is one shingle; texts of any length
are compared whole; repeated rows are of one class; rows with a NULL doc_id are classed by their text, and a
class of only such rows has a NULL class_id; an empty table gives an empty result; further
columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opscheck.llm.common import durable, few, map_rows, row_key, texts
from opscheck.llm.components import components
from opscheck.operators.keyed import probe
from opscheck.session import stored

_WORD = re.compile(r"\w+")
_MEMO = 150_000
_BASE = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class NearDuplicateParameters:
    shingle: int = 5
    similarity: float = 0.8
    minima: int = 3
    sketches: int = 16
    orders: int = 2
    group: int = 4
    sample: int = 64
    hot_sampled: int = 3  # texts of the sample; a shingle in more comes last in the order
    most_hot: int = 200_000
    most_broadcast: int = 200_000  # shingles and texts to compare at the end; more are joined by a shuffle


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class _Words(dict):
    """Hashes of words, kept in a memo."""

    def __missing__(self, word: str) -> int:
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def hashes(self, words: list[str]) -> np.ndarray:
        if len(self) > _MEMO:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words; of the whole where there are fewer."""
    size = min(size, len(words))
    if not size:
        return np.empty(0, np.uint64)
    n = len(words) - size + 1
    out = np.full(n, size, np.uint64)
    for k in range(size):
        out = _mixed(out * _BASE + words[k:k + n])
    return out


def labelled(values: np.ndarray) -> np.ndarray:
    """Every value together with the number of its earlier occurrences."""
    order = np.argsort(values, kind="stable")
    ordered = values[order]
    first = np.concatenate(([True], ordered[1:] != ordered[:-1]))
    if first.all():
        return _mixed(values)
    at = np.arange(len(values))
    earlier = np.empty(len(values), np.uint64)
    earlier[order] = (at - np.maximum.accumulate(np.where(first, at, 0))).astype(np.uint64)
    return _mixed(values + earlier * _BASE)


def order_min_hash(kmers: np.ndarray, p: NearDuplicateParameters) -> list[int]:
    """One value per hash function: its ``minima`` smallest labelled k-mers in text order."""
    if not len(kmers):
        return []
    seeds = _mixed(np.arange(1, p.sketches + 1, dtype=np.uint64) * _BASE)
    kept, out, rows = min(p.minima, len(kmers)), [], max(1, 2_000_000 // len(kmers))
    for low in range(0, p.sketches, rows):
        hashed = _mixed(kmers[None, :] ^ seeds[low:low + rows, None])
        at = np.sort(np.argpartition(hashed, kept - 1, axis=1)[:, :kept], axis=1)
        value = seeds[low:low + rows].copy()
        for k in range(kept):
            value = _mixed(value * _BASE + kmers[at[:, k]])
        out += value.view(np.int64).tolist()
    return out


def aligned_similarity(a: np.ndarray, b: np.ndarray, least: float) -> float:
    """M / (A + B - M) for the longest common subsequence M, or 0 where it is surely below ``least``.

    M must reach ``least`` (A + B) / (1 + ``least``), so an acceptable alignment never leaves the
    band of offsets up to A + B - 2 M. A row of the band is one integer whose bits
    are its cells; a step of the alignment is an addition.
    """
    total = len(a) + len(b)
    needed = int(np.ceil(least * total / (1 + least) - 1e-9))
    if not total or min(len(a), len(b)) < needed:
        return 0.0 if total else 1.0
    short = min(len(a), len(b))
    differs = np.flatnonzero(a[:short] != b[:short])
    head = int(differs[0]) if len(differs) else short
    differs = np.flatnonzero(a[::-1][:short - head] != b[::-1][:short - head])
    tail = int(differs[0]) if len(differs) else short - head
    matched = head + tail
    x, y = a[head:len(a) - tail].tolist(), b[head:len(b) - tail].tolist()
    if x and y:
        # at most so many of the rest can be left out on either side together
        band = total - 2 * needed
        places: dict[int, list[int]] = {}
        for i, value in enumerate(x):
            places.setdefault(value, []).append(i)
        width = 2 * band + 1
        full = (1 << width) - 1
        row, low = full, -band  # bit k stands for position low + k of x; a cleared bit is a step up
        for j, value in enumerate(y):
            hits, found = 0, places.get(value, ())
            for i in found[bisect_left(found, low):bisect_left(found, low + width)]:  # only those in the band
                hits |= 1 << (i - low)
            if hits:
                used = row & hits
                row = ((row + used) | (row - used)) & full
            matched += not row & 1  # the lowest column leaves the band
            row = (row >> 1) | (1 << (width - 1))
            low += 1
        matched += width - row.bit_count()
    return matched / (total - matched) if matched >= needed else 0.0


def _hot(docs: DataFrame, p: NearDuplicateParameters) -> np.ndarray:
    """Labelled shingles that are frequent in a sample of the texts, ascending; at most ``most_hot``."""
    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _Words()
        for batch in batches:
            for t in batch["text"]:
                yield pd.DataFrame({"token": labelled(shingles(known.hashes(_WORD.findall(t.lower())), p.shingle)).view(np.int64)})

    sampled = texts(docs).select("text").filter(F.pmod(F.xxhash64("text"), F.lit(p.sample)) == 0).distinct()
    found = (sampled.mapInPandas(split, "token bigint").groupBy("token").agg(F.count("*").alias("n"))
             .filter(F.col("n") > p.hot_sampled).orderBy(F.desc("n"), "token").limit(p.most_hot).select("token").toPandas())
    return np.sort(found["token"].to_numpy(np.int64).view(np.uint64))


def needed_prefix(size: int, p: NearDuplicateParameters) -> int:
    """How many first shingles of a text of ``size`` shingles hold one of every text similar enough."""
    return size - int(np.ceil(p.similarity * size - 1e-6)) + 1 if size else 0


def prefix(kmers: np.ndarray, hot: np.ndarray, p: NearDuplicateParameters) -> list[int]:
    """The first ``needed_prefix`` labelled k-mers in the common order: those of ``hot`` last, else by value."""
    ordered = np.sort(kmers)
    if len(hot):
        late = hot[np.minimum(np.searchsorted(hot, ordered), len(hot) - 1)] == ordered
        ordered = np.concatenate((ordered[~late], ordered[late]))
    return ordered[:needed_prefix(len(kmers), p)].view(np.int64).tolist()


def _sketched(docs: DataFrame, p: NearDuplicateParameters) -> DataFrame:
    """Per row: its key and id, the digest of its words, its sketch, its number of shingles and the first of them."""
    hot = docs.sparkSession.sparkContext.broadcast(_hot(docs, p))  # under 2 MB

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _Words()
        for batch in batches:
            for low in range(0, len(batch), 250):  # the words of a whole batch would fill the memory
                part = batch.iloc[low:low + 250]
                words = [_WORD.findall(t.lower()) for t in part["text"]]
                kmers = [labelled(shingles(known.hashes(w), p.shingle)) for w in words]
                yield part[["key", "doc_id"]].assign(digest=[xxhash.xxh128_digest(" ".join(w).encode()) for w in words],
                                                     sketch=[order_min_hash(k, p) for k in kmers], size=[len(k) for k in kmers],
                                                     prefix=[prefix(k, hot.value, p) for k in kmers])

    keyed = texts(docs).withColumn("key", row_key())
    return map_rows(keyed, sketch, "key binary, doc_id bigint, digest binary, sketch array<bigint>, size int, prefix array<bigint>")


def _candidates(sketches: DataFrame, p: NearDuplicateParameters) -> DataFrame:
    """Pairs ``a``, ``b`` of digests with the number of comparisons that proposed them."""
    members = sketches.select("digest", F.explode("sketch").alias("bucket"))
    sizes = members.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    members = durable(probe(members, sizes, "bucket"))
    meets = members.groupBy("digest").agg(F.sum("size").alias("meets"))
    members = probe(members, meets, "digest")
    everyone = F.lit(0).alias("order"), F.lit(0).cast("bigint").alias("part"), F.col("meets").alias("rank")
    ways = [members.select("bucket", "digest", *everyone)]
    for order in range(1, p.orders + 1):
        part = F.pmod(F.xxhash64("bucket", "digest", F.lit(order)), F.ceil(F.col("size") / p.group))
        ways.append(members.select("bucket", "digest", F.lit(order).alias("order"), part.alias("part"),
                                   F.xxhash64("digest", F.lit(order)).alias("rank")))
    dealt = ways[0]
    for way in ways[1:]:
        dealt = dealt.unionByName(way)
    hubs = dealt.groupBy("bucket", "order", "part").agg(F.max(F.struct("rank", "digest")).alias("hub"))
    met = probe(dealt, hubs, ["bucket", "order", "part"]).filter("digest <> hub.digest")
    a, b = F.least("digest", F.col("hub.digest")), F.greatest("digest", F.col("hub.digest"))
    return met.groupBy(a.alias("a"), b.alias("b")).agg(F.count("*").alias("votes"))


def _unmet(classed: DataFrame, p: NearDuplicateParameters) -> DataFrame:
    """All pairs ``a``, ``b`` of digests of different classes that share as many first shingles as similar texts must."""
    tokens = classed.select("digest", "size", F.xxhash64("root").alias("class"), F.explode("prefix").alias("token"))  # a text's are distinct
    mixed = tokens.groupBy("token").agg(F.min("class").alias("least"), F.max("class").alias("most"))
    mixed = few(mixed.filter("least <> most").select("token"), p.most_broadcast)
    members = stored(tokens.join(mixed, "token", "left_semi"))
    # first which classes meet, so that the members of one class are never paired with each other
    classes = members.select("token", "class").distinct()
    meet = (classes.withColumnRenamed("class", "class_a").join(classes.withColumnRenamed("class", "class_b"), "token")
            .filter("class_a < class_b"))
    first = members.select("token", F.col("class").alias("class_a"), F.col("digest").alias("a"), F.col("size").alias("size_a"))
    second = members.select("token", F.col("class").alias("class_b"), F.col("digest").alias("b"), F.col("size").alias("size_b"))
    pairs = meet.join(first, ["token", "class_a"]).join(second, ["token", "class_b"])
    pairs = pairs.filter(F.least("size_a", "size_b") >= p.similarity * F.greatest("size_a", "size_b") - 1e-6)
    least = F.ceil(p.similarity * (F.col("size_a") + F.col("size_b")) / (1 + p.similarity) - 1e-6)
    beyond = F.ceil(p.similarity * F.greatest("size_a", "size_b") - 1e-6) - 1  # at most so many are shared behind the first ones
    return (pairs.groupBy("a", "b", "size_a", "size_b").agg(F.count("*").alias("n"))
            .filter(F.col("n") >= least - beyond).select("a", "b"))


def _verified(pairs: DataFrame, contents: DataFrame, p: NearDuplicateParameters) -> DataFrame:
    """The pairs whose texts are similar enough."""
    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, memo = _Words(), {}

        def sequence(digest: bytes, text: str) -> np.ndarray:
            if digest not in memo:
                if len(memo) > 64:
                    memo.clear()
                memo[digest] = shingles(known.hashes(_WORD.findall(text.lower())), p.shingle)
            return memo[digest]

        for batch in batches:
            keep = [_similar(sequence(r.a, r.text_a), sequence(r.b, r.text_b), p.similarity)
                    for r in batch.itertuples(index=False)]
            yield batch.loc[keep, ["a", "b"]]

    first = probe(pairs.select("a", "b"), contents.select(F.col("digest").alias("a"), F.col("text").alias("text_a")), "a")
    both = probe(first, contents.select(F.col("digest").alias("b"), F.col("text").alias("text_b")), "b")
    return both.select("a", "text_a", "b", "text_b").mapInPandas(check, "a binary, b binary")


def _similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """The number of common labelled shingles bounds the alignment; most candidates fail there already."""
    common = len(np.intersect1d(labelled(a), labelled(b), assume_unique=True))
    return common >= least * (len(a) + len(b)) / (1 + least) - 1e-9 and aligned_similarity(a, b, least) >= least - 1e-9


def near_duplicates(docs: DataFrame, p: NearDuplicateParameters = NearDuplicateParameters()) -> DataFrame:
    """A row per row: ``key``, ``doc_id``, ``root`` (the class), ``class_id`` (its smallest doc_id) and ``n_in_class``."""
    rows = stored(_sketched(docs, p))
    distinct = stored(rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"), F.min("key").alias("key"),
                                                 F.first("sketch").alias("sketch"), F.first("size").alias("size"), F.first("prefix").alias("prefix")))
    candidates = durable(_candidates(distinct, p))
    ends = candidates.select(F.explode(F.array("a", "b")).alias("digest")).distinct()
    needed = probe(distinct.select("digest", "key"), ends, "digest", "left_semi")
    keyed = texts(docs).select(row_key().alias("key"), "text")
    contents = stored(probe(keyed, needed, "key").groupBy("digest").agg(F.first("text").alias("text")))

    # each text's best candidate first; later only what could still join two classes
    turned = candidates.select(F.col("b").alias("a"), F.col("a").alias("b"), "votes")
    best = (candidates.unionByName(turned).groupBy("a").agg(F.max(F.struct("votes", F.col("b").alias("other"))).alias("top"))
            .select(F.least("a", "top.other").alias("x"), F.greatest("a", "top.other").alias("y"))
            .distinct().withColumnsRenamed({"x": "a", "y": "b"}))
    links = durable(_verified(best, contents, p))
    roots = components(links)
    mine = roots.select(F.col("node").alias("a"), F.col("root").alias("ra"))
    open_pairs = probe(candidates.select("a", "b"), mine, "a", "left")
    open_pairs = probe(open_pairs, mine.withColumnsRenamed({"a": "b", "ra": "rb"}), "b", "left")
    open_pairs = open_pairs.filter(F.coalesce("ra", "a") != F.coalesce("rb", "b"))
    more = durable(_verified(open_pairs, contents, p))
    links = links.unionByName(more)

    def classes_of(roots: DataFrame, *columns: str) -> DataFrame:
        classed = probe(distinct.select("digest", *columns), roots.withColumnRenamed("node", "digest"), "digest", "left")
        return classed.withColumn("root", F.coalesce("root", "digest"))

    roots = components(links)
    unmet = durable(_unmet(stored(classes_of(roots, "size", "prefix")), p))
    if not unmet.isEmpty():
        ends = unmet.select(F.explode(F.array("a", "b")).alias("digest")).distinct()
        needed = few(probe(distinct.select("digest", "key"), ends, "digest", "left_semi"), p.most_broadcast)
        contents = stored(keyed.join(needed, "key").groupBy("digest").agg(F.first("text").alias("text")))
        more = durable(_verified(unmet, contents, p))
        roots = components(links.unionByName(more)) if not more.isEmpty() else roots

    classed = classes_of(roots, "doc_id", "n")
    classes = classed.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.sum("n").alias("n_in_class"))
    classed = probe(classed.select("digest", "root"), classes, "root").select("digest", "root", "class_id", "n_in_class")
    return probe(rows.select("key", "doc_id", "digest"), classed, "digest").drop("digest")
