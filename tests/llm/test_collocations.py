"""Phrase collocations against plain counting, and the double array against a dictionary."""

from __future__ import annotations

import collections
import random
import re

import numpy as np
import pytest

from opscheck.llm.collocations import CollocationParameters, DoubleArray, _counted, _vectors, advance, collocations

SCHEMA = "doc_id long, text string, lang string, phrase string, a int, rank string, code int"


def by_hand(rows, p):
    f = collections.Counter()
    for _, text, lang, *_ in rows:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            words = re.findall("[^\x20\x09]+", piece)
            for k in range(1, p.longest + 1):
                for i in range(len(words) - k + 1):
                    f["und" if lang is None else lang, tuple(words[i:i + k])] += 1
    total = collections.Counter()
    for (lang, words), a in f.items():
        total[lang] += a * (len(words) == 1)
    frequent = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= p.least}
    out = collections.defaultdict(list)
    for (lang, words), a in frequent.items():
        within = any(m == lang and len(longer) > len(words) and 100 * b >= 100 * a and
                     any(longer[i:i + len(words)] == words for i in range(len(longer) - len(words) + 1))
                     for (m, longer), b in frequent.items())
        if not within:
            cuts = []
            for k in range(1, len(words)):
                left, right = f[lang, words[:k]], f[lang, words[k:]]
                cuts.append((1000 * a * total[lang] // (left * right), k, left, right))
            score, _, left, right = min(cuts)
            out[lang].append((-score, -a, " ".join(words).encode(), left, right))
    return sorted((lang, i, x[2].decode(), -x[1], x[3], x[4], total[lang], -x[0])
                  for lang, found in out.items() for i, x in enumerate(sorted(found)[:p.first], 1))


def sample(n=400):
    r = random.Random(6)
    kinds = ["alpha", "Beta", "the", "of", "x", "É", "日本"]
    rows = []
    for k in range(n):
        text = "".join(r.choice(kinds) + r.choice([" ", " ", " ", "  ", "\t", ". ", "\n", ",", ":\x0b"]) for _ in range(r.randint(0, 60)))
        rows.append((k, r.choice([text, text + "new york stock exchange rises. the the the the the the"]),
                     r.choice(["en", "en", "en", "de", None, "und", ""]), None, 1, "r", 2))
    rows += [(None, None, None, None, None, None, None), (1, "", "en", "p", 1, "r", 1), (2, "the of " * 20_000, "en", "p", 1, "r", 1)]
    return rows + rows[:5] * 3


@pytest.mark.parametrize("p", [CollocationParameters(least=20, first=50), CollocationParameters(least=5, longest=4, first=7),
                               CollocationParameters(least=20, first=50, max_words=3), CollocationParameters(least=20, first=50, max_nodes=5)])
def test_phrases_scores_and_ranks(spark, p):
    rows = sample()
    got = sorted(tuple(x) for x in collocations(spark.createDataFrame(rows, SCHEMA), p).collect())
    assert got == by_hand(rows, p)


def test_nothing_frequent_and_no_rows(spark):
    assert collocations(spark.createDataFrame(sample(3)[:3], SCHEMA)).count() == 0
    assert collocations(spark.createDataFrame([], SCHEMA)).count() == 0


def test_scores_past_64_bits(spark):
    text = "a b " * 50_000
    p = CollocationParameters(least=100)
    rows = [(1, text, "en", None, 1, "r", 1)]
    got = sorted(tuple(x) for x in collocations(spark.createDataFrame(rows, SCHEMA), p).collect())
    assert got == by_hand(rows, p)


@pytest.mark.parametrize("n_words, n", [(50, 2000), (5000, 20_000)])
def test_double_array_has_exactly_its_phrases(n_words, n):
    r = np.random.default_rng(3)
    trie, known = DoubleArray(n_words), {(w,): w for w in range(1, n_words + 1)}
    level = [(w,) for w in range(1, n_words + 1)]
    for _ in range(3):
        found = sorted({(*level[int(i)], int(min(w, n_words))) for i, w in zip(r.integers(0, len(level), n), r.zipf(1.3, n), strict=True)})
        states = trie.add(np.array([known[x[:-1]] for x in found]), np.array([x[-1] for x in found]))
        known |= dict(zip(found, states.tolist(), strict=True))
        level = found
    assert len(set(known.values())) == len(known)
    words = np.minimum(r.zipf(1.3, 20_000), n_words)
    states = words.astype(np.int64)
    for d in range(1, 4):
        states = advance(trie.base, trie.check, states[:-1], words[d:])
        want = [known.get(tuple(words[i:i + d + 1].tolist()), 0) for i in range(len(words) - d)]
        assert states.tolist() == want


def test_counting_keeps_the_partitions_of_the_arrays(spark):
    """Partitions that grow with the input would reach a worker as one batch each."""
    arrays = spark.createDataFrame([(np.array([1, 2, 1, 0], "<i4").tobytes(),)] * 60, "ids binary").repartition(9)
    trie, known = DoubleArray(2), spark.sparkContext.broadcast([("en", ["a", "b"])])
    trie.add(np.array([1]), np.array([2]))
    counted = _counted(arrays, trie, known, CollocationParameters(least=20))
    assert "Coalesce" not in counted._jdf.queryExecution().toString()
    assert [tuple(x) for x in counted.collect()] == [("en", "a b", 2, 60)]


def test_vectors_of_counts_do_not_grow_with_the_partitions(spark):
    arrays = spark.createDataFrame([(np.array([1, 2, 1, 0], "<i4").tobytes(),)] * 60, "ids binary").repartition(30)
    trie = DoubleArray(2)
    trie.add(np.array([1]), np.array([2]))
    sent = _vectors(arrays, spark.sparkContext.broadcast((trie.base, trie.check)), CollocationParameters()).collect()
    assert len(sent) <= spark.sparkContext.defaultParallelism
    assert sum(x.a for x in sent) == 60
