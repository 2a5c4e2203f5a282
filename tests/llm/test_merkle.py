"""The Merkle manifest against a tree built by hand."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from opscheck.llm.merkle import MerkleParameters, manifest, tampered

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, digest string, position int"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, low=False):
    doc_id, text, lang, source, n_chars = row[:5]
    if low and text is not None:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    fields = [doc_id, source, lang, n_chars, text]
    return sha(*["-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields])


def climb(nodes, arity):
    """The root and, for each node, the (left, right) siblings of every level."""
    ways = [[] for _ in nodes]
    owners = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, up_owners = [], []
        for k in range(0, len(nodes), arity):
            run = nodes[k:k + arity]
            for j in range(len(run)):
                for i in owners[k + j]:
                    ways[i].append(("".join(run[:j]), "".join(run[j + 1:])))
            up.append(sha(*run))
            up_owners.append([i for o in owners[k:k + arity] for i in o])
        nodes, owners = up, up_owners
    return nodes[0], ways


def by_hand(rows, arity):
    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append(r)
    order = sorted(trees, key=lambda t: (t is not None, (t or "").encode()))
    subs = {}
    for t in order:
        mine = sorted(trees[t], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        subs[t] = (mine, *climb([leaf_of(r) for r in mine], arity))
    root, tops = climb([subs[t][1] for t in order], arity)
    out = []
    for t, top in zip(order, tops, strict=True):
        mine, subroot, ways = subs[t]
        for r, way in zip(mine, ways, strict=True):
            cut = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            folded = leaf_of(r, cut)
            for a, b in way + top:
                folded = sha(a, folded, b)
            proof = sha(*[x for pair in way + top for x in pair])
            out.append((r[0], leaf_of(r), subroot, root, proof, folded, folded == root))
    return sorted(out, key=str)


def sample(n, langs=("en", "en", "en", "de", "Zz", "é", "", None)):
    r = random.Random(n)
    rows = [(k, "Text " * r.randint(0, 3) + str(r.random()), r.choice(langs), r.choice(["s", None, "é"]), r.choice([None, k]), "t", "d", 1)
            for k in range(n)]
    rows += [(5, "ABC É", "en", "s", 1, "t", "d", 1), (5, "abc É", "en", "s", 1, "t", "d", 1), (6, None, "one", None, None, None, None, None),
             (None, None, None, None, None, None, None, None), (None, "", "", "", 0, "", "", 0), (7, "Q" * 200_000, "de", "s", 3, "t", "d", 1)]
    return rows + [rows[-1], rows[-1], rows[0]]


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


@pytest.mark.parametrize("arity, height, n", [(8, 4, 300), (2, 1, 60), (3, 2, 200)])
def test_proofs_and_folding(spark, arity, height, n):
    rows = sample(n)
    found = manifest(spark.createDataFrame(rows, SCHEMA), tampered(), MerkleParameters(arity, height))
    got = found.collect()
    assert sorted([tuple(x[c] for c in COLUMNS) for x in got], key=str) == by_hand(rows, arity)
    assert {x.verified for x in got} == {True, False}
    for x in got[:20]:  # the siblings that are returned are those of the proof
        assert sha(*[s for pair in zip(x.lefts, x.rights, strict=True) for s in pair]) == x.proof_sha256


def test_one_leaf_and_none(spark):
    one = manifest(spark.createDataFrame([(1, "a", None, None, 1, None, None, None)], SCHEMA)).collect()
    assert [(x.subroot, x.root, x.proof_sha256, x.verified, x.tree) for x in one] == [(one[0].leaf, one[0].leaf, sha(), True, None)]
    assert manifest(spark.createDataFrame([], SCHEMA)).count() == 0
