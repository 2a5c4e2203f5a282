"""A Merkle tree over the rows of a table, with proofs and their folding, by exchanging subtrees.

A row's leaf is the digest of its fields. The leaves of a tree (all rows of one ``tree`` column, NULL is a tree
of its own) stand in the order of ``order`` and are numbered without a task that holds them all. Every
``arity`` consecutive nodes become their digest, level by level, until one node remains: the tree's subroot. The
subroots, in the order of their trees (NULL first, then by bytes), are reduced to the root in the same way.

Leaves are grouped into superblocks of ``arity`` ** ``height``. One pass reduces each to a node; the
nodes, some thousand times fewer, go through the same steps again, which gives every superblock the siblings
on its way to the root. Leaves and these outer siblings are then cogrouped by superblock, and one function finishes
the local levels, joins both parts of each proof and folds it. All groups hold at most a superblock.

A digest is the lowercase hex SHA-256 of its inputs concatenated, digests as hex text. A field counts as
``-`` if it is NULL, else as the number of its UTF-8 bytes, a colon and the value.

Defined results: a NULL order value comes first; rows with equal order values stand in the order of their leaves, and
repeated rows are leaves of their own; the empty text is a value, unlike NULL; texts of any length count whole; a tree of one leaf
is that leaf; a root over one tree is its subroot; a leaf without siblings has the empty proof; an empty table
gives an empty result; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opscheck.operators.keyed import probe
from opscheck.operators.ranking import numbered
from opscheck.session import stored

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class MerkleParameters:
    arity: int = 8
    height: int = 4  # of a superblock, in levels

    @property
    def block(self) -> int:
        return self.arity ** self.height


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(**changed: Column) -> Column:
    """The digest of a row's fields, some of them taken from elsewhere."""
    return F.sha2(F.concat(*[field(changed.get(c, F.col(c))) for c in FIELDS]), 256)


def lowered(text: Column) -> Column:
    """``text`` with A-Z in lower case and everything else as it is."""
    return F.translate(text, _UPPER, _LOWER)


def _digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _levels(nodes: list[str], total: int, p: MerkleParameters) -> list[list[str]]:
    """The nodes of every level, from ``nodes`` up to the only one; ``total`` nodes are in the whole tree.

    Where the tree goes on beyond the superblock, all its levels are built, also over a single node.
    """
    levels = [nodes]
    while len(levels) <= p.height if total > p.block else len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([_digest(*last[k:k + p.arity]) for k in range(0, len(last), p.arity)])
    return levels


def _sides(levels: list[list[str]], p: MerkleParameters) -> list[tuple[tuple[str, ...], tuple[str, ...]]]:
    """For every node of the lowest level, the siblings to its left and right on each level below the top."""
    above = [((), ())] * len(levels[-1])
    for nodes in reversed(levels[:-1]):
        here = []
        for k in range(len(nodes)):
            first = k - k % p.arity
            lefts, rights = above[k // p.arity]
            here.append((("".join(nodes[first:k]), *lefts), ("".join(nodes[k + 1:first + p.arity]), *rights)))
        above = here
    return above


def _reduced(nodes: DataFrame, p: MerkleParameters) -> DataFrame:
    """One node per superblock, numbered in its tree; ``total`` is then the number of these."""
    def reduce(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("position")
        total, block = int(group["total"].iloc[0]), int(group["position"].iloc[0]) // p.block
        return pd.DataFrame({"tree": group["tree"].iloc[:1], "position": block, "total": -(-total // p.block),
                             "digest": _levels(list(group["digest"]), total, p)[-1][0]})

    block = F.floor(F.col("position") / p.block).cast("bigint")
    return nodes.groupBy("tree", block.alias("block")).applyInPandas(
        reduce, "tree string, position bigint, total bigint, digest string")


_WAY = "tree string, position bigint, lefts array<string>, rights array<string>, top string"


def _ways(nodes: DataFrame, p: MerkleParameters) -> DataFrame:
    """For every node, the siblings to its left and right on each level up to its tree's ``top``."""
    def finish(key: tuple, group: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("position")
        total = int(group["total"].iloc[0])
        levels = _levels(list(group["digest"]), total, p)
        lefts, rights, top = ((), (), levels[-1][0]) if outer.empty else (
            tuple(outer["lefts"].iloc[0]), tuple(outer["rights"].iloc[0]), outer["top"].iloc[0])
        sides = _sides(levels, p)
        return pd.DataFrame({"tree": group["tree"], "position": group["position"], "lefts": [a + lefts for a, _ in sides],
                             "rights": [b + rights for _, b in sides], "top": top})

    above = _reduced(nodes.filter(F.col("total") > p.block), p)
    goes_on = not nodes.filter(F.col("total") > p.block).isEmpty()
    outer = _ways(stored(above), p) if goes_on else above.sparkSession.createDataFrame([], _WAY)
    return _by_block(nodes, p).cogroup(outer.groupBy("tree", "position")).applyInPandas(finish, _WAY)


def _by_block(nodes: DataFrame, p: MerkleParameters):
    return nodes.groupBy("tree", F.floor(F.col("position") / p.block).cast("bigint").alias("block"))


def proofs(leaves: DataFrame, p: MerkleParameters = MerkleParameters(), siblings: bool = True) -> DataFrame:
    """Proof and folded root of every leaf.

    ``leaves`` has ``doc_id``, ``tree``, ``leaf`` and ``claimed`` (the digest that is to be verified). The result has these,
    the leaf's ``position`` in its tree, ``subroot``, ``root``, ``proof_sha256`` (the digest of all siblings, from the lowest
    level up, left to right), ``folded_root`` (from ``claimed`` and the siblings) and, if asked for, the ``siblings`` as
    ``lefts`` and ``rights``, one text of digests per level.
    """
    # a name of a tree that is not NULL and sorts alike: "-" stands before "="
    named = leaves.select("doc_id", F.coalesce(F.concat(F.lit("="), F.col("tree")), F.lit("-")).alias("tree"), "leaf", "claimed",
                          F.xxhash64(F.monotonically_increasing_id()).alias("salt"))  # spreads repeated rows
    placed = numbered(stored(named), [F.col("tree"), F.asc_nulls_first("doc_id"), F.col("leaf"), F.col("salt")], "_global")
    trees = placed.groupBy("tree").agg(F.min("_global").alias("_first"), F.count("*").alias("total"))
    nodes = stored(probe(placed, trees, "tree").select(
        "doc_id", "tree", "claimed", F.col("leaf").alias("digest"), (F.col("_global") - F.col("_first")).alias("position"), "total"))

    upper = stored(_reduced(nodes, p))
    inner = stored(_ways(upper, p))
    tops = inner.filter("position = 0").select("tree", F.col("top").alias("digest"))
    subroots = numbered(tops, [F.col("tree")])
    n_trees = subroots.agg(F.count("*")).first()[0]  # a number
    rows = subroots.select(F.lit("").alias("tree"), "position", F.lit(n_trees).cast("bigint").alias("total"), "digest")
    last = _ways(stored(rows), p).select("position", F.col("lefts").alias("more_lefts"), F.col("rights").alias("more_rights"),
                                         F.col("top").alias("root"))
    last = probe(subroots.select("tree", "position"), last, "position").drop("position")
    outer = probe(inner, last, "tree").select(
        "tree", F.col("position").alias("block"), F.concat("lefts", "more_lefts").alias("lefts"),
        F.concat("rights", "more_rights").alias("rights"), F.col("top").alias("subroot"), "root")

    def finish(key: tuple, group: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("position")
        way = outer.iloc[0]
        local = _sides(_levels(list(group["digest"]), int(group["total"].iloc[0]), p), p)
        lefts = [(*a, *way["lefts"]) for a, _ in local]
        rights = [(*b, *way["rights"]) for _, b in local]
        proof, folded = [], []
        for left, right, claimed in zip(lefts, rights, group["claimed"], strict=True):
            for a, b in zip(left, right, strict=True):
                claimed = _digest(a, claimed, b)
            folded.append(claimed)
            proof.append(_digest(*[x for pair in zip(left, right, strict=True) for x in pair]))
        result = pd.DataFrame({"doc_id": group["doc_id"], "tree": group["tree"], "position": group["position"], "leaf": group["digest"],
                               "claimed": group["claimed"], "subroot": way["subroot"], "root": way["root"],
                               "proof_sha256": proof, "folded_root": folded})
        return result.assign(lefts=lefts, rights=rights) if siblings else result

    schema = ("doc_id string, tree string, position bigint, leaf string, claimed string, subroot string, root string, "
              "proof_sha256 string, folded_root string" + ", lefts array<string>, rights array<string>" * siblings)
    nodes = nodes.withColumn("doc_id", F.col("doc_id").cast("string"))  # pandas turns a number with NULLs into a float
    found = _by_block(nodes, p).cogroup(outer.groupBy("tree", "block")).applyInPandas(finish, schema)
    tree = F.when(F.col("tree") != "-", F.col("tree").substr(F.lit(2), F.length("tree")))
    return found.withColumns({"doc_id": F.col("doc_id").cast("bigint"), "tree": tree})


def manifest(docs: DataFrame, claimed: Column | None = None, p: MerkleParameters = MerkleParameters(),
             siblings: bool = True) -> DataFrame:
    """Leaves, proofs and folded roots of ``docs``, a tree per ``lang`` in the order of ``doc_id``.

    ``claimed`` is the leaf's digest to verify, by default the leaf itself.
    """
    leaves = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("lang").cast("string").alias("tree"),
                         leaf().alias("leaf"), (leaf() if claimed is None else claimed).alias("claimed"))
    found = proofs(leaves, p, siblings)
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def tampered() -> Column:
    """The leaf whose text is in lower case where 3 divides the checksum of doc_id, else the leaf."""
    chosen = F.crc32(F.col("doc_id").cast("bigint").cast("string").cast("binary")) % 3 == 0
    return leaf(text=F.when(chosen, lowered(F.col("text"))).otherwise(F.col("text")))
