"""Benchmark decontamination by template windows with slot consistency.

Numbers, names and units become typed placeholders, so a question that was only
re-parameterised keeps its template. A run of capitalised words is one name, also where a sentence begins with
it; number words are numbers, and a run of them is one. Windows of ``window`` template tokens are hashed
and equi-joined; a benchmark item's windows found at one distance in a text form an
alignment. An alignment counts if its slots agree: every value of the item stands
for one value of the text and the other way round. A text is contaminated by an
item if consistent alignments cover ``min_share`` of the item's windows.

Before the join a text's windows are tested against a bit map of the benchmark's. Its
size is fixed; a benchmark too large for it lets more windows through, none is lost.

Defined results: NULL and empty texts and items have no windows and are clean; an item
shorter than the window is one window of its own length; items with fewer than ``min_words``
template words besides placeholders are never matched; repeated rows of either table give one hit per
(doc_id, item_id) and text; hits of a NULL doc_id or item_id keep the NULL; an empty table gives no
hits; further columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opscheck.llm.common import map_rows, row_key, texts

# Words and signs read as units.
UNITS = set("""
    mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ounce ounces
    pound pounds lb lbs ton tons ml l liter liters litre litres gallon gallons second seconds minute minutes hour hours
    day days week weeks month months year years cent cents dollar dollars euro euros percent degree degrees
    kmh mph hz khz mhz ghz kb mb gb tb watt watts volt volts joule joules kelvin celsius fahrenheit
""".split()) | {"$", "€", "£", "%", "°"}
# Words read as numbers.
NUMBER_WORDS = set("""
    zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen
    eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen
""".split())
_TOKEN = re.compile(r"\d+(?:[.,:/]\d+)*|[^\W\d_]+|[$€£%°]|[.!?\n]")
_END, _NUMBER, _NAME, _UNIT, _WORD = range(5)
TYPES = {_NUMBER: "number", _NAME: "name", _UNIT: "unit"}
_MEMO = 500_000
_BITS = 1 << 24
_BASE = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class DecontaminationParameters:
    window: int = 8
    min_words: int = 3
    min_share: float = 0.5


class _Templates:
    """Template tokens of texts; a token's kinds are kept in a memo."""

    def __init__(self) -> None:
        self.memo: dict[str, int] = {}

    def _code(self, token: str) -> int:
        """Hash of the template token, above four bits: its kind and whether it begins with a capital."""
        lowered = token.lower()
        kind = (_END if token in ".!?\n" else _NUMBER if token[0].isdigit() or lowered in NUMBER_WORDS
                else _UNIT if lowered in UNITS else _WORD)
        value = lowered if kind == _WORD else f"<{kind}>"
        return (xxhash.xxh64_intdigest(value) >> 5 << 5 | (lowered in NUMBER_WORDS) << 4
                | (kind == _WORD and token[0].isupper()) << 3 | kind)

    def of(self, text: str) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Values of the template tokens, their places among the tokens, template hashes and kinds."""
        tokens, memo = _TOKEN.findall(text), self.memo
        if len(memo) > _MEMO:
            memo.clear()
        for t in set(tokens):
            if t not in memo:
                memo[t] = self._code(t)
        codes = np.fromiter(map(memo.__getitem__, tokens), np.uint64, len(tokens))
        kinds = (codes & np.uint64(7)).astype(np.int8)
        initial = np.concatenate(([True], kinds[:-1] == _END))[:len(kinds)]
        capital = codes & np.uint64(8) != 0
        named = capital & ~initial
        named[:-1] |= capital[:-1] & named[1:]  # a sentence that begins with several capitalised words begins with a name
        hashes = codes >> np.uint64(5)
        kinds[named], hashes[named] = _NAME, _NAME
        worded = codes & np.uint64(16) != 0
        goes_on = np.zeros(len(kinds), bool)
        goes_on[1:] = (named[1:] & named[:-1]) | (worded[1:] & worded[:-1])
        kept = np.flatnonzero((kinds != _END) & ~goes_on)
        values = tokens
        if goes_on.any():
            values = list(tokens)
            for k in np.flatnonzero(goes_on)[::-1].tolist():
                values[k - 1] = f"{values[k - 1]} {values[k]}"
        return values, kept, hashes[kept], kinds[kept]


def _window_hashes(hashes: np.ndarray, kinds: np.ndarray, size: int, p: DecontaminationParameters) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the windows of ``size`` tokens that hold enough words."""
    if len(hashes) < size:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    n = len(hashes) - size + 1
    mixed = np.full(n, size, np.uint64)
    for k in range(size):
        mixed = (mixed ^ hashes[k:k + n]) * _BASE
        mixed ^= mixed >> np.uint64(31)
    words = np.concatenate(([0], np.cumsum(kinds == _WORD)))
    starts = np.flatnonzero(words[size:] - words[:-size] >= p.min_words)
    return starts, mixed[starts]


def _rows(tokens, kept, hashes, kinds, sizes, p, bits=None) -> Iterator[tuple[int, int, int, list]]:
    for size in sizes:
        starts, mixed = _window_hashes(hashes, kinds, size, p)
        if bits is not None:
            at = (mixed & np.uint64(_BITS - 1)).astype(np.int64)
            through = (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            starts, mixed = starts[through], mixed[through]
        for s, h in zip(starts.tolist(), mixed.astype(np.int64).tolist(), strict=True):
            slots = [[k, TYPES[int(kinds[s + k])], tokens[kept[s + k]].lower()] for k in range(size) if kinds[s + k] != _WORD]
            yield h, s, size, slots


_SLOTS = "array<struct<k int, type string, value string>>"


def benchmark_windows(benchmark: DataFrame, p: DecontaminationParameters) -> DataFrame:
    """Template windows of every item, with the number of windows of the item."""
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        templates = _Templates()
        for batch in batches:
            out = []
            for item, text in zip(batch["item_id"], batch["text"], strict=True):
                tokens, kept, hashes, kinds = templates.of(text)
                rows = list(_rows(tokens, kept, hashes, kinds, [min(p.window, len(kept))] if len(kept) else [], p))
                out += [(item, h, s, size, slots, len(rows)) for h, s, size, slots in rows]
            yield pd.DataFrame(out, columns=["item_id", "hash", "item_at", "size", "item_slots", "item_windows"])

    items = benchmark.select(F.col("item_id").cast("string"), F.coalesce("text", F.lit("")).alias("text"))
    return items.mapInPandas(cut, f"item_id string, hash bigint, item_at int, size int, item_slots {_SLOTS}, "
                                  "item_windows int").dropDuplicates(["item_id", "hash", "item_at"])


def _bit_map(windows: DataFrame) -> np.ndarray:
    """One bit per hash remainder; at most ``_BITS / 64`` words come to the driver whatever the benchmark holds."""
    at = F.col("hash").bitwiseAND(F.lit(_BITS - 1))
    words = (windows.select(F.shiftright(at, 6).alias("word"), F.expr(f"shiftleft(1L, CAST((hash & {_BITS - 1}) % 64 AS INT))").alias("bit"))
             .groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas())
    out = np.zeros(_BITS // 64, np.int64)
    out[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return out.view(np.uint8)


def contaminated(docs: DataFrame, benchmark: DataFrame,
                 p: DecontaminationParameters = DecontaminationParameters()) -> DataFrame:
    """Hits: ``doc_id``, ``key`` of the row, ``item_id``, ``share`` of the item's windows, ``n_slots`` and ``reparameterised``."""
    windows = benchmark_windows(benchmark, p)
    context = docs.sparkSession.sparkContext
    bits = context.broadcast(_bit_map(windows))  # 2 MB
    sizes = sorted({r["size"] for r in windows.select("size").distinct().collect()})  # at most ``window`` values

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        templates = _Templates()
        for batch in batches:
            out = []
            for key, doc, text in zip(batch["key"], batch["doc_id"], batch["text"], strict=True):
                out += [(key, doc, *row) for row in _rows(*templates.of(text), sizes, p, bits.value)]
            frame = pd.DataFrame(out, columns=["key", "doc_id", "hash", "doc_at", "size", "doc_slots"])
            yield frame.drop(columns="size")

    found = map_rows(texts(docs).withColumn("key", row_key()), cut,
                     f"key binary, doc_id bigint, hash bigint, doc_at int, doc_slots {_SLOTS}")
    shared = found.join(windows, "hash")
    pairs = F.expr("""transform(item_slots, (s, i) -> named_struct(
        'type', s.type, 'own', s.value, 'other', doc_slots[i].value))""")
    aligned = (shared.select("key", "doc_id", "item_id", "item_windows", "item_at",
                             (F.col("doc_at") - F.col("item_at")).alias("distance"), pairs.alias("pairs"))
               .groupBy("key", "doc_id", "item_id", "distance", "item_windows")
               .agg(F.collect_set("item_at").alias("starts"),
                    F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("slots")))
    own = F.size(F.array_distinct(F.expr("transform(slots, s -> struct(s.type, s.own))")))
    other = F.size(F.array_distinct(F.expr("transform(slots, s -> struct(s.type, s.other))")))
    consistent = aligned.filter((F.size("slots") == own) & (F.size("slots") == other))
    share = F.size(F.array_distinct(F.flatten(F.collect_set("starts")))) / F.col("item_windows")
    changed = F.max(F.exists("slots", lambda s: s["own"] != s["other"]))
    return (consistent.groupBy("key", "doc_id", "item_id", "item_windows")
            .agg(share.alias("share"), F.max(F.size("slots")).alias("n_slots"), changed.alias("reparameterised"))
            .filter(F.col("share") >= p.min_share)
            .select("key", "doc_id", F.col("item_id").cast("bigint").alias("item_id"), "share", "n_slots", "reparameterised"))
