"""Exact repeats across documents, found in a distributed suffix sort of hash-compared suffixes.

A byte is removed if a string of ``length`` bytes covers it that also starts in a document with
a smaller doc_id. Every such string is represented by the smallest hash among its shorter grams,
its anchor, so equal strings always meet under one anchor; neighbouring strings of a
text with the same anchor form a run. The steps are Spark shuffles:

1. texts are dealt into batches by a hash; a batch sends each of its anchors once to the anchor's bucket;
2. a bucket tells each batch which anchors occur in other batches too;
3. a batch sends the runs of shared anchors to the anchor's bucket, except those that an equal run of
   the batch in a smaller document already covers, so a passage of very many documents gives
   one run per batch;
4. a bucket unites equal runs, sorts the suffixes of the others by a mergesort whose comparisons
   find the common extension of two suffixes by binary search over prefix polynomial hashes, verifies
   equal neighbours byte by byte, and reports the covered stretches;
5. a batch removes what is covered.

Numbers of batches and buckets follow the bytes of the table, so neither grows with it.

Defined results: NULL and empty texts have no bytes; texts shorter than ``length`` are kept; rows with a
NULL doc_id count as after all others; rows of equal doc_id never remove from each other, and
repeated rows get equal results; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opscheck.llm.common import row_key, texts

_LAST = np.iinfo(np.int64).max
_BASE = 0x9E3779B97F4A7C15
_ANCHOR_BYTES = 6
_ANCHORS = np.uint64((1 << 48) - 1)
_PIECE = 64  # windows of a run at most; a periodic text would else be one long run
_BUFFER = 1 << 20
_SLICE = 300_000


@dataclass(frozen=True)
class RepeatParameters:
    length: int = 50
    gram: int = 20
    batch_bytes: int = 4 << 20
    bucket_bytes: int = 4 << 20


class Hashes:
    """Prefix polynomial hashes of a buffer; the hash of any stretch takes two look-ups."""

    _table = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    _powers = _inverses = np.empty(0, np.uint64)  # grown to the longest buffer of the process

    def __init__(self, buffer: np.ndarray):
        n = len(buffer)
        if len(Hashes._powers) <= n:
            Hashes._powers, Hashes._inverses = self._grown(_BASE, n + 1), self._grown(pow(_BASE, -1, 1 << 64), n + 1)
        self.inverse = Hashes._inverses
        self.sums = np.zeros(n + 1, np.uint64)
        np.multiply(self._table[buffer], Hashes._powers[:n], out=self.sums[1:])
        np.cumsum(self.sums, out=self.sums)

    @staticmethod
    def _grown(base: int, n: int) -> np.ndarray:
        out = np.full(n, base, np.uint64)
        out[0] = 1
        return np.cumprod(out, out=out)

    def of(self, starts, lengths) -> np.ndarray:
        return (self.sums[starts + lengths] - self.sums[starts]) * self.inverse[starts]

    def all(self, length: int) -> np.ndarray:
        """Well mixed hashes of every stretch of one length."""
        value = (self.sums[length:] - self.sums[:-length]) * self.inverse[:len(self.sums) - length]
        value = (value ^ (value >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        return value ^ (value >> np.uint64(29))


def _stretches(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of all bytes of some stretches, one after the other."""
    offsets = np.cumsum(lengths) - lengths
    return np.arange(lengths.sum()) + np.repeat(starts - offsets, lengths)


def _equal(buffer: np.ndarray, a: np.ndarray, b: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether the bytes of stretch ``a`` and stretch ``b`` are the same, per pair."""
    out = np.ones(len(a), bool)
    for low in range(0, len(a), 50_000):
        x, y, n = a[low:low + 50_000], b[low:low + 50_000], lengths[low:low + 50_000]
        same = buffer[_stretches(x, n)] == buffer[_stretches(y, n)]
        out[low:low + 50_000] = np.logical_and.reduceat(same, np.cumsum(n) - n)
    return out


@dataclass
class _Runs:
    """Runs of windows with one anchor: of which row, where, how many windows, hash of the bytes."""
    anchor: np.ndarray
    row: np.ndarray
    at: np.ndarray
    windows: np.ndarray
    digest: np.ndarray


def _windows_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, by doubling."""
    reach = 1
    minima = values
    while reach * 2 <= width:
        minima = np.minimum(minima[:-reach], minima[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(minima[:len(minima) - rest], minima[rest:]) if rest else minima


def _runs_of(contents: list[bytes], p: RepeatParameters) -> _Runs:
    """The runs of all texts of a batch; several texts share a buffer, no window crosses two."""
    parts: list[tuple] = []
    low = 0
    while low < len(contents):
        high, size = low + 1, len(contents[low])
        while high < len(contents) and size + len(contents[high]) <= _BUFFER:
            size += len(contents[high])
            high += 1
        buffer = np.frombuffer(b"".join(contents[low:high]), np.uint8)
        lengths = np.array([len(c) for c in contents[low:high]])
        if len(buffer) >= p.length:
            starts = np.cumsum(lengths) - lengths
            hashes = Hashes(buffer)
            anchors = _windows_minima(hashes.all(p.gram), p.length - p.gram + 1) & _ANCHORS
            row = np.repeat(np.arange(low, high), lengths)[:len(anchors)]
            inside = np.arange(len(anchors)) - starts[row - low]
            valid = inside + p.length <= lengths[row - low]
            first = np.concatenate(([True], (anchors[1:] != anchors[:-1]) | (row[1:] != row[:-1])))
            begin = np.maximum.accumulate(np.where(first, np.arange(len(anchors)), 0))
            first |= (np.arange(len(anchors)) - begin) % _PIECE == 0
            heads = np.flatnonzero(first & valid)
            number = np.cumsum(first)[heads]
            counts = np.bincount(np.cumsum(first)[valid], minlength=number[-1] + 1 if len(number) else 1)
            windows = counts[number]
            parts.append((anchors[heads], row[heads], inside[heads], windows, hashes.of(heads, windows + p.length - 1)))
        low = high
    if not parts:
        return _Runs(*[np.empty(0, t) for t in (np.uint64, np.int64, np.int64, np.int64, np.uint64)])
    return _Runs(*[np.concatenate(x) for x in zip(*parts, strict=True)])


def _classes(anchor, digest, windows, doc, buffer, starts, length) -> tuple[np.ndarray, np.ndarray]:
    """Order by anchor, content and document, and for each place the first of its class of equal, verified runs."""
    by_doc = np.arange(len(doc)) if (doc[1:] >= doc[:-1]).all() else np.argsort(doc, kind="stable")
    content = digest + windows.astype(np.uint64)
    order = by_doc[np.lexsort((content[by_doc], anchor[by_doc]))]
    a, d, w = anchor[order], content[order], windows[order]
    first = np.concatenate(([True], (a[1:] != a[:-1]) | (d[1:] != d[:-1]) | (w[1:] != w[:-1])))[:len(order)]
    head = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
    tested = np.flatnonzero(~first)
    wrong = tested[~_equal(buffer, starts[order[tested]], starts[order[head[tested]]], w[tested] + length - 1)] \
        if len(tested) else tested
    head[wrong] = wrong  # a collision: on its own; its windows are compared with all others later
    return order, head


class _Batch:
    """The texts of a batch in a fixed order, and what they cover among themselves."""

    def __init__(self, frame: pd.DataFrame, p: RepeatParameters):
        self.frame = frame.sort_values(["rank", "key"], kind="stable", ignore_index=True)
        self.contents = [t.encode() for t in self.frame["text"]]
        self.rank = self.frame["rank"].to_numpy(np.int64)
        self.runs = runs = _runs_of(self.contents, p)
        self.buffer = np.frombuffer(b"".join(self.contents), np.uint8)
        lengths = np.array([len(c) for c in self.contents])
        self.starts = (np.cumsum(lengths) - lengths)[runs.row] + runs.at
        doc = self.rank[runs.row]
        order, head = _classes(runs.anchor, runs.digest, runs.windows, doc, self.buffer, self.starts, p.length)
        self.covered = np.zeros(len(order), bool)
        self.covered[order] = doc[order] > doc[order[head]]
        by_anchor, docs = runs.anchor[order], doc[order]
        first = np.concatenate(([True], by_anchor[1:] != by_anchor[:-1]))[:len(order)]
        group = np.cumsum(first) - 1
        heads = np.flatnonzero(first)
        several = (np.minimum.reduceat(docs, heads) < np.maximum.reduceat(docs, heads)) if len(heads) else heads.astype(bool)
        self.anchors = by_anchor[heads]
        self.within = np.zeros(len(order), bool)  # the anchor occurs in several documents of the batch
        self.within[order] = several[group]


def _packed(anchors: np.ndarray) -> bytes:
    return np.ascontiguousarray(anchors.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_ANCHOR_BYTES]).tobytes()


def _unpacked(content: bytes) -> np.ndarray:
    out = np.zeros((len(content) // _ANCHOR_BYTES, 8), np.uint8)
    out[:, :_ANCHOR_BYTES] = np.frombuffer(content, np.uint8).reshape(-1, _ANCHOR_BYTES)
    return out.view("<u8").ravel()


def _split(values: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Places of every distinct value."""
    order = np.argsort(values, kind="stable")
    cuts = np.flatnonzero(np.diff(values[order])) + 1
    return [(int(values[part[0]]), part) for part in np.split(order, cuts) if len(part)]


def _common(hashes: Hashes, x: np.ndarray, y: np.ndarray, length: int) -> np.ndarray:
    """Common extension of suffixes ``x`` and ``y`` up to ``length`` bytes, by binary search over prefix hashes."""
    low, high = np.zeros(len(x), np.int64), np.full(len(x), length, np.int64)
    while (low < high).any():
        middle = (low + high + 1) // 2
        same = hashes.of(x, middle) == hashes.of(y, middle)
        low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
    return low


def suffix_sort(buffer: np.ndarray, hashes: Hashes, starts: np.ndarray, group: np.ndarray, length: int) -> np.ndarray:
    """Order of the suffixes at ``starts`` by group and their first ``length`` bytes.

    Suffixes are dealt by group and first eight bytes; those equal in both are merge-sorted from
    the bottom up. In a merge, every suffix finds its rank among the other half's by binary search.
    """
    key = np.zeros(len(starts), np.uint64)
    for k in range(8):
        key = (key << np.uint64(8)) | buffer[starts + k]
    order = np.lexsort((key, group))
    g, k = group[order], key[order]
    first = np.concatenate(([True], (g[1:] != g[:-1]) | (k[1:] != k[:-1])))[:len(order)]
    begin = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
    size = np.bincount(np.cumsum(first) - 1)[np.cumsum(first) - 1]
    width = 1
    while (active := np.flatnonzero(size > width)).size:
        place = active - begin[active]
        block = place // width
        other = (block ^ 1) * width
        count = np.clip(size[active] - other, 0, width)
        low, high = np.zeros(len(active), np.int64), count.copy()
        mine, left = starts[order[active]], block % 2 == 0
        while (open_ := np.flatnonzero(low < high)).size:
            middle = (low[open_] + high[open_]) // 2
            theirs = starts[order[begin[active[open_]] + other[open_] + middle]]
            own = mine[open_]
            common = _common(hashes, theirs, own, length)
            ended = common >= length
            at = np.minimum(common, length - 1)
            before = np.where(ended, ~left[open_], buffer[theirs + at] < buffer[own + at])
            low[open_] = np.where(before, middle + 1, low[open_])
            high[open_] = np.where(before, high[open_], middle)
        target = begin[active] + np.minimum(block, block ^ 1) * width + place - block * width + low
        merged = order.copy()
        merged[target] = order[active]
        order = merged
        width *= 2
    return order


def _covered_windows(buffer, starts, windows, group, doc, length) -> tuple[np.ndarray, np.ndarray]:
    """Run and offset of the windows that also occur in a run of a smaller document and the same group."""
    run = np.repeat(np.arange(len(starts)), windows)
    at = _stretches(starts, windows)
    hashes = Hashes(buffer)
    order = suffix_sort(buffer, hashes, at, group[run], length)
    a, g = at[order], group[run][order]
    same = (g[1:] == g[:-1]) & (_common(hashes, a[1:], a[:-1], length) >= length) if len(a) else np.empty(0, bool)
    joined = np.flatnonzero(same)
    if len(joined) and not _equal(buffer, a[joined], a[joined + 1], np.full(len(joined), length)).all():
        # a collision: sort by the bytes themselves
        order = np.lexsort((*[buffer[at + k] for k in reversed(range(length))], group[run]))
        a, g = at[order], group[run][order]
        same = g[1:] == g[:-1]
        for k in range(length):
            same &= buffer[a[1:] + k] == buffer[a[:-1] + k]
    first = np.flatnonzero(np.concatenate(([True], ~same)))
    docs = doc[run][order]
    least = np.repeat(np.minimum.reduceat(docs, first), np.diff(np.append(first, len(order))))
    hit = order[docs > least]
    return run[hit], at[hit] - starts[run[hit]]


_RUN_COLUMNS = "bucket bigint, batch bigint, anchors binary, docs binary, rows binary, ats binary, windows binary, data binary"
_SPAN_COLUMNS = "batch bigint, rows binary, starts binary, ends binary"


def _joined_runs(frame: pd.DataFrame):
    def column(name, kind):
        return np.frombuffer(b"".join(frame[name]), kind)

    anchor = np.concatenate([_unpacked(x) for x in frame["anchors"]])
    batch = np.repeat(frame["batch"].to_numpy(), [len(x) // 8 for x in frame["docs"]])
    return (batch, anchor, column("docs", np.int64), column("rows", np.int32), column("ats", np.int32),
            column("windows", np.uint8).astype(np.int64), column("data", np.uint8))


def _bucket_spans(frame: pd.DataFrame, p: RepeatParameters) -> pd.DataFrame:
    """Step 4: what the runs of one bucket cover, per batch."""
    batch, anchor, doc, row, at, windows, buffer = _joined_runs(frame)
    lengths = windows + p.length - 1
    starts = np.cumsum(lengths) - lengths
    digest = Hashes(buffer).of(starts, lengths)
    order, head = _classes(anchor, digest, windows, doc, buffer, starts, p.length)
    whole = order[doc[order] > doc[order[head]]]
    spans = [(whole, np.zeros(len(whole), np.int64), windows[whole])]

    is_head = head == np.arange(len(order))
    heads = order[is_head]
    group_first = np.concatenate(([True], anchor[heads][1:] != anchor[heads][:-1]))[:len(heads)]
    group = np.cumsum(group_first) - 1
    mixed = heads[np.bincount(group)[group] > 1] if len(heads) else heads
    mixed_group = group[np.bincount(group)[group] > 1] if len(heads) else group
    members = np.flatnonzero(~is_head & (doc[order] == doc[order[head]]))  # of the same document as their head
    low = 0
    ends = np.cumsum(windows[mixed]) if len(mixed) else np.empty(0, np.int64)
    while low < len(mixed):
        high = int(np.searchsorted(ends, (ends[low - 1] if low else 0) + _SLICE, "right"))
        high = max(high, low + 1)
        high = int(np.searchsorted(mixed_group, mixed_group[high - 1], "right"))  # groups stay whole
        part = mixed[low:high]
        local = np.cumsum(lengths[part]) - lengths[part]
        run, offset = _covered_windows(buffer[_stretches(starts[part], lengths[part])], local, windows[part],
                                       mixed_group[low:high], doc[part], p.length)
        spans.append((part[run], offset, np.ones(len(run), np.int64)))
        low = high
    run, offset, count = (np.concatenate(x) for x in zip(*spans, strict=True))
    if len(members):  # what a head's windows met holds for equal runs of its document
        of_head = np.argsort(run, kind="stable")
        first, last = (np.searchsorted(run[of_head], order[head[members]], side) for side in ("left", "right"))
        copies = of_head[_stretches(first, last - first)] if (last > first).any() else of_head[:0]
        run = np.concatenate((run, np.repeat(order[members], last - first)))
        offset, count = np.concatenate((offset, offset[copies])), np.concatenate((count, count[copies]))
    begin = at[run] + offset
    out = [(b, row[run[x]].astype(np.int32).tobytes(), begin[x].astype(np.int32).tobytes(),
            (begin[x] + count[x] + p.length - 1).astype(np.int32).tobytes())
           for b, x in _split(batch[run])]
    return pd.DataFrame(out, columns=["batch", "rows", "starts", "ends"])


def _united(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Overlapping or touching stretches, united."""
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    cut = np.flatnonzero(np.concatenate(([True], starts[1:] > reach[:-1])))
    return list(zip(starts[cut].tolist(), reach[np.append(cut[1:] - 1, len(reach) - 1)].tolist(), strict=True))


def repeated_spans(docs: DataFrame, p: RepeatParameters = RepeatParameters(), kept_text: bool = False) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` and ``starts``/``ends`` of the removed bytes, per row.

    With ``kept_text`` the remaining bytes come along as ``kept``.
    """
    rows = texts(docs)
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_batches, n_buckets = total // p.batch_bytes + 1, total // p.bucket_bytes + 1
    keyed = rows.select(F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(int(_LAST))).alias("rank"),
                        row_key().alias("key"), "text").withColumn("batch", F.pmod(F.xxhash64("key"), F.lit(n_batches)))
    batches = keyed.groupBy("batch")

    def anchors(frame: pd.DataFrame) -> pd.DataFrame:
        found = _Batch(frame, p).anchors
        return pd.DataFrame([(k, frame["batch"].iloc[0], _packed(found[x])) for k, x in _split(found % np.uint64(n_buckets))],
                            columns=["bucket", "batch", "anchors"])

    def shared(frame: pd.DataFrame) -> pd.DataFrame:
        own = [_unpacked(x) for x in frame["anchors"]]
        values, counts = np.unique(np.concatenate(own), return_counts=True)
        several = values[counts > 1]
        return pd.DataFrame({"batch": frame["batch"], "anchors": [
            _packed(x[np.isin(x, several, assume_unique=True)]) for x in own]})

    def runs(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        columns = ["bucket", "batch", "anchors", "docs", "rows", "ats", "windows", "data"]
        if not len(left):
            return pd.DataFrame(columns=columns)
        batch = _Batch(left, p)
        elsewhere = np.concatenate([_unpacked(x) for x in right["anchors"]]) if len(right) else np.empty(0, np.uint64)
        r = batch.runs
        sent = np.flatnonzero(~batch.covered & (batch.within | np.isin(r.anchor, elsewhere)))
        out = []
        for k, x in _split(r.anchor[sent] % np.uint64(n_buckets)):
            x = sent[x]
            data = batch.buffer[_stretches(batch.starts[x], r.windows[x] + p.length - 1)]
            out.append((k, left["batch"].iloc[0], _packed(r.anchor[x]), batch.rank[r.row[x]].tobytes(),
                        r.row[x].astype(np.int32).tobytes(), r.at[x].astype(np.int32).tobytes(),
                        r.windows[x].astype(np.uint8).tobytes(), data.tobytes()))
        return pd.DataFrame(out, columns=columns)

    def removed(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        columns = ["rank", "no_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "starts", "ends", "kept"]
        if not len(left):
            return pd.DataFrame(columns=columns)
        batch = _Batch(left, p)
        r, own = batch.runs, np.flatnonzero(batch.covered)
        row = np.concatenate([r.row[own], *[np.frombuffer(x, np.int32) for x in right["rows"]]]).astype(np.int64)
        begin = np.concatenate([r.at[own], *[np.frombuffer(x, np.int32) for x in right["starts"]]])
        end = np.concatenate([r.at[own] + r.windows[own] + p.length - 1, *[np.frombuffer(x, np.int32) for x in right["ends"]]])
        spans = {k: _united(begin[x], end[x]) for k, x in _split(row)}
        out = []
        for k, content in enumerate(batch.contents):
            cuts, at, kept = spans.get(k, []), 0, []
            for s, e in cuts:
                kept.append(content[at:s])
                at = e
            rest = b"".join([*kept, content[at:]])
            out.append((len(content), len(content) - len(rest), len(cuts), hashlib.sha256(rest).hexdigest(),
                        [s for s, _ in cuts], [e for _, e in cuts], rest if kept_text else None))
        result = pd.DataFrame(out, columns=columns[2:])
        return pd.concat([batch.frame[["rank", "no_id"]], result], axis=1)

    sent = batches.applyInPandas(anchors, "bucket bigint, batch bigint, anchors binary")
    told = sent.groupBy("bucket").applyInPandas(shared, "batch bigint, anchors binary")
    moved = batches.cogroup(told.groupBy("batch")).applyInPandas(runs, _RUN_COLUMNS)
    spans = moved.groupBy("bucket").applyInPandas(lambda frame: _bucket_spans(frame, p), _SPAN_COLUMNS)
    result = batches.cogroup(spans.groupBy("batch")).applyInPandas(
        removed, "rank bigint, no_id boolean, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, "
                 "starts array<bigint>, ends array<bigint>, kept binary")
    return result.select(F.when(~F.col("no_id"), F.col("rank")).alias("doc_id"), "n_bytes", "n_removed", "n_spans",
                         "kept_sha256", "starts", "ends", *(["kept"] if kept_text else []))
