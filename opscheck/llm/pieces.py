"""SentencePiece encoding by streaming Viterbi, and exact decoding.

The best segmentation under the summed scores of the pieces is found from left to
right. Only the part behind the last committed boundary is held: whenever all
surviving backpointer paths run through one boundary, the ids up to it are committed.
No piece of a usual vocabulary runs from another character into a word mark, so all
paths meet before every mark; the ids of the short words between marks are kept in a memo.

Characters outside the vocabulary are written as byte pieces; so is a word mark that
the text itself contains, which makes decoding exact.

Defined results: NULL and empty texts have no ids and decode to the empty text; of equally
good paths the one with the longer last piece wins; texts of any length are encoded
whole; repeated rows alike; a NULL doc_id stays NULL; further columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from opscheck.llm.common import TOKENIZERS, map_rows, texts

MARK = "▁"
_OWN_MARK = "\ud800"  # stands for a mark of the text itself; no text holds half a surrogate pair
_MEMO, _MEMO_WORD = 300_000, 48  # words of one of the two halves of the memo, characters of such a word


@dataclass(frozen=True)
class PieceParameters:
    model: str = f"{TOKENIZERS}/piece_bpe_32k.model"


class PieceCodec:
    """Ids of texts and texts of ids, for the bytes of a model file."""

    def __init__(self, content: bytes):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=content)
        size = model.get_piece_size()
        usual = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)
                                                or model.is_unused(i))]
        self.scores = {model.id_to_piece(i): (model.get_score(i), i) for i in usual}
        self.byte_ids = {int(model.id_to_piece(i)[1:-1], 16): i for i in range(size) if model.is_byte(i)}
        # by character: the score and id of the piece that ends there (none: a score that never wins) and the children
        self.trie: dict[str, tuple] = {}
        for piece, (score, i) in sorted(self.scores.items(), key=lambda x: len(x[0])):  # shorter pieces first
            children = self.trie
            for character in piece[:-1]:
                children = children.setdefault(character, (-np.inf, (), {}))[2]
            children[piece[-1]] = (score, (i,), children.get(piece[-1], (-np.inf, (), {}))[2])
        self.longest = max(map(len, self.scores))
        self.unknown = min(s for s, _ in self.scores.values()) - 10.0
        self.bytes_of = {i: p.replace(MARK, " ").encode() for p, (_, i) in self.scores.items()}
        self.bytes_of |= {i: bytes([b]) for b, i in self.byte_ids.items()}
        crossing = any(re.search(f"[^{MARK}]{MARK}", p) for p in self.scores)
        self.words = re.compile("(?s).+" if crossing else f"{MARK}*[^{MARK}]+|{MARK}+")
        self.memo: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}  # what the memo was when it was last full; what is used goes over

    def _ids(self, piece: str) -> list[int]:
        if piece in self.scores:
            return [self.scores[piece][1]]
        return [self.byte_ids[b] for b in (MARK if piece == _OWN_MARK else piece).encode()]

    def viterbi(self, text: str) -> Iterator[list[int]]:
        """Ids of ``text`` in order, a list for each committed stretch."""
        length, longest, unreached, root = len(text), self.longest, -np.inf, self.trie
        start, nothing = 0, (unreached, (), {})  # best and back: of the boundaries from ``start`` on
        best, back = [0.0] + [unreached] * min(length, 2 * longest), [0] * (min(length, 2 * longest) + 1)
        for begin in range(length):
            at = end = begin - start
            if at + longest >= len(best) and len(best) <= length - start:
                best += [unreached] * longest
                back += [0] * longest
            here = best[at]  # reached: every boundary is, from the one before it at the latest
            score, known, children = root.get(text[begin], nothing)
            if not known:
                score = self.unknown
            end += 1
            if here + score > best[end]:
                best[end], back[end] = here + score, begin
            for character in text[begin + 1:begin + longest]:
                if (node := children.get(character)) is None:
                    break
                score, known, children = node
                end += 1
                if here + score > best[end]:
                    best[end], back[end] = here + score, begin
            if (at + 1) % longest == 0 or begin == length - 1:
                boundary = length if begin == length - 1 else self._meeting(
                    back, start, [start + k for k in range(at + 1, len(best)) if best[k] > unreached])
                if boundary > start:
                    yield self._path(text, back, start, boundary)
                    base = best[boundary - start]
                    best = [x - base for x in best[boundary - start:]]
                    back, start = back[boundary - start:], boundary

    def _whole(self, word: str) -> tuple[int, ...]:
        """The ids that :meth:`viterbi` finds for a short ``word``, whose boundaries are all held until its end."""
        root, length = self.trie, len(word)
        best, back, ids = [0.0] + [-np.inf] * length, [0] * (length + 1), [()] * (length + 1)
        for begin in range(length):
            here, end = best[begin], begin + 1
            node = root.get(word[begin])
            if node is None or not node[1]:
                score, known, children = self.unknown, tuple(self._ids(word[begin])), node and node[2]
            else:
                score, known, children = node
            if (total := here + score) > best[end]:
                best[end], back[end], ids[end] = total, begin, known
            if children:
                for character in word[end:]:
                    if (node := children.get(character)) is None:
                        break
                    score, known, children = node
                    end += 1
                    if (total := here + score) > best[end]:
                        best[end], back[end], ids[end] = total, begin, known
        path, end = ids[length], back[length]
        while end:
            path, end = ids[end] + path, back[end]
        return path

    def _meeting(self, back: list[int], start: int, reached: list[int]) -> int:
        """The last boundary that the paths to all ``reached`` ones, which go on from there, run through."""
        open_ends = set(reached)
        while len(open_ends) > 1:
            last = max(open_ends)
            open_ends.remove(last)
            open_ends.add(max(start, back[last - start]))
        return open_ends.pop()

    def _path(self, text: str, back: list[int], start: int, boundary: int) -> list[int]:
        cuts = [boundary]
        while cuts[-1] > start:
            cuts.append(back[cuts[-1] - start])
        cuts.reverse()
        return [i for a, b in zip(cuts, cuts[1:], strict=False) for i in self._ids(text[a:b])]

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        marked = MARK + text.replace(MARK, _OWN_MARK).replace(" ", MARK)
        ids: list[int] = []
        memo, older = self.memo, self.older
        for word in self.words.findall(marked):
            known = memo.get(word)
            if known is None:
                if len(word) <= _MEMO_WORD:
                    known = older.get(word)
                    if known is None:
                        known = self._whole(word)
                    if len(memo) >= _MEMO:
                        self.older, self.memo = older, memo = memo, {}
                    memo[word] = known
                else:
                    known = [i for part in self.viterbi(word) for i in part]
            ids += known
        return ids

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode()[1:]


@lru_cache(maxsize=2)
def _codec(content: bytes) -> PieceCodec:
    """The codec of a Python worker; the tasks it runs one after the other share the memo."""
    return PieceCodec(content)


def encoded(docs: DataFrame, p: PieceParameters = PieceParameters()) -> DataFrame:
    """``ids`` of every text, their number, and ``exact``: whether decoding them gives the text again."""
    with open(p.model, "rb") as file:
        content = docs.sparkSession.sparkContext.broadcast(file.read())  # a model file, under 1 MB

    def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = _codec(content.value)
        for batch in batches:
            for low in range(0, len(batch), 1000):
                part = batch.iloc[low:low + 1000]
                ids = [codec.encode(t) for t in part["text"]]
                exact = [codec.decode(i) == t for i, t in zip(ids, part["text"], strict=True)]
                yield pd.DataFrame({"doc_id": part["doc_id"], "n_chars": part["text"].str.len(),
                                    "n_tokens": [len(i) for i in ids],
                                    "ids": [np.array(i, dtype=np.int32) for i in ids], "exact": exact})

    return map_rows(texts(docs), coded, "doc_id bigint, n_chars bigint, n_tokens bigint, ids array<int>, exact boolean")


def decoded(encoded_docs: DataFrame, p: PieceParameters = PieceParameters()) -> DataFrame:
    """``doc_id`` and ``text`` of rows with ``ids``; NULL ids give the empty text."""
    with open(p.model, "rb") as file:
        content = encoded_docs.sparkSession.sparkContext.broadcast(file.read())  # a model file, under 1 MB

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = _codec(content.value)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"],
                                "text": ["" if i is None else codec.decode(i) for i in batch["ids"]]})

    return map_rows(encoded_docs.select("doc_id", "ids"), read, "doc_id bigint, text string")
