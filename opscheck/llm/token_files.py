"""Files of token ids: one small compressed frame per document, with a shared dictionary and an offset index.

Every text is encoded with a vocabulary of the tokenizers library and gets the end id. Its ids, serialised as
little-endian integers of the vocabulary's width, are compressed on their own by zstandard with a dictionary that
was trained on serialised ids of a bounded sample, so that also a short document is small and can be read alone.

Written below a path (all by Spark's Parquet writer, which any store and any lost executor is fine with):

* ``dictionary``: one row, the dictionary's bytes and their hash;
* ``containers``: rows of binary containers in the order of doc_id. A container holds a header (magic, version, id
  width, number of documents, dictionary hash, ids before it in its shard), the index (doc_id, whether it is NULL,
  number of ids and end offset of every document) and the frames. Beside it stand its shard, its place there and its
  first and last doc_id, by which a reader finds it without opening others.

Documents are dealt to shards by ranges of doc_id after compression, so only frames travel. The ids before a document
are those before it in its shard, known when the container is written, plus those of the shards before, a sum over one row per shard.

The dictionary is trained on at most ``sample`` documents of at most ``sample_bytes`` bytes each, chosen by a
hash of doc_id and text; a sample too small for training serves as the dictionary itself.

Defined results: NULL and empty texts have the end id only; NULL doc_ids come first; equal doc_ids stand in the order of
their texts' digests, repeated rows one after another; a text of any length is one frame; an empty
table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import struct
import sys
import zlib
from array import array
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from opscheck.llm.common import TOKENIZERS, map_rows, texts
from opscheck.operators.keyed import probe
from opscheck.operators.ranking import ranges
from opscheck.session import stored

_MAGIC, _VERSION = b"TOKIDS", 1
_HEADER = "<6sBBQ32sQ"
_INDEX = np.dtype([("doc_id", "<i8"), ("is_null", "u1"), ("n_tokens", "<u8"), ("end", "<u8")])
_MEMO = 200_000  # words, twice that number at most


@dataclass(frozen=True)
class TokenParameters:
    tokenizer: str = f"{TOKENIZERS}/byte_bpe_50k.json"
    end_id: int = 2
    level: int = 3
    dictionary_bytes: int = 65_536
    sample: int = 1000
    sample_bytes: int = 16_384
    container_bytes: int = 4 << 20  # of frames; a longer frame has a container of its own
    shard_bytes: int = 64 << 20


class _Memo(dict):
    """Values of short texts, in two halves: a full one becomes the older half, which is looked up before a value is made."""

    def __init__(self, make: Callable[[str], bytes], most: int):
        super().__init__()
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, text: str) -> bytes:
        found = self.older.get(text)
        return self.keep(text, self.make(text) if found is None else found)

    def keep(self, text: str, value: bytes) -> bytes:
        if len(text) <= 40:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[text] = value
        return value


class _AfterSpace(_Memo):
    """The ids of stretches after a space; those that are no word are kept apart until they come again."""

    codec: TokenCodec

    def __missing__(self, text: str) -> bytes:
        value = self.older.get(text)
        if value is None:
            if text.isalpha():  # letters in the sense of the pattern
                value = self.make(text)
            else:
                mixed = self.codec.mixed
                value = mixed.get(text) or mixed.older.get(text)
                if value is None:
                    return mixed.keep(text, mixed.make(text))
        return self.keep(text, value)


class TokenCodec:
    """Serialised ids of texts, for the content of a tokenizers file.

    A byte-level vocabulary without prefix space treats the stretches before spaces that a visible character
    follows apart from each other, and within them the matches of its pattern. The library's model makes the ids of each match, and
    those of words are kept. For any other kind of vocabulary the library encodes whole texts.
    """

    def __init__(self, content: str, settings: str | None = None):
        import regex
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.library = Tokenizer.from_str(content)
        self.model, self.width = self.library.model, 2 if self.library.get_vocab_size() < 1 << 16 else 4
        self.kind = "H" if self.width == 2 else "I"
        described = json.loads(settings or _settings(content))
        split = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        self.apart = described.get("normalizer") is None and all((described.get("pre_tokenizer") or {}).get(k) == v for k, v in split.items())
        self.special = [x["content"] for x in described.get("added_tokens", [])]
        # fixed value: the pattern of byte-level vocabularies
        self.pattern = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
        self.visible = _byte_characters()
        self.space = chr(self.visible[0x20])
        self.words = _AfterSpace(self._after_space, _MEMO)
        self.words.codec = self
        self.matches = _Memo(self.of_match, _MEMO // 8)
        self.mixed = _Memo(self._mixed, _MEMO // 8)

    def _serialised(self, ids: list[int]) -> bytes:
        made = array(self.kind, ids)
        if sys.byteorder == "big":
            made.byteswap()
        return made.tobytes()

    def of_match(self, match: str) -> bytes:
        """The ids of one match of the pattern, by the library's model."""
        shown = match.encode().decode("latin-1").translate(self.visible)
        return self._serialised([t.id for t in self.model.tokenize(shown)])

    def _after_space(self, word: str) -> bytes:
        """The ids of a word after a space; ASCII letters stand for themselves."""
        shown = word if word.isascii() else word.encode().decode("latin-1").translate(self.visible)
        return self._serialised([t.id for t in self.model.tokenize(self.space + shown)])

    def _mixed(self, text: str) -> bytes:
        """The ids of a stretch after a space that is no word, most often a word and marks."""
        word = text.rstrip(_PLAIN)
        if word != text and word.isalpha():
            return self.words[word] + self.matches[text[len(word):]]
        if text[-1:] in _MARKS and text[:-1].isalpha():
            return self.words[text[:-1]] + self.matches[text[-1]]
        return self.of_stretch(" " + text)

    def of_stretch(self, text: str) -> bytes:
        return b"".join([self.words[m[1:]] if m[0] == " " and m[1:].isalpha() else self.matches[m] for m in self.pattern.findall(text)])

    def encode(self, text: str) -> bytes:
        if not self.apart or any(x in text for x in self.special):
            return self._serialised(self.library.encode(text, add_special_tokens=False).ids)
        first, *others = _STRETCHES.split(text) if _OPEN_SPACE.search(text) else text.split(" ")
        return self.of_stretch(first) + b"".join(map(self.words.__getitem__, others))


_MARKS = frozenset(".,;:!?)\"\n")
_PLAIN = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"  # marks that are one match of the pattern together
_STRETCHES, _OPEN_SPACE = re.compile(r" (?=\S)"), re.compile(r" (?:\s|\Z)")


def _byte_characters() -> dict[int, int]:
    """The characters that stand for bytes in byte-level vocabularies: visible ones for themselves, the others from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in own]
    return {b: b for b in own} | {b: 256 + k for k, b in enumerate(others)}


def _settings(content: str) -> str:
    """What a tokenizers file says beside its model, which is most of it and which only the library needs."""
    described = json.loads(content)
    described.pop("model", None)
    return json.dumps(described)


@lru_cache(maxsize=1)
def _codec(content: str, settings: str) -> TokenCodec:
    return TokenCodec(content, settings)


def _dictionary(content: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(content) if content else None


def trained_dictionary(samples: Sequence[bytes], size: int) -> bytes:
    """A zstandard dictionary; a sample that is too small for training is the dictionary itself."""
    import zstandard

    joined = b"".join(samples)
    if len(joined) > 8 * size:
        try:
            return zstandard.train_dictionary(size, list(samples)).as_bytes()
        except zstandard.ZstdError:
            pass
    return joined[:size] if len(joined) >= 8 else b""


def _sampled(docs: DataFrame, p: TokenParameters) -> DataFrame:
    """At most ``sample`` short documents, by a hash of doc_id and text, so that no doc_id of many rows fills the sample."""
    short = docs.select("text", F.xxhash64("doc_id", "text").alias("hash")).filter(
        F.octet_length("text").between(1, p.sample_bytes))
    every = max(1, docs.count() // (4 * p.sample))  # keeps most texts from being sent on
    return short.filter(F.pmod("hash", F.lit(every)) == 0).orderBy("hash", "text").limit(p.sample).select("text")


def write_token_files(docs: DataFrame, path: str, p: TokenParameters = TokenParameters()) -> None:
    """Write ``dictionary`` and ``containers`` of all texts below ``path``."""
    spark = docs.sparkSession
    with open(p.tokenizer, encoding="utf-8") as file:
        content = file.read()  # a vocabulary file of a few MB
    rows = texts(docs)
    codec = TokenCodec(content)
    dictionary = trained_dictionary([codec.encode(r.text) for r in _sampled(rows, p).collect()], p.dictionary_bytes)
    digest = hashlib.sha256(dictionary).digest()
    spark.createDataFrame([(digest, bytearray(dictionary), codec.width)], "hash binary, content binary, width int").coalesce(1).write.parquet(f"{path}/dictionary")
    width = codec.width
    model = spark.sparkContext.broadcast((content, _settings(content), dictionary))

    def compress(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        content, settings, dictionary = model.value
        codec, shared = _codec(content, settings), _dictionary(dictionary)
        pack = zstandard.ZstdCompressor(level=p.level, dict_data=shared, write_content_size=True, write_checksum=True)
        end = p.end_id.to_bytes(codec.width, "little")
        for batch in batches:
            for low in range(0, len(batch), 500):
                part = batch.iloc[low:low + 500]
                ids = [codec.encode(t) + end for t in part["text"]]
                yield pd.DataFrame({"doc_id": part["doc_id"], "key": part["key"], "n_tokens": [len(i) // codec.width for i in ids],
                                    "frame": [pack.compress(i) for i in ids]})

    frames = stored(map_rows(rows.withColumn("key", F.md5("text")), compress, "doc_id bigint, key string, n_tokens bigint, frame binary")
                    .withColumn("salt", F.xxhash64(F.monotonically_increasing_id())))
    size = frames.agg(F.coalesce(F.sum(F.octet_length("frame") + 32), F.lit(0))).first()[0]  # a number
    order = [F.asc_nulls_first("doc_id"), F.col("key"), F.col("salt")]
    dealt = ranges(frames, order, max(1, -(-size // p.shard_bytes))).select(
        F.spark_partition_id().alias("shard"), "doc_id", "n_tokens", "frame")

    def contain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_rows, held, before, place, shard = [], 0, 0, 0, 0

        def container() -> pd.DataFrame:
            nonlocal before, place
            index = np.zeros(len(open_rows), dtype=_INDEX)
            index["doc_id"] = [int(r[0]) if r[0] is not None else 0 for r in open_rows]
            index["is_null"] = [r[0] is None for r in open_rows]
            index["n_tokens"] = [r[1] for r in open_rows]
            index["end"] = np.cumsum([len(r[2]) for r in open_rows])
            header = struct.pack(_HEADER, _MAGIC, _VERSION, width, len(open_rows), digest, before)
            n = int(index["n_tokens"].sum())
            known = [int(r[0]) for r in open_rows if r[0] is not None]
            made = pd.DataFrame({"shard": [shard], "place": [place], "first_id": [str(known[0]) if known else None],
                                 "last_id": [str(known[-1]) if known else None], "n_docs": [len(open_rows)], "n_tokens": [n],
                                 "content": [b"".join((header, index.tobytes(), *(r[2] for r in open_rows)))]})
            before, place = before + n, place + 1
            open_rows.clear()
            return made

        for batch in batches:
            if len(batch):
                shard = int(batch["shard"].iloc[0])
            for row in zip(batch["doc_id"], batch["n_tokens"], batch["frame"], strict=True):
                if open_rows and held + len(row[2]) > p.container_bytes:
                    yield container()
                    held = 0
                open_rows.append(row)
                held += len(row[2]) + _INDEX.itemsize
        if open_rows:
            yield container()

    packed = dealt.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(
        contain, "shard int, place bigint, first_id string, last_id string, n_docs bigint, n_tokens bigint, content binary")
    (packed.withColumns({c: F.col(c).cast("bigint") for c in ("first_id", "last_id")})
     .write.option("compression", "uncompressed").parquet(f"{path}/containers"))


def _opened(content: bytes, digest: bytes) -> tuple[int, int, np.ndarray, int]:
    """Width of the ids, ids before the container in its shard, index, and where the frames begin."""
    magic, version, width, n, hash_, before = struct.unpack_from(_HEADER, content)
    if magic != _MAGIC or version != _VERSION:
        raise ValueError("not a container of token ids")
    if hash_ != digest:
        raise ValueError("the container was written with another dictionary")
    index = np.frombuffer(content, dtype=_INDEX, count=n, offset=struct.calcsize(_HEADER))
    return width, before, index, struct.calcsize(_HEADER) + index.nbytes


def _read(spark: SparkSession, path: str, containers: DataFrame, of: Callable[[np.ndarray], object], kind: str,
          wanted: Sequence[int] | None = None) -> DataFrame:
    """A row per document with ``of`` its ids, as ``value``, and its start in its shard."""
    stored_dictionary = spark.read.parquet(f"{path}/dictionary").first()  # one row of bounded size
    model = spark.sparkContext.broadcast((bytes(stored_dictionary["hash"]), bytes(stored_dictionary["content"])))
    asked = None if wanted is None else frozenset(wanted)

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        digest, dictionary = model.value
        reader = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))
        for batch in batches:
            for shard, content in zip(batch["shard"], batch["content"], strict=True):
                width, before, index, first = _opened(content, digest)
                starts = before + np.concatenate(([0], np.cumsum(index["n_tokens"])[:-1])).astype("i8")
                begins = np.concatenate(([0], index["end"][:-1])).astype("i8") + first
                view = memoryview(content)
                chosen = [k for k in range(len(index)) if asked is None or (not index["is_null"][k] and int(index["doc_id"][k]) in asked)]
                for low in range(0, len(chosen), 500):
                    part = chosen[low:low + 500]
                    ids = [np.frombuffer(reader.decompress(view[begins[k]:first + int(index["end"][k])]), dtype=f"<u{width}") for k in part]
                    if any(len(i) != index["n_tokens"][k] for i, k in zip(ids, part, strict=True)):
                        raise ValueError("a frame does not hold the number of ids that the index states")
                    yield pd.DataFrame({"doc_id": [None if index["is_null"][k] else str(index["doc_id"][k]) for k in part],
                                        "shard": int(shard), "in_shard": starts[part], "n_tokens": [len(i) for i in ids],
                                        "value": [of(i) for i in ids]})

    rows = containers.select("shard", "content").mapInPandas(
        unpack, f"doc_id string, shard int, in_shard bigint, n_tokens bigint, value {kind}")
    return rows.withColumn("doc_id", F.col("doc_id").cast("bigint"))


def _shard_starts(containers: DataFrame) -> DataFrame:
    sums = containers.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    return sums.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_start"))


def _placed(rows: DataFrame, containers: DataFrame) -> DataFrame:
    joined = probe(rows, _shard_starts(containers), "shard")
    return joined.withColumn("start", F.col("shard_start") + F.col("in_shard")).drop("shard", "shard_start", "in_shard")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id``, ``start`` (ids of all documents before it), ``n_tokens`` and ``ids`` of every document."""
    containers = spark.read.parquet(f"{path}/containers")
    rows = _read(spark, path, containers, lambda ids: ids.astype("i4"), "array<int>")
    return _placed(rows, containers).select("doc_id", "start", "n_tokens", F.col("value").alias("ids"))


def read_documents(spark: SparkSession, path: str, doc_ids: Sequence[int]) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens`` and ``ids`` of some documents.

    Containers are chosen by their first and last doc_id, which the scan compares with its statistics; in a container
    the index gives the frames, and no other frame is decompressed.
    """
    containers = spark.read.parquet(f"{path}/containers")
    ids = sorted(set(doc_ids))
    if not ids:
        return read_token_files(spark, path).limit(0)
    meets = F.exists(F.array(*map(F.lit, ids)), lambda i: i.between(F.col("first_id"), F.col("last_id")))
    near = containers.filter((F.col("last_id") >= ids[0]) & (F.col("first_id") <= ids[-1]) & meets)
    rows = _read(spark, path, near, lambda found: found.astype("i4"), "array<int>", ids)
    return _placed(rows, containers).select("doc_id", "start", "n_tokens", F.col("value").alias("ids"))


def token_checksums(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens`` and the CRC-32 of every document's ids as little-endian 32-bit integers."""
    containers = spark.read.parquet(f"{path}/containers")
    rows = _read(spark, path, containers, lambda ids: zlib.crc32(ids.astype("<u4").tobytes()), "bigint")
    return _placed(rows, containers).select("doc_id", "start", "n_tokens", F.col("value").alias("ids_crc32"))
