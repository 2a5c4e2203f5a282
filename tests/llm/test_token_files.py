"""Files of token ids against the library's own encoding."""

from __future__ import annotations

import random
import sys
import uuid
import zlib

import numpy as np
import pytest

from opscheck.llm.common import TOKENIZERS
from opscheck.llm.token_files import (
    TokenCodec,
    TokenParameters,
    read_documents,
    read_token_files,
    token_checksums,
    write_token_files,
)
from opscheck.session import checkpoint_folder

SCHEMA = "doc_id long, text string, key string, frame string, n_tokens int, shard int, salt string"
MODEL = f"{TOKENIZERS}/byte_bpe_50k.json"
AWKWARD = ["", " ", "  ", "a", " a", "a ", "a  b", "a \n b", "a\n\n  b \t c", "don't  I'll’s 12 3½", "x y  z", "<|endoftext|>",
           "a <|endoftext|> b", "日本語 のテスト 한국", "é́ ñ", "\x00\x1c \x1d a\x1f", "a\x85 \x85b", "🙂 🙂🙂x", "​ z", "w" * 5000, "a b " * 3000]


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(MODEL)


def test_stretches_have_the_ids_of_the_library():
    own, codec = library(), TokenCodec(open(MODEL, encoding="utf-8").read())
    r = random.Random(2)
    alphabet = [chr(c) for c in range(0x250)] + [chr(r.randrange(0x250, 0x30000)) for _ in range(500)]
    texts = AWKWARD + ["".join(r.choice(alphabet if r.random() < .5 else " ab'\n\t1.é") for _ in range(r.randint(0, 60))) for _ in range(4000)]
    texts = [t for t in texts if not any(0xd800 <= ord(c) < 0xe000 for c in t)]
    for text in texts:
        assert np.frombuffer(codec.encode(text), "<u2").tolist() == own.encode(text, add_special_tokens=False).ids, repr(text)
    assert codec.apart


def test_every_space_and_letter_is_split_as_in_the_library():
    own, codec = library(), TokenCodec(open(MODEL, encoding="utf-8").read())
    for c in [*range(0xd800), *range(0xe000, sys.maxunicode, 97)][::7]:
        x = f"a{chr(c)} {chr(c)}b 1{chr(c)}  {chr(c)} "
        assert np.frombuffer(codec.encode(x), "<u2").tolist() == own.encode(x, add_special_tokens=False).ids, hex(c)


def written(spark, rows, p=TokenParameters()):
    path = f"{checkpoint_folder(spark)}/tokens-{uuid.uuid4().hex}"
    write_token_files(spark.createDataFrame(rows, SCHEMA), path, p)
    return path


def by_hand(rows):
    import hashlib

    own, out, start = library(), [], 0
    for i, text in sorted(((r[0], r[1] or "") for r in rows),
                          key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(r[1].encode()).hexdigest())):
        ids = [*own.encode(text, add_special_tokens=False).ids, 2]
        out.append((i, start, len(ids), ids))
        start += len(ids)
    return out


def sample():
    r = random.Random(1)
    rows = [(i, t, "k", "f", 1, 2, "s") for i, t in enumerate(AWKWARD)]
    rows += [(r.randint(-50, 10**15), " ".join(r.choice(["alpha", "beta,", "gamma."]) for _ in range(r.randint(0, 80))), *[None] * 5) for _ in range(200)]
    return rows + [(None, None, *[None] * 5), (None, "x", *[None] * 5), (3, "b", *[None] * 5), (3, "a", *[None] * 5)] + rows[-2:] * 2


@pytest.mark.parametrize("p", [TokenParameters(), TokenParameters(container_bytes=500, shard_bytes=4000, sample=50, sample_bytes=300, dictionary_bytes=512)])
def test_round_trip(spark, p):
    rows = sample()
    path, want = written(spark, rows, p), by_hand(rows)
    got = [(x.doc_id, x.start, x.n_tokens, list(x.ids)) for x in read_token_files(spark, path).collect()]
    assert sorted(got, key=lambda x: x[1]) == want
    sums = {(x.start, x.doc_id, x.n_tokens, x.ids_crc32) for x in token_checksums(spark, path).collect()}
    assert sums == {(s, i, n, zlib.crc32(np.array(ids, "<u4").tobytes())) for i, s, n, ids in want}
    containers = spark.read.parquet(f"{path}/containers")
    assert (containers.count() > 20) == (p.container_bytes == 500)


def test_short_documents_are_read_alone(spark):
    rows = sample()
    path = written(spark, rows, TokenParameters(container_bytes=500, shard_bytes=4000))
    wanted = [3, 5, 10**18, rows[40][0]]
    got = sorted(((x.doc_id, x.start, x.n_tokens, list(x.ids)) for x in read_documents(spark, path, wanted).collect()), key=lambda x: x[1])
    assert got == [x for x in by_hand(rows) if x[0] in wanted]
    assert read_documents(spark, path, []).count() == 0


def test_another_dictionary_is_refused(spark):
    path = written(spark, sample())
    other = spark.createDataFrame([(b"x" * 32, bytearray(b"abcdefghij"), 2)], "hash binary, content binary, width int")
    other.write.mode("overwrite").parquet(f"{path}/dictionary")
    with pytest.raises(Exception, match="another dictionary"):
        token_checksums(spark, path).collect()


def test_empty_table(spark):
    path = written(spark, [])
    assert read_token_files(spark, path).count() == 0 and token_checksums(spark, path).count() == 0
