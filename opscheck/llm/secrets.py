"""Secret scans: fixed patterns, and random strings by their token efficiency.

Ordinary words take few tokens of a byte-pair vocabulary for their length, random
strings many. A run of key characters with few characters per token is reported as
``random``, unless it is a known digest, an identifier, or overlaps a pattern's span.

Defined results: NULL and empty texts have no spans; a text of any length is scanned
whole, and matches never overlap within a kind; repeated rows are scanned alike; a NULL
doc_id stays NULL; further columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

from opscheck.llm.common import TOKENIZERS, map_rows, texts

# The patterns and shortest lengths of the contract.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")  # runs are maximal, so shorter ones need no match
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api")
MIN_ASSIGN, MIN_ACCESS = 12, 18
KINDS = ["assign", "access", "hex", "random"]
# Lengths of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512 in hexadecimal.
DIGEST_LENGTHS = {32, 40, 56, 64, 96, 128}
UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
_HEX_ONLY = re.compile(r"[0-9a-fA-F]+")
_RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
#: The word pattern of the byte-pair vocabulary, as its description gives it.
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@dataclass(frozen=True)
class SecretParameters:
    vocabulary: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
    max_chars_per_token: float = 2.0
    shortest_part: int = 4  # an identifier's parts are, on average, at least so long


def load_ranks(content: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line.strip())}
    return tiktoken.Encoding("secrets", pat_str=WORD_PATTERN, mergeable_ranks=ranks, special_tokens={})


def is_excluded(run: str, p: SecretParameters) -> bool:
    """Known digests, UUIDs, and identifiers: words in one case, or joined words of some length."""
    if len(run) in DIGEST_LENGTHS and _HEX_ONLY.fullmatch(run) or UUID.fullmatch(run):
        return True
    parts = _PARTS.findall(run)
    letters = [x for x in parts if not x.isdigit()]
    return not letters or sum(map(len, letters)) / len(parts) >= p.shortest_part or len(set(run)) < 8


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, in code points."""
    lowered, found = text.lower(), []
    if any(w in lowered for w in ASSIGN_WORDS):
        found += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_ASSIGN]
    found += [(*m.span(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    return found + [(*m.span(), "hex") for m in HEX.finditer(text)]


def random_spans(text: str, taken: list[tuple[int, int, str]], encoding, p: SecretParameters) -> list[tuple[int, int, str]]:
    """Runs that spend a token on very few characters, outside the spans ``taken``."""
    runs = [m for m in _RUN.finditer(text) if not is_excluded(m[0], p)]
    if not runs:
        return []
    taken, found, at = sorted(taken), [], 0
    for m in runs:
        while at < len(taken) and taken[at][0] < m.start() and taken[at][1] <= m.start():
            at += 1
        if any(s < m.end() and e > m.start() for s, e, _ in taken[at:at + 4]):
            continue
        if len(m[0]) / len(encoding.encode_ordinary(m[0])) < p.max_chars_per_token:
            found.append((*m.span(), "random"))
    return found


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{s}:{e}" for s, e, kind in sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]), x[1])))


def secret_spans(docs: DataFrame, p: SecretParameters = SecretParameters()) -> DataFrame:
    """Counts and spans of every text; ``base_spans`` are those of the patterns, ``spans`` all of them."""
    with open(p.vocabulary, "rb") as file:
        content = docs.sparkSession.sparkContext.broadcast(file.read())  # a vocabulary file, under 1 MB

    def scanned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding = load_ranks(content.value)
        for batch in batches:
            base = [base_spans(t) for t in batch["text"]]
            more = [random_spans(t, b, encoding, p) for t, b in zip(batch["text"], base, strict=True)]
            counts = {f"n_{kind}": [sum(x[2] == kind for x in b + m) for b, m in zip(base, more, strict=True)]
                      for kind in KINDS}
            yield pd.DataFrame({"doc_id": batch["doc_id"], **counts, "base_spans": [joined(b) for b in base],
                                "spans": [joined(b + m) for b, m in zip(base, more, strict=True)]})

    return map_rows(texts(docs), scanned, "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, "
                                          "n_random bigint, base_spans string, spans string")


def base_digest(spans: str) -> str:
    return hashlib.sha256(spans.encode()).hexdigest()
