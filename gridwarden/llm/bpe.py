"""Byte-level BPE: encoding and decoding with a local rank file.

A long text is cut where a word character is followed by white space. Every alternative of the split
pattern has white space at its front only, so no match crosses such a place, and no look-ahead sees past
it: encoding the parts one by one gives the ids of the whole. Memory follows the part, not the text.

Defined results: a null text counts as empty (no ids, hash of no bytes); repeated rows give repeated rows;
an empty table gives no rows; columns that are not named are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame

from gridwarden.llm.common import per_row

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Characters after which a long text is cut at the next safe place.
PART_CHARS = 65_536
_SAFE = re.compile(r"(?<=\S)(?=\s)")


@lru_cache(maxsize=4)
def load_encoding(path: str, pattern: str) -> tiktoken.Encoding:
    """Encoding of a rank file (one base64 token and its rank a line); loaded once per worker."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def safe_parts(text: str, size: int = PART_CHARS) -> Iterator[str]:
    """Consecutive parts of a text, each at least ``size`` long but the last, cut at safe places only."""
    start = 0
    while len(text) - start > size:
        cut = _SAFE.search(text, start + size)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def encode(encoding: tiktoken.Encoding, text: str | None, size: int = PART_CHARS) -> list[int]:
    """Ids of a whole text."""
    ids: list[int] = []
    for part in safe_parts(text or "", size):
        ids += encoding.encode_ordinary(part)
    return ids


def bpe_encode(df: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",), path: str | None = None, pattern: str = public_tokenizers.PATTERN, part_chars: int = PART_CHARS) -> DataFrame:
    """``keep`` columns, token_ids array<int>, n_tokens."""
    file = path or public_tokenizers.path(RANKS)

    def setup():
        encoding = load_encoding(file, pattern)

        def fn(texts):
            ids = [encode(encoding, t, part_chars) for t in texts]
            return ids, [len(x) for x in ids]

        return fn

    return per_row(df, setup, "token_ids array<int>, n_tokens long", [text], keep)


def bpe_decode(df: DataFrame, ids: str = "token_ids", keep: Sequence[str] = ("doc_id",), path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """``keep`` columns and decoded binary: raw bytes, so ids that end inside a character lose nothing. Null ids give no bytes."""
    file = path or public_tokenizers.path(RANKS)

    def setup():
        encoding = load_encoding(file, pattern)
        return lambda rows: ([encoding.decode_bytes(x or []) for x in rows],)

    return per_row(df, setup, "decoded binary", [ids], keep)


def bpe_round_trip(df: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",), path: str | None = None, pattern: str = public_tokenizers.PATTERN, part_chars: int = PART_CHARS, with_ids: bool = False) -> DataFrame:
    """Encode and decode part by part: ``keep`` columns, n_tokens, ids_sha256 (decimal ids joined by commas), decoded_sha256.

    ``with_ids`` adds token_ids array<int>.
    """
    file = path or public_tokenizers.path(RANKS)

    def setup():
        encoding = load_encoding(file, pattern)
        names = [str(i) for i in range(encoding.n_vocab)]

        def one(text):
            n, ids_hash, bytes_hash, all_ids = 0, hashlib.sha256(), hashlib.sha256(), []
            for part in safe_parts(text or "", part_chars):
                ids = encoding.encode_ordinary(part)
                if ids:
                    ids_hash.update((("," if n else "") + ",".join([names[i] for i in ids])).encode())
                    bytes_hash.update(encoding.decode_bytes(ids))
                    n += len(ids)
                    if with_ids:
                        all_ids += ids
            row = n, ids_hash.hexdigest(), bytes_hash.hexdigest()
            return (*row, all_ids) if with_ids else row

        return lambda texts: list(zip(*map(one, texts), strict=True)) or [[]] * (3 + with_ids)

    return per_row(df, setup, "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>" * with_ids, [text], keep)
