"""Byte-level BPE encoding and decoding with tiktoken and a local rank file.

A null text is encoded as the empty text; so is an empty one. Ids are kept packed: four bytes each, little-endian,
unsigned. Every text is encoded whole: long ones are first cut where the splitting pattern always has a boundary, so the
ids are those of the uncut text while no single call sees more than about CUT_CHARS characters (unless a text has no such
place). Decoding returns bytes: ids of a slice need not be valid UTF-8.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Length from which a text is cut before it is encoded.
CUT_CHARS = 1 << 15
#: No alternative of the pattern has white space after a non-space, and none looks back: before a space or line feed that
#: follows a word character, a match always ends and the rest is split as if the text began there.
SAFE = re.compile(r"(?<=\w)(?=[ \n])")


def default_rank_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


@lru_cache(maxsize=4)
def encoder(rank_file: str, pattern: str):
    """One encoder per worker process, file and pattern; no special tokens."""
    import tiktoken

    with open(rank_file, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, cut: int = CUT_CHARS) -> list[str]:
    """The text in order, cut at safe places at least cut characters apart."""
    out, start = [], 0
    while len(text) - start > 2 * cut and (m := SAFE.search(text, start + cut)):
        out.append(text[start : m.start()])
        start = m.start()
    return [*out, text[start:]]


def encode(text: str | Column, rank_file: str | None = None, pattern: str | None = None) -> Column:
    """Packed ids of a text column."""
    file, pat = rank_file or default_rank_file(), pattern or default_pattern()

    @F.pandas_udf("binary")
    def run(texts: pd.Series) -> pd.Series:
        enc = encoder(file, pat)
        return pd.Series([b"".join(np.array(enc.encode_ordinary(p), dtype="<u4").tobytes() for p in pieces(t or "")) for t in texts], dtype=object)

    return run(text)


def decode(ids: str | Column, rank_file: str | None = None, pattern: str | None = None) -> Column:
    """Bytes of a column of packed ids; null gives no bytes."""
    file, pat = rank_file or default_rank_file(), pattern or default_pattern()

    @F.pandas_udf("binary")
    def run(packed: pd.Series) -> pd.Series:
        enc = encoder(file, pat)
        return pd.Series([enc.decode_bytes(np.frombuffer(p or b"", dtype="<u4").tolist()) for p in packed], dtype=object)

    return run(ids)


def unpack(ids: str | Column) -> Column:
    """Packed ids as array<int>."""

    @F.pandas_udf("array<int>")
    def run(packed: pd.Series) -> pd.Series:
        return pd.Series([np.frombuffer(p or b"", dtype="<u4").astype(np.int32) for p in packed], dtype=object)

    return run(ids)


def tokenize(df: DataFrame, text: str = "text", rank_file: str | None = None, pattern: str | None = None, ids: str = "ids", n_tokens: str = "n_tokens") -> DataFrame:
    """df with the packed ids and their number; columns of these names are replaced."""
    return df.withColumn(ids, encode(F.col(text), rank_file, pattern)).withColumn(n_tokens, (F.octet_length(ids) / 4).cast("long"))
