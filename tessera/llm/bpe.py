"""Operator 2: byte-level BPE over a monoid of encoded segments.

An encoded text is a pair (text, token ids). Two neighbours are joined without encoding either again: only a window of tokens around
the seam is encoded anew. The window grows until it begins and ends at a white-space character
that follows a printable ASCII character. The pre-tokenizer starts a new piece at such a place
whatever stands before or after it, and merges never leave a piece, so the tokens outside the
window are those of the whole text. Encoding halves a text down to leaves and joins them up the tree;
decoding concatenates bytes up the same tree.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col

#: Vocabulary as lines of "base64 rank"; the pattern splits a text before merging.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters of a leaf of the tree.
LEAF = 4096
#: Tokens first looked at on each side of a seam.
WINDOW = 8

_SYNC = re.compile(rb"(?<=[!-~])[ \t\n\r\f\v]")


@lru_cache(maxsize=4)
def codec(path: str = VOCABULARY):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def join(enc, left: list[int], right: list[int], window: int = WINDOW) -> list[int]:
    """Tokens of the text whose two parts have the tokens ``left`` and ``right``."""
    if not left or not right:
        return left + right
    w = window
    while True:
        parts = enc.decode_tokens_bytes(left[-w:])
        tail = b"".join(parts)
        all_left = w >= len(left)
        # the token before the window may end in half a character, the sync point needs only ASCII
        found = [m.start() for m in _SYNC.finditer(tail)]
        if found:
            at, taken = found[-1], 0
            for k, p in enumerate(parts):
                if taken == at:
                    break
                taken += len(p)
            else:
                k = len(parts)
            if taken == at:
                keep_left, tail = len(left) - len(parts) + k, tail[at:]
                break
        if all_left:
            keep_left = 0
            break
        w *= 2
    w = window
    while True:
        parts = enc.decode_tokens_bytes(right[:w])
        head = b"".join(parts)
        all_right = w >= len(right)
        m = _SYNC.search(head)
        if m:
            at, taken = m.start(), 0
            for k, p in enumerate(parts):
                if taken == at:
                    break
                taken += len(p)
            if taken == at:
                drop_right, head = k, head[:at]
                break
        if all_right:
            drop_right = len(right)
            break
        w *= 2
    middle = enc.encode_ordinary((tail + head).decode("utf-8"))
    return left[:keep_left] + middle + right[drop_right:]


def encode(enc, text: str, leaf: int = LEAF) -> list[int]:
    """Token ids of ``text`` by tree reduction; equal to encoding it in one piece."""
    if len(text) <= leaf:
        return enc.encode_ordinary(text)
    half = len(text) // 2
    return join(enc, encode(enc, text[:half], leaf), encode(enc, text[half:], leaf))


def decode(enc, tokens: list[int], leaf: int = LEAF) -> bytes:
    if len(tokens) <= leaf:
        return enc.decode_bytes(tokens)
    half = len(tokens) // 2
    return decode(enc, tokens[:half], leaf) + decode(enc, tokens[half:], leaf)


def encode_udf(path: str = VOCABULARY):
    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def run(text: pa.Array) -> pa.Array:
        enc = codec(path)
        ids, off, null = [], [0], []
        for t in text:
            s = t.as_py()
            got = np.array(encode(enc, s) if s else [], np.int32)
            ids.append(got)
            off.append(off[-1] + len(got))
            null.append(s is None)
        flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        return pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(flat, pa.int32()), mask=pa.array(null, pa.bool_()))

    return run


def decode_udf(path: str = VOCABULARY):
    @F.arrow_udf(T.StringType())
    def run(tokens: pa.Array) -> pa.Array:
        enc = codec(path)
        out = []
        for i in range(len(tokens)):
            if not tokens[i].is_valid:
                out.append(None)
                continue
            out.append(decode(enc, tokens[i].values.to_pylist()).decode("utf-8", "replace"))
        return pa.array(out, pa.string())

    return run


def tokenize(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY) -> DataFrame:
    """``(id, tokens, n_tokens, round_trip)`` for each row; ``round_trip`` says that the decoded tokens are the text.

    A null text has null tokens, ``n_tokens`` and ``round_trip``; an empty one has none. Rows repeat as they do in the input; an empty table
    gives an empty result; columns other than the two are not read."""
    schema = T.StructType([T.StructField("tokens", T.ArrayType(T.IntegerType())), T.StructField("round_trip", T.BooleanType())])

    @F.arrow_udf(schema)
    def run(text: pa.Array) -> pa.Array:
        enc = codec(path)
        ids, off, null, ok = [], [0], [], []
        for t in text:
            s = t.as_py()
            got = encode(enc, s) if s else []
            ids.append(np.array(got, np.int32))
            off.append(off[-1] + len(got))
            null.append(s is None)
            ok.append(None if s is None else decode(enc, got) == s.encode())
        flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        tokens = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(flat, pa.int32()), mask=pa.array(null, pa.bool_()))
        return pa.StructArray.from_arrays([tokens, pa.array(ok, pa.bool_())], names=["tokens", "round_trip"])

    got = docs.select(col(id_col).alias(id_col), run(col(text_col)).alias("r"))
    return got.select(id_col, F.col("r.tokens").alias("tokens"), F.size("r.tokens").cast("bigint").alias("n_tokens"), F.col("r.round_trip").alias("round_trip"))
