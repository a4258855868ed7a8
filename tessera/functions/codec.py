"""Fingerprints of shingles and the delta code of sorted fingerprint sets."""

from __future__ import annotations

import base64
import binascii
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

_MASK = (1 << 64) - 1


def fnv1a(shingle: str) -> int:
    """FNV-1a, 64 bits unsigned, of the blank-joined lower-case words with 0x1f between them."""
    h = 0xCBF29CE484222325
    for byte in "\x1f".join(shingle.split(" ")).encode():
        h = ((h ^ byte) * 0x100000001B3) & _MASK
    return h


@F.arrow_udf(T.LongType())
def fingerprint(shingles: pa.Array) -> pa.Array:
    """``fnv1a`` as the signed number of the same bits, of all shingles side by side, a byte at a time."""
    raw = [b"" if s is None else s.encode().replace(b" ", b"\x1f") for s in shingles.to_pylist()]
    size = np.array([len(r) for r in raw], np.int64)
    order = np.argsort(-size, kind="stable")
    data = np.frombuffer(b"".join(raw), np.uint8)
    start = (np.cumsum(size) - size)[order]
    live = np.searchsorted(-size[order], -np.arange(size.max() if len(size) else 0), side="left")  # shingles longer than j
    h = np.full(len(raw), 0xCBF29CE484222325, np.uint64)
    for j, n in enumerate(live):
        h[:n] = (h[:n] ^ data[start[:n] + j]) * np.uint64(0x100000001B3)
    out = np.empty(len(raw), np.uint64)
    out[order] = h
    return pa.array(out.view(np.int64), mask=np.asarray(shingles.is_null()))


def encode(values: Iterable[int]) -> str:
    """Base64 of the varint differences of the sorted unsigned values; signed ones count as their bits."""
    out, last = bytearray(), 0
    for v in sorted({v & _MASK for v in values}):
        d = v - last
        last = v
        while d > 127:
            out.append(d & 127 | 128)
            d >>= 7
        out.append(d)
    return base64.b64encode(bytes(out)).decode()


def decode(text: str) -> list[int]:
    """What ``encode`` coded, ascending; a ``ValueError`` for anything else."""
    try:
        raw = base64.b64decode(text, validate=True)
    except (binascii.Error, ValueError) as e:
        raise ValueError("fingerprints are not base64") from e
    out: list[int] = []
    last, d, shift = 0, 0, 0
    for b in raw:
        d |= (b & 127) << shift
        shift += 7
        if b & 128:
            if shift > 63:
                raise ValueError("a difference is too long")
            continue
        if d == 0 and out:
            raise ValueError("a fingerprint stands twice")
        last += d
        if last > _MASK:
            raise ValueError("a fingerprint is over 64 bits")
        out.append(last)
        d = shift = 0
    if shift:
        raise ValueError("the last difference is cut off")
    return out
