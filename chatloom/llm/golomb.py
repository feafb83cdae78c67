"""Golomb-Rice code of sorted numbers, as two bit streams: quotients in unary, remainders in ``shift`` bits."""

from __future__ import annotations

import numpy as np


def encode(values: np.ndarray, start: int, width: int) -> tuple[int, bytes, bytes]:
    """``values``: sorted uint64 (repeats allowed) in [start, start + 2**width). Returns (shift, high, low)."""
    n = len(values)
    gaps = np.empty(n, np.uint64)
    gaps[0] = values[0] - np.uint64(start)
    gaps[1:] = values[1:] - values[:-1]
    shift = max(0, min(63, width - n.bit_length()))
    quotient = (gaps >> np.uint64(shift)).astype(np.int64)
    ends = np.cumsum(quotient + 1) - 1
    unary = np.zeros(int(ends[-1]) + 1, np.uint8)
    unary[ends] = 1
    bits = np.unpackbits(gaps.astype(">u8").view(np.uint8).reshape(n, 8), axis=1)[:, 64 - shift :]
    return shift, np.packbits(unary).tobytes(), np.packbits(bits.reshape(-1)).tobytes()


def decode(n: int, shift: int, high: bytes, low: bytes, start: int) -> np.ndarray:
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(high, np.uint8)))[:n]
    quotient = np.diff(ends, prepend=-1).astype(np.uint64) - np.uint64(1)
    bits = np.zeros((n, 64), np.uint8)
    if shift:
        bits[:, 64 - shift :] = np.unpackbits(np.frombuffer(low, np.uint8))[: n * shift].reshape(n, shift)
    remainder = np.packbits(bits, axis=1).reshape(-1).view(">u8").astype(np.uint64)
    gaps = (quotient << np.uint64(shift)) | remainder
    return np.cumsum(gaps, dtype=np.uint64) + np.uint64(start)
