"""Rabin-Karp fingerprints of runs, from prefix polynomials modulo 2^64."""

from __future__ import annotations

import numpy as np

from churnlake.llm.repeated_windows import BYTE_CODES, mix

BASE = 0x9E3779B97F4A7C15
_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of the base and of its inverse, from 0 up to at least ``n``; kept for later calls."""
    if len(_POWERS["up"]) <= n:
        for name, factor in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            steps = np.full(1 << (n + 1).bit_length(), factor, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


def prefix_polynomial(codes: np.ndarray) -> np.ndarray:
    """For each place the sum of all codes before it, each times the base to the power of its own place."""
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * _powers(len(codes))[0][: len(codes)], out=out[1:])
    return out


def run_codes(prefix: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Fingerprints of the runs from ``first`` to before ``end``; equal runs have equal ones, wherever they stand."""
    code = (prefix[end] - prefix[first]) * _powers(len(prefix))[1][first]
    return mix(code, (end - first).astype(np.uint64))


def words_of(data: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """first, end, code of the words of ``data`` (bytes); ``separator`` tells for each byte value whether it parts words."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~separator[data]
    edges = np.flatnonzero(np.diff(inside))
    first, end = edges[::2], edges[1::2]
    return first, end, run_codes(prefix_polynomial(BYTE_CODES[data]), first, end)
