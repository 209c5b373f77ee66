"""Hashes of words and of runs of words, by array operations."""

from __future__ import annotations

import numpy as np
import xxhash

_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers; one to one."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def run_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Rabin-Karp: a hash of each run of ``n`` words, from the words' hashes; modulo 2 ** 64."""
    total = len(words) - n + 1
    if total <= 0:
        return np.zeros(0, np.uint64)
    h = words[:total].copy()
    for k in range(1, n):
        h *= _BASE
        h += words[k : k + total]
    return mix(h)


def runs_of_documents(lengths: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For documents whose words stand one after another: where each run of ``n`` words that stays in its
    document begins, and the document's number."""
    runs = np.maximum(lengths - n + 1, 0)
    document = np.repeat(np.arange(len(lengths)), runs)
    begins = np.cumsum(lengths) - lengths
    ends = np.cumsum(runs)
    return np.arange(int(runs.sum())) - (ends - runs)[document] + begins[document], document


def bucket_by_hash(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """A bucket for each hash, from its upper half."""
    return (((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def packed_runs(bucket: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows sorted by bucket, then owner: begins of runs with one bucket and owner, and both."""
    if not len(bucket):
        return np.zeros(0, np.int64), bucket, owner
    begins = np.flatnonzero(np.concatenate([[True], (np.diff(bucket) != 0) | (np.diff(owner) != 0)]))
    return begins, bucket[begins], owner[begins]
