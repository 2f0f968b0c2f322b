"""Feature hashing on numpy arrays. Integer arithmetic wraps, as it must."""

from __future__ import annotations

import numpy as np

SEED = 0x9E3779B9
HASHES = ("fmix32", "murmur2", "multiply_shift")
_32 = np.uint32


def fmix32(h) -> np.ndarray:
    """The 32-bit finaliser of MurmurHash3."""
    h = np.array(h, _32, ndmin=1)
    h ^= h >> _32(16)
    h *= _32(0x85EBCA6B)
    h ^= h >> _32(13)
    h *= _32(0xC2B2AE35)
    h ^= h >> _32(16)
    return h


def murmur2(key, seed: int) -> np.ndarray:
    """MurmurHash2 of one 32-bit word, without the length in the seed."""
    m = _32(0x5BD1E995)
    k = np.array(key, _32, ndmin=1) * m
    k ^= k >> _32(24)
    k *= m
    h = np.full(k.shape, seed & 0xFFFFFFFF, _32) * m
    h ^= k
    h ^= h >> _32(13)
    h *= m
    return h ^ (h >> _32(15))


def hash_keys(keys: np.ndarray, which: str = "fmix32", seed: int = SEED) -> np.ndarray:
    """32-bit hash of 64-bit keys."""
    keys = np.asarray(keys, np.uint64)
    low, high = keys.astype(_32), (keys >> np.uint64(32)).astype(_32)
    if which == "fmix32":
        start = seed * 0x85EBCA6B & 0xFFFFFFFF
        return fmix32(low ^ _32(start) ^ (high * _32(0xC2B2AE35)))
    if which == "murmur2":
        turned = (seed << 16 | seed >> 16) & 0xFFFFFFFF
        return murmur2(low ^ _32(seed), seed) ^ murmur2(high ^ _32(turned), turned)
    if which == "multiply_shift":
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(_32) ^ _32(seed)
    raise ValueError(f"unknown hash {which!r}; known: {', '.join(HASHES)}")


def buckets(keys: np.ndarray, log2_d: int, which: str = "fmix32", seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(bucket from the high bits, sign from the lowest bit)."""
    h = hash_keys(keys, which, seed)
    return (h >> _32(32 - log2_d)).astype(np.int32), (h & _32(1)).astype(bool)


def signed_index(bucket: np.ndarray, negative: np.ndarray, log2_d: int) -> np.ndarray:
    """Row of the doubled table: negative buckets stand after the padding row."""
    return np.where(negative, bucket + (1 << log2_d) + 1, bucket).astype(np.int32)
