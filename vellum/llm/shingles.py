"""Shingle sets and min-hash fingerprints of a batch of texts, in whole-batch array operations.

A shingle is three consecutive words (runs of a-z and 0-9 of the lower-cased text) or three consecutive
characters. Its key holds the text's position in the batch in the upper 20 bits and a hash of 44 bits below.
"""

from __future__ import annotations

import numpy as np

HASH_BITS = 44
_mask = np.uint64((1 << HASH_BITS) - 1)
_up = np.uint64(HASH_BITS)
_base = np.uint64(0x9E3779B97F4A7C15)
_inverse = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_is_word = np.zeros(256, dtype=bool)
_is_word[[*b"abcdefghijklmnopqrstuvwxyz0123456789"]] = True

#: Texts are worked on in portions of about so many bytes, whose arrays stay in a core's cache.
PORTION = 1 << 18


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _distinct(keys: np.ndarray) -> np.ndarray:
    """Sorted without repeats; plain sorting is far faster here than np.unique."""
    keys = np.sort(keys)
    return keys[np.diff(keys, prepend=keys[:1] ^ np.uint64(1)) != 0] if len(keys) else keys


def _word_keys(texts: list[str], first: int, width: int) -> np.ndarray:
    parts = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join(parts) + b"\n", dtype=np.uint8)
    word = _is_word[data]
    edge = np.flatnonzero(np.diff(word.view(np.int8), prepend=np.int8(0)))
    starts, ends = edge[::2], edge[1::2]
    if len(starts) < width:
        return np.zeros(0, np.uint64)
    n = len(data)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(np.where(word, data, 0).astype(np.uint64) * _powers(_base, n), out=total[1:])
    hashes = mixed((total[ends] - total[starts]) * _powers(_inverse, n)[starts])
    text_ends = np.cumsum([len(p) + 1 for p in parts])
    owner = np.searchsorted(text_ends, starts, side="right").astype(np.uint64)
    h = hashes[: len(hashes) - width + 1]
    for k in range(1, width):
        h = mixed(h * _base + hashes[k : len(hashes) - width + 1 + k])
    same = owner[: len(h)] == owner[width - 1 :]
    return ((owner[: len(h)][same] + np.uint64(first)) << _up) | (h[same] & _mask)


def word_shingles(texts: list[str | None], width: int = 3) -> np.ndarray:
    """Sorted distinct keys of the word shingles of a batch of at most 2^20 texts; null texts have none."""
    out, portion, first, size = [], [], 0, 0
    for i, text in enumerate(texts):
        portion.append(text or "")
        size += len(portion[-1])
        if size >= PORTION:
            out.append(_distinct(_word_keys(portion, first, width)))
            portion, first, size = [], i + 1, 0
    if portion:
        out.append(_distinct(_word_keys(portion, first, width)))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def char_shingles(names: list[str | None], width: int = 3) -> np.ndarray:
    """Sorted distinct keys of the character shingles of short ASCII strings."""
    parts = [(t or "").encode("ascii") for t in names]
    data = np.frombuffer(b"".join(parts), dtype=np.uint8).astype(np.uint64)
    if len(data) < width:
        return np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(parts), dtype=np.uint64), [len(p) for p in parts])
    n = len(data) - width + 1
    h = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        h = (h << np.uint64(8)) | data[k : k + n]
    same = owner[:n] == owner[width - 1 :]
    return _distinct((owner[:n][same] << _up) | (h[same] & _mask))


def letter_shingles(texts: list[str | None], width: int = 5) -> np.ndarray:
    """Sorted distinct keys of the runs of so many characters, in any script, of the lower-cased texts with every
    stretch of blanks as one; a text of fewer characters is one run."""
    parts = [" ".join((t or "").lower().split()) for t in texts]
    parts = [p.ljust(width) if p else p for p in parts]
    code = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    if len(code) < width:
        return np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(parts), dtype=np.uint64), [len(p) for p in parts])
    n = len(code) - width + 1
    h = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        h = mixed(h * _base + code[k : k + n])
    same = owner[:n] == owner[width - 1 :]
    return _distinct((owner[:n][same] << _up) | (h[same] & _mask))


def split_keys(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of the texts that have keys, where their keys begin, and the hashes."""
    owner = keys >> _up
    begins = np.flatnonzero(np.diff(owner, prepend=np.uint64(1 << 20)))
    return owner[begins].astype(np.int64), begins, keys & _mask


def fingerprints(keys: np.ndarray, places: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each text with keys: its position, number of shingles, a 128-bit digest of the set (as two columns)
    and a min-hash fingerprint of so many places of 32 bits."""
    at, begins, hashes = split_keys(keys)
    if not len(at):
        return at, at, np.zeros((0, 2), np.int64), np.zeros((0, places), np.uint64)
    sizes = np.diff(np.append(begins, len(hashes)))
    h = mixed(hashes + _base)
    digest = np.stack([np.add.reduceat(h, begins), np.add.reduceat(mixed(h + _base), begins)], axis=1)
    out = np.empty((len(at), places), dtype=np.uint64)
    factors = mixed(np.arange(1, places + 1, dtype=np.uint64) * _base) | np.uint64(1)
    for k in range(places):  # the upper half of a product depends on all lower bits of its factors
        out[:, k] = np.minimum.reduceat((h * factors[k]) >> np.uint64(32), begins)
    return at, sizes, digest.view(np.int64), out


def blocks(places: np.ndarray, width: int, salt: int) -> np.ndarray:
    """Keys of 64 bits of the blocks of so many places each; the block's number and the salt are part of them."""
    count = places.shape[1] // width
    h = np.tile(np.arange(count, dtype=np.uint64) + np.uint64(salt), (len(places), 1))
    for k in range(width):
        h = mixed(h * _base + places[:, k : count * width : width])
    return h.view(np.int64)
