"""Hashes of words and of word runs with numpy; the same in every process and on every machine."""

from __future__ import annotations

import numpy as np

#: Bytes hashed at a time; longer texts are cut at white space, which no word crosses.
PIECE = 1 << 20
#: Fixed: white space of ``[^\\x20\\x09-\\x0D]+``.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
BASE = 0x9E3779B97F4A7C15
U64 = np.uint64

_CODES = np.random.default_rng(20_240_101).integers(1, 1 << 63, 256, dtype=U64) * U64(2) + U64(1)
_LOWER = _CODES.copy()
_LOWER[65:91] = _CODES[97:123]
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse modulo 2**64, for i < n at least."""
    if not _powers or len(_powers[0]) < n:
        n = max(n, PIECE + 4096)
        inverse = pow(BASE, -1, 1 << 64)
        _powers[:] = [np.cumprod(np.concatenate([[U64(1)], np.full(n, U64(b), U64)]).astype(U64)) for b in (BASE, inverse)]
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def pieces(text: bytes, sep: np.ndarray):
    """``text`` in parts of about PIECE bytes, cut where ``sep`` has a separator."""
    at = 0
    while len(text) - at > PIECE:
        part = np.frombuffer(text, np.uint8, PIECE, at)
        gaps = np.flatnonzero(sep[part[-4096:]])
        if len(gaps):
            cut = at + PIECE - len(part[-4096:]) + int(gaps[-1])
        else:
            rest = np.flatnonzero(sep[np.frombuffer(text, np.uint8, -1, at)])
            rest = rest[rest > 0]
            inside = rest[rest < PIECE]
            cut = at + int(inside[-1] if len(inside) else rest[0] if len(rest) else len(text) - at)
        yield text[at:cut]
        at = cut
    yield text[at:]


def hash_words(texts: list[bytes], lower: bool = False, sep: np.ndarray = SPACE, prefixes: tuple[int, ...] = ()) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashes of all words of all texts in order, and the index of the text of each.

    The first array has the words, one more for each of ``prefixes`` the words' first bytes.
    """
    codes = _LOWER if lower else _CODES
    hashes: list[list[np.ndarray]] = [[] for _ in range(1 + len(prefixes))]
    owners: list[np.ndarray] = []

    def run(group: list[bytes], of: list[int]) -> None:
        data = np.frombuffer(b" ".join(group), np.uint8)
        if not len(data):
            return
        n = len(data)
        up, down = powers(n + 1)
        edge = np.zeros(n + 2, np.int8)
        edge[1:-1] = ~sep[data]
        edge = np.diff(edge)
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if not len(starts):
            return
        sums = np.zeros(n + 1, U64)
        np.cumsum(codes[data] * up[:n], out=sums[1:])
        base, undo = sums[starts], down[starts]
        hashes[0].append(mix((sums[ends] - base) * undo))
        for k, size in enumerate(prefixes):
            hashes[k + 1].append(mix((sums[np.minimum(ends, starts + size)] - base) * undo + U64(size)))
        at = np.cumsum([0] + [len(g) + 1 for g in group[:-1]])
        owners.append(np.asarray(of, np.int64)[np.searchsorted(at, starts, "right") - 1])

    group, of, held = [], [], 0
    for i, text in enumerate(texts):
        for part in pieces(text, sep):
            group.append(part)
            of.append(i)
            held += len(part) + 1
            if held >= PIECE:
                run(group, of)
                group, of, held = [], [], 0
    run(group, of)
    none = np.zeros(0, U64)
    return [np.concatenate(h) if h else none for h in hashes], np.concatenate(owners) if owners else np.zeros(0, np.int64)


def runs_of(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` consecutive words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    h = np.full(n, U64(k), U64)
    for j in range(k):
        h = h * U64(BASE) + words[j : j + n]
    return mix(h)


def starts_of(owner: np.ndarray, n: int) -> np.ndarray:
    """For words with text index ``owner``, where each of ``n`` texts starts, and the end."""
    return np.searchsorted(owner, np.arange(n + 1))
