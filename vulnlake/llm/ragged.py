"""Whitespace words of Arrow string batches, their hashes, and ragged arrays, in numpy."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
#: 2**61 - 1: products modulo it need only 64-bit words.
PRIME = (1 << 61) - 1
_P, _HALF = _U(PRIME), _U((1 << 31) - 1)


def _folded(x: np.ndarray) -> np.ndarray:
    """Values below 2**64 modulo PRIME."""
    x = (x & _P) + (x >> _U(61))
    return np.where(x >= _P, x - _P, x)


def product_mod(a: np.ndarray, b: np.ndarray, prime: int = PRIME) -> np.ndarray:
    """a * b modulo ``prime``, for values below it: PRIME, or one below 2**31."""
    if prime != PRIME:
        return (a % _U(prime)) * (b % _U(prime)) % _U(prime)
    ah, al, bh, bl = a >> _U(31), a & _HALF, b >> _U(31), b & _HALF
    middle = al * bh + ah * bl
    return _folded(((ah * bh) << _U(1)) + (middle >> _U(30)) + ((middle & _U((1 << 30) - 1)) << _U(31)) + al * bl)


def powers_mod(base: int, start: int, n: int, prime: int = PRIME) -> np.ndarray:
    """base**start, ..., base**(start + n - 1) modulo ``prime``, by doubling."""
    out = np.full(1, pow(base, start, prime), _U)
    while len(out) < n:
        out = np.concatenate([out, product_mod(out, np.full(len(out), pow(base, len(out), prime), _U), prime)])
    return out[:n]


def sums_mod(values: np.ndarray, prime: int = PRIME, first: int = 0) -> np.ndarray:
    """Running sums modulo ``prime`` of values below it, from ``first`` on; up to 2**30 of them."""
    if prime != PRIME:
        return (np.cumsum(values) + _U(first)) % _U(prime)
    high, low = np.cumsum(values >> _U(31)), np.cumsum(values & _HALF)
    high = ((high & _U((1 << 30) - 1)) << _U(31)) + (high >> _U(30))
    return _folded(_folded(high) + _folded(low) + _U(first))


#: A base of no meaning. Whoever fears texts made to collide gives another, see common.secret.
BASE = 0x16A3_9F0B_5D2E_C871 % PRIME
_STEP = 1 << 16
_known: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _grow(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``base`` and of its inverse, at least ``n`` of each."""
    if base not in _known or len(_known[base][0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        _known[base] = powers_mod(base, 0, size), powers_mod(pow(base, -1, PRIME), 0, size)
    return _known[base]


def mixed(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def byte_table(seed: int, lower: bool = False) -> np.ndarray:
    """A random 64-bit value for each byte; with ``lower``, A-Z share those of a-z."""
    table = mixed(np.arange(1, 257, dtype=_U) * _U(0xD6E8FEB86659FD93) + _U(seed))
    if lower:
        table[65:91] = table[97:123]
    return table


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = BASE) -> np.ndarray:
    """Hashes of values[start:end] for all pairs at once: differences of polynomial prefix sums modulo 2**61 - 1.

    Two different runs of n values have the same hash for at most n of all bases, whatever they hold, so for a base that nobody
    knows beforehand the chance is n in 2**61. Modulo a power of two there are runs that collide under every base.
    """
    power, inverse = _grow(len(values) + 1, base)
    sums = np.zeros(len(values) + 1, _U)
    for lo in range(0, len(values), _STEP):  # blocks that stay in a processor's cache
        hi = min(len(values), lo + _STEP)
        sums[lo + 1 : hi + 1] = sums_mod(product_mod(_folded(values[lo:hi]), power[lo:hi]), first=int(sums[lo]))
    out = np.empty(len(starts), _U)
    for lo in range(0, len(starts), _STEP):
        a, b = starts[lo : lo + _STEP], ends[lo : lo + _STEP]
        h = product_mod(_folded(sums[b] + (_P - sums[a])), inverse[a])
        out[lo : lo + _STEP] = mixed(h ^ ((b - a).astype(_U) * _U(0x9FB21C651E98DF25)))
    return out


_FAST = _U(0x9E3779B97F4A7C15)
_FAST_INVERSE = _U(pow(int(_FAST), -1, 2**64))
_fast: list[np.ndarray] = []


def gram_hashes(values: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` values, modulo 2**64: cheap, and good enough to tell where to look.

    Equal runs have equal hashes; nothing is ever decided by these alone.
    """
    n = len(values)
    if not _fast or len(_fast[0]) < n + 1:
        size = max(n + 1, 1 << 16)
        _fast[:] = [np.multiply.accumulate(np.concatenate([[_U(1)], np.full(size - 1, b)])) for b in (_FAST, _FAST_INVERSE)]
    sums = np.zeros(n + 1, _U)
    np.cumsum(values * _fast[0][:n], out=sums[1:])
    return mixed((sums[width:] - sums[:-width]) * _fast[1][: n - width + 1])


def run_digests(raw: bytes, starts: np.ndarray, ends: np.ndarray, key: bytes) -> np.ndarray:
    """Keyed 64-bit BLAKE2 digests of raw[start:end]: what decides that runs are equal."""
    view, make = memoryview(raw), hashlib.blake2b
    found = [make(view[a:b], digest_size=8, key=key).digest() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    return np.frombuffer(b"".join(found), _U)


def chunks(texts: pa.Array, limit: int = 1_000_000) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first, texts as bytes) for groups of up to ``limit`` bytes, or one longer text. Null is empty."""
    data = texts.cast(pa.large_binary()).fill_null(b"")
    out, first, size = [], 0, 0
    for i, x in enumerate(data.to_pylist()):
        if out and size + len(x) > limit:
            yield first, out
            out, first, size = [], i, 0
        out.append(x)
        size += len(x)
    if out:
        yield first, out


def word_spans(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes as an array, starts, ends) of the words of ``raw``."""
    buf = np.frombuffer(raw, np.uint8)
    space = np.ones(len(buf) + 2, bool)
    space[1:-1] = (buf == 32) | ((buf >= 9) & (buf <= 13))
    edge = np.flatnonzero(space[1:] != space[:-1])
    return buf, edge[::2], edge[1::2]


def word_hashes(raw: bytes, table: np.ndarray, segment: int = 4_000_000, base: int = BASE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, hashes) of the words of ``raw``; a long text goes segment by segment, cut at white space."""
    out, at = [], 0
    while at < len(raw) or not out:
        end = min(len(raw), at + segment)
        while end < len(raw) and raw[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        buf, starts, ends = word_spans(raw[at:end])
        out.append((starts + at, ends + at, run_hashes(table[buf], starts, ends, base)))
        at = end + 1
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def joined(parts: list[bytes]) -> tuple[bytes, np.ndarray]:
    """Texts joined by a newline, and the start of each, with the end of all as the last."""
    raw = b"\n".join(parts)
    starts = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) + 1 for p in parts], out=starts[1:])
    return raw, starts


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(offsets of the words of each text, the words), split at ASCII white space. Null is empty."""
    lists = pc.ascii_split_whitespace(texts.cast(pa.large_string()).fill_null(""))
    flat, offsets = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    full = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    if not full.all():
        kept = np.zeros(len(full) + 1, np.int64)
        np.cumsum(full, out=kept[1:])
        offsets, flat = kept[offsets], flat.filter(pa.array(full))
    return offsets, flat


def gather(values: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a ragged array one after another: (values, offsets of the rows)."""
    lengths = (offsets[1:] - offsets[:-1])[rows]
    out = np.zeros(len(rows) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    index = np.repeat(offsets[:-1][rows] - out[:-1], lengths) + np.arange(out[-1])
    return values[index], out
