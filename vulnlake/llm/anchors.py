"""Content-defined anchors of sliding windows: where equal windows must look for each other.

Of the grams inside a window the one with the smallest hash is its anchor. Equal windows have equal
anchors at equal places, so grouping anchors by their gram brings all equal windows together while
only a few in a hundred positions travel.
"""

from __future__ import annotations

import struct
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from .ragged import gram_hashes, mixed

_PLACE = np.uint64((1 << 28) - 1)


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of v[i : i + width] for each i, by doubling."""
    span = 1
    while 2 * span <= width:
        v = np.minimum(v[:-span], v[span:])
        span *= 2
    return np.minimum(v[: len(v) - (width - span)], v[width - span :]) if span < width else v


@dataclass
class Runs:
    """Consecutive windows that share an anchor: first window, how many, hash of the gram, hash of all they cover."""

    first: np.ndarray
    count: np.ndarray
    gram: np.ndarray
    span: np.ndarray


def anchor_runs(values: Callable[[int, int], np.ndarray], offsets: np.ndarray, window: int, gram: int, digests: Callable[[np.ndarray, np.ndarray], np.ndarray], segment: int = 1_000_000) -> Runs:
    """Runs of all windows of the documents with these ``offsets`` in one row of units.

    ``values(a, b)`` gives 64-bit values of units [a, b), by which anchors are found; ``digests(starts, ends)`` those of what
    the units really are, by which spans are told apart. Units are taken in segments, so memory doesn't
    follow a document's length; a cut between segments only parts a run in two.
    """
    total = int(offsets[-1])
    lengths = np.diff(offsets)
    long = lengths >= window
    begin, end = offsets[:-1][long], offsets[1:][long] - window + 1
    parts: list[tuple[np.ndarray, ...]] = []
    for lo in range(0, total if len(begin) else 0, segment):
        hi = min(total, lo + segment + window - 1)
        if hi - lo < window:
            break
        v = values(lo, hi)
        grams = gram_hashes(v, gram)
        low = sliding_min((grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64), window - gram + 1)
        edge = np.zeros(len(low) + 1, np.int32)
        a, b = np.clip(begin - lo, 0, len(low)), np.clip(end - lo, 0, len(low))
        np.add.at(edge, a, 1)
        np.add.at(edge, b, -1)
        starts = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
        starts = starts[starts < segment]
        if not len(starts):
            continue
        place = (low[starts] & _PLACE).astype(np.int64)
        cut = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        first, count = starts[cut], np.diff(np.append(cut, len(starts)))
        # Anchors are small hashes; hashed again they fill all buckets alike.
        parts.append((first + lo, count, mixed(~grams[place[cut]]), digests(first + lo, first + lo + count + window - 1)))
    if not parts:
        return Runs(*(np.zeros(0, k) for k in (np.int64, np.int64, np.uint64, np.uint64)))
    return Runs(*(np.concatenate(x) for x in zip(*parts, strict=True)))


@dataclass
class Entries:
    """The distinct (gram, span) pairs of a shard, ascending, and the runs behind each."""

    gram: np.ndarray
    span: np.ndarray
    size: np.ndarray  # runs behind an entry
    rep: np.ndarray  # the first of them
    order: np.ndarray  # runs by entry
    start: np.ndarray  # where an entry's runs start in order

    @classmethod
    def of(cls, runs: Runs) -> Entries:
        order = np.lexsort((runs.span, runs.gram))
        g, s = runs.gram[order], runs.span[order]
        start = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (s[1:] != s[:-1])])) if len(g) else np.zeros(0, np.int64)
        return cls(g[start], s[start], np.diff(np.append(start, len(g))), order[start], order, start)

    def runs_of(self, entries: np.ndarray) -> np.ndarray:
        size = self.size[entries]
        ends = np.cumsum(size)
        index = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - size, size) + np.repeat(self.start[entries], size)
        return self.order[index]


def bucket_cuts(grams: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each ascending gram's slice, slice borders): buckets are equal ranges of the hash."""
    own = (((grams >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)
    cut = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
    return own[cut], np.append(cut, len(own))


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length in one value; 64-bit integers of small size in planes that compress."""
    out = [struct.pack("<I", len(arrays[0]))]
    for a in arrays:
        out.append(np.ascontiguousarray(a.view(np.uint32).reshape(-1, 2).T).tobytes() if a.dtype == np.int64 else a.tobytes())
    return b"".join(out)


def unpack(raw: bytes, *kinds: type) -> list[np.ndarray]:
    (n,) = struct.unpack_from("<I", raw)
    at, out = 4, []
    for k in kinds:
        size = np.dtype(k).itemsize * n
        if k is np.int64:
            out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint32, 2 * n, at).reshape(2, -1).T).view(np.int64).reshape(-1))
        else:
            out.append(np.frombuffer(raw, k, n, at))
        at += size
    return out


def unpack_all(blobs: list[bytes], *kinds: type) -> tuple[list[np.ndarray], np.ndarray]:
    """Columns of all blobs one after another, and which blob each row is from."""
    parts = [unpack(b, *kinds) for b in blobs]
    sizes = [len(p[0]) for p in parts]
    return [np.concatenate([np.zeros(0, k), *(p[i] for p in parts)]) for i, k in enumerate(kinds)], np.repeat(np.arange(len(parts)), sizes)


def covered(total: int, first: np.ndarray, count: np.ndarray, window: int) -> np.ndarray:
    """Which of ``total`` units lie in a window of these runs."""
    edge = np.zeros(total + 1, np.int32)
    np.add.at(edge, first, 1)
    np.add.at(edge, first + count + window - 1, -1)
    return np.cumsum(edge[:-1]) > 0
