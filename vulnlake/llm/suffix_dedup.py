"""Suffix-array deduplication of byte strings that start earlier."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import window_repeats as wr
from .anchors import Runs, bucket_cuts, pack, unpack
from .common import secret
from .ragged import byte_table, gram_hashes, run_digests

_TABLE = byte_table(11)
#: Room for the meetings of a hot gram: its meetings are numbered from 1 + _FAN times a number of the gram.
_FAN = 2000


def suffix_array(text: np.ndarray, depth: int | None = None) -> np.ndarray:
    """Suffixes of an array of symbols from 0 to 256 in ascending order of their first ``depth`` symbols (all, if None).

    Larsson and Sadakane's refinement: suffixes are first grouped by 7 symbols; groups of more than one
    are then split by the group number of the suffix h places on, and h doubles. Sorted groups are
    never touched again.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    padded = np.concatenate([text.astype(np.int64) + 1, np.zeros(7, np.int64)])
    key = np.zeros(n, np.int64)
    for j in range(7):
        key = key * 258 + padded[j : j + n]
    sa = np.argsort(key, kind="stable")
    new = np.concatenate([[True], np.diff(key[sa]) != 0])
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    start = np.flatnonzero(new)
    rank[sa] = start[np.cumsum(new) - 1]
    del padded, key
    h, active = 7, np.flatnonzero(~(new & np.append(new[1:], True)))
    while len(active) and (depth is None or h < depth):
        suffix = sa[active]
        first, second = rank[suffix], rank[np.minimum(suffix + h, n)]
        order = np.argsort(first * (n + 1) + second + 1, kind="stable")
        suffix, first, second = suffix[order], first[order], second[order]
        sa[active] = suffix
        new = np.concatenate([[True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])])
        start = active[np.flatnonzero(new)]
        rank[suffix] = start[np.cumsum(new) - 1]
        active = active[~(new & np.append(new[1:], True))]
        h *= 2
    return sa


def common_prefixes(text: np.ndarray, sa: np.ndarray, separator: int = 0) -> np.ndarray:
    """Length of the common prefix of each suffix and the one before it in ``sa``; separators match nothing.

    Kasai's recurrence: where the predecessors of two neighbouring places are neighbours as well, behind an
    equal symbol, the second length is the first less one. Only the heads of such chains are compared.
    """
    n = len(text)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    follows = np.zeros(n, bool)
    i = np.arange(1, n)
    b = before[1:]
    follows[1:] = (b > 0) & (before[:-1] == b - 1) & (before[:-1] >= 0) & (text[i - 1] == text[np.maximum(b, 1) - 1]) & (text[i - 1] != separator)
    heads = np.flatnonzero(~follows & (before >= 0))
    length = np.zeros(n, np.int64)
    step = np.arange(16)
    padded = np.concatenate([text, np.full(16, separator, text.dtype)])
    for lo in range(0, len(heads), 1 << 15):  # 16 places are looked at for each, so not for all at once
        live = heads[lo : lo + (1 << 15)]
        while len(live):
            x = padded[np.minimum(live + length[live], n)[:, None] + step]
            y = padded[np.minimum(before[live] + length[live], n)[:, None] + step]
            same = (x == y) & (x != separator)
            more = np.where(same.all(1), 16, np.argmin(same, 1))
            length[live] += more
            live = live[more == 16]
    place = np.arange(n)
    head = np.maximum.accumulate(np.where(follows, 0, place))
    length = np.where(follows, length[head] - (place - head), length)
    out[:] = length[sa]
    return out


def _load(key: bytes, table: pa.Table) -> wr.Shard:
    ids, texts = wr.sorted_rows(table)
    parts = [(t or "").encode() for t in texts]
    whole = b"".join(parts)
    raw = np.frombuffer(whole, np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts], dtype=np.int64)])
    return wr.Shard(ids, texts, offsets, lambda a, b: _TABLE[raw[a:b]], raw, lambda a, b: run_digests(whole, a, b, key))


def _meet(window: int, buckets: int, shard: wr.Shard, runs: Runs, rep: np.ndarray, gram: np.ndarray, salts: np.ndarray) -> list[tuple[int, int, int, bytes]]:
    """The bytes that the runs cover and a part of the gram's hash, by bucket of the gram and, where it is hot, salt."""
    ids = np.array([-(2**63) if i is None else i for i in shard.ids], np.int64)
    first, count = runs.first[rep], runs.count[rep]
    owner = ids[shard.owner(first)]
    slices = ((gram >> np.uint64(24)) & np.uint64(255)).astype(np.uint8)
    salt = np.where(salts > 1, 1 + _FAN * (gram & np.uint64(1023)).astype(np.int64) + (runs.span[rep] % np.maximum(salts, 1).astype(np.uint64)).astype(np.int64), 0)
    out = []
    own, cut = bucket_cuts(gram, buckets)
    for b, lo, hi in zip(own, cut[:-1], cut[1:], strict=True):
        # Runs of one message share their gram's number of meetings, so equal windows agree on it wherever they meet.
        for s, most in np.unique(np.stack([salt[lo:hi], np.where(salt[lo:hi] > 0, salts[lo:hi], 0)], 1), axis=0).tolist():
            t = lo + np.flatnonzero((salt[lo:hi] == s) & ((salts[lo:hi] == most) | (s == 0)))
            covers = count[t] + window - 1
            ends = np.cumsum(covers)
            index = np.arange(ends[-1]) - np.repeat(ends - covers, covers) + np.repeat(first[t], covers)
            out.append((int(b), s, most, pack(owner[t], first[t].astype(np.uint32), count[t].astype(np.uint32), slices[t]) + shard.raw[index].tobytes()))
    return out


def slice_batches(slices: np.ndarray, sizes: np.ndarray, most: int) -> list[np.ndarray]:
    """Runs by ascending slice in batches of whole slices, of up to ``most`` symbols or one larger slice."""
    order = np.argsort(slices, kind="stable")
    border = np.flatnonzero(np.diff(slices[order], prepend=-1)) if len(order) else np.zeros(0, np.int64)
    cuts, held = [], 0
    for at, n in zip(border.tolist(), np.add.reduceat(sizes[order], border).tolist() if len(border) else [], strict=True):
        if held and held + n > most:
            cuts.append(at)
            held = 0
        held += n
    return np.split(order, cuts)


def _settle(window: int, most: int, table: pa.Table) -> list[tuple[int, int, int, int, bytes]]:
    """Equal windows of a meeting by suffix array and common prefixes: all but the earliest go.

    Equal windows share their gram and so its slice. Slices are settled in batches of up to ``most`` symbols, so memory doesn't follow
    what meets in a bucket. A meeting of a hot gram is one of several shards; it also sends its distinct windows, sorted, to be merged.
    """
    shards, blobs = table.column("shard").to_pylist(), table.column("blob").to_pylist()
    parts, texts = [], []
    for number, fan, blob in zip(shards, table.column("at").to_pylist(), blobs, strict=True):
        owner, first, count, slices = unpack(blob, np.int64, np.uint32, np.uint32, np.uint8)
        parts.append((np.full(len(owner), number, np.int64), np.full(len(owner), fan, np.int64), owner, first.astype(np.int64), count.astype(np.int64), slices.astype(np.int16)))
        texts.append(np.frombuffer(blob, np.uint8, offset=4 + 17 * len(owner)))
    number, fans, owner, first, count, slices = (np.concatenate([p[i] for p in parts]) for i in range(6))
    raw = np.concatenate(texts)
    del parts, texts, blobs
    covers = count + window - 1
    place = np.cumsum(covers) - covers
    bucket, salt = table.column("bucket")[0].as_py(), table.column("salt")[0].as_py()
    lost, out = [], []
    for runs in slice_batches(slices, covers + 1, most):
        size = covers[runs]
        begin = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
        text = np.zeros(int((size + 1).sum()), np.int16)
        inside = np.ones(len(text), bool)
        inside[begin + size] = False
        text[inside] = raw[np.arange(int(size.sum())) + np.repeat(place[runs] - (np.cumsum(size) - size), size)].astype(np.int16) + 1
        del inside
        span, offset, later = _later(window, text, begin, size, owner[runs], first[runs], count[runs])
        run = runs[span]
        lost.append((number[run[later]], first[run[later]] + offset[later]))
        if salt and not later.all():
            run, offset, at = run[~later], offset[~later], (begin[span] + offset)[~later]
            codes = (text - 1).astype(np.uint8)
            strings = np.lib.stride_tricks.sliding_window_view(codes, window)
            fan = (gram_hashes(_TABLE[codes], window)[at] % fans[run].astype(np.uint64)).astype(np.int64)
            for f in np.unique(fan):
                k = np.flatnonzero(fan == f)
                head = pack(owner[run[k]], number[run[k]].astype(np.uint32), (first[run[k]] + offset[k]).astype(np.uint32))
                out.append((2 + bucket, (salt - 1) // _FAN * _FAN + int(f), salt, 0, head + strings[at[k]].tobytes()))
    return _marks(*(np.concatenate([x[i] for x in lost]) for i in range(2))) + out


def _later(window: int, text: np.ndarray, begin: np.ndarray, size: np.ndarray, owner: np.ndarray, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(run, offset in it, whether an equal one is earlier) of all windows, in ascending order of what they hold."""
    sa = suffix_array(text, window)
    alike = np.cumsum(common_prefixes(text, sa) < window)
    span = np.repeat(np.arange(len(begin)), size + 1)[sa]
    offset = sa - begin[span]
    mine = offset < count[span]
    span, offset, alike = span[mine], offset[mine], alike[mine]
    order = np.lexsort((first[span] + offset, owner[span], alike))
    alike = alike[order]
    later = np.zeros(len(order), bool)
    later[1:] = alike[1:] == alike[:-1]
    return span[order], offset[order], later


def _marks(who: np.ndarray, place: np.ndarray) -> list[tuple[int, int, int, int, bytes]]:
    order = np.lexsort((place, who))
    who, place = who[order], place[order]
    rows, cut = np.unique(who, return_index=True)
    return [(1, 0, int(k), 0, pack(p.astype(np.uint32))) for k, p in zip(rows, np.split(place, cut[1:]) if len(rows) else [], strict=True)]


def merge_sorted(lists: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(shard, place) of the strings that some other list has earlier; each list is (strings ascending, id, shard, place).

    Lists are merged one by one: binary search finds each string of a list among those merged so far.
    """
    keys, own, who, place = lists[0]
    lost: list[tuple[np.ndarray, np.ndarray]] = []
    for k, o, w, p in lists[1:]:
        to = np.searchsorted(keys, k)
        hit = (to < len(keys)) & (keys[np.minimum(to, len(keys) - 1)] == k) if len(keys) else np.zeros(len(k), bool)
        t = to[hit]
        later = (o[hit] > own[t]) | ((o[hit] == own[t]) & (p[hit] > place[t]))
        lost.append((np.where(later, w[hit], who[t]), np.where(later, p[hit], place[t])))
        own, who, place = own.copy(), who.copy(), place.copy()
        for base, new in ((own, o), (who, w), (place, p)):
            base[t] = np.where(later, base[t], new[hit])
        keys, own, who, place = (np.insert(base, to[~hit], new[~hit]) for base, new in ((keys, k), (own, o), (who, w), (place, p)))
    return tuple(np.concatenate([np.zeros(0, np.int64), *(x[i] for x in lost)]).astype(np.int64) for i in range(2))


def _merge(window: int, table: pa.Table) -> pa.Table:
    """Passes marks on; merges the sorted windows of the shards of hot grams."""
    if table.column("bucket")[0].as_py() == 1:
        return table
    lists = []
    for blob in table.column("blob").to_pylist():
        own, who, place = unpack(blob, np.int64, np.uint32, np.uint32)
        strings = np.frombuffer(blob, np.dtype(f"S{window}"), offset=4 + 16 * len(own))
        order = np.argsort(strings, kind="stable")
        lists.append((strings[order], own[order], who[order].astype(np.int64), place[order].astype(np.int64)))
    return wr.message(_marks(*merge_sorted(lists)))


_RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])


def _finish(shard: wr.Shard, gone: np.ndarray) -> pa.Table:
    offsets = shard.offsets
    removed = np.concatenate([[0], np.cumsum(gone)])
    removed = removed[offsets[1:]] - removed[offsets[:-1]]
    spans, kept = [], []
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        if not removed[i]:
            spans.append([])
            kept.append(shard.raw[a:b].tobytes())
            continue
        edge = np.flatnonzero(np.diff(np.concatenate([[0], gone[a:b].view(np.int8), [0]]))).tolist()
        spans.append([{"start": x, "end": y} for x, y in zip(edge[::2], edge[1::2], strict=True)])
        kept.append(shard.raw[a:b][~gone[a:b]].tobytes())
    return pa.Table.from_arrays([pa.array(shard.ids, pa.int64()), pa.array(np.diff(offsets)), pa.array(removed.astype(np.int64)), pa.array(spans, _RESULT.field(3).type), pa.array(kept, pa.binary())], schema=_RESULT)


def remove_repeated_bytes(docs: DataFrame, text: str = "text", id_col: str = "doc_id", window: int = 100, gram: int = 32, shard_bytes: int = 2_000_000, most_spans: int = 5_000, most_symbols: int = 500_000) -> DataFrame:
    """Remove each UTF-8 byte covered by a ``window``-byte string that also starts earlier.

    Earlier: in a document of smaller id, or in the same one before. Matches don't cross documents and are
    judged on the input. Result: the id, n_bytes, n_removed, spans (maximal removed runs), kept (bytes).

    Anchors bring equal strings to one meeting; what they cover there is sorted by a suffix array and
    compared by common prefixes, up to ``most_symbols`` at a time, or all that one gram brings. A gram with
    over ``most_spans`` different surroundings has several meetings, each with a suffix array of its own,
    merged by binary search.

    Null text is empty. Ids are integers; rows that share one are ordered by text, null ids come first.
    Texts shorter than ``window`` lose nothing; very long ones go segment by segment to their end. An empty table gives an empty result; other columns are left out.
    """
    shards = wr.shard_count(docs, text, shard_bytes)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(n, shards)
    load = partial(_load, secret(docs.sparkSession))
    task = wr.Task(load, window, gram, True, partial(_meet, window, buckets), partial(_settle, window, most_symbols), _finish, "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary", most_spans)
    join = lambda settled: settled.groupBy("bucket", "salt", F.when(F.col("bucket") == 1, F.col("shard")).alias("to")).applyInArrow(lambda table: _merge(window, table), wr.SPARE)
    out = wr.remove_windows(wr.dealt(docs, text, id_col, shards), task, buckets, merge=join)
    return out.withColumnRenamed("doc_id", id_col)
