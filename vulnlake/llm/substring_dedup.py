"""Substring deduplication with a log-structured index of window fingerprints."""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Callable
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import window_repeats as wr
from .anchors import Runs, anchor_runs, bucket_cuts, pack, unpack, unpack_all
from .common import delete_path, hash_base, secret, shared_path
from .ragged import BASE, byte_table, run_digests, word_hashes

_TABLE = byte_table(7)
_RUN = pa.schema([("bucket", pa.int32()), ("blob", pa.binary())])
#: An entry of a run: gram, span, how often the shard has both, shard, place among the shard's entries.
_ENTRY = (np.uint64, np.uint64, np.uint32, np.uint32, np.uint32)


def _words(parts: list[bytes], base: int = BASE) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words of all texts with a space between, start and end of each in it, hash of each, offsets of the documents in words)."""
    split = [p.split() for p in parts]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in split], dtype=np.int64)])
    raw = b" ".join(w for x in split for w in x)
    begin, end, hashes = word_hashes(raw, _TABLE, base=base)
    return raw, begin, end, hashes, offsets


def _load(key: bytes, base: int, table: pa.Table) -> wr.Shard:
    ids, texts = wr.sorted_rows(table)
    raw, begin, end, hashes, offsets = _words([(t or "").encode() for t in texts], base)
    return wr.Shard(ids, texts, offsets, lambda a, b: hashes[a:b], raw, lambda a, b: run_digests(raw, begin[a], end[b - 1], key))


def _entries(load: Callable[[pa.Table], wr.Shard], window: int, gram: int, buckets: int) -> Callable[[pa.Table], pa.Table]:
    """Entries of a shard by bucket of the anchor: see FingerprintIndex."""

    def entries(table: pa.Table) -> pa.Table:
        shard = load(table)
        e = wr.Entries.of(anchor_runs(shard.values, shard.offsets, window, gram, shard.digests))
        own, cut = bucket_cuts(e.gram, buckets)
        number = np.full(len(e.gram), table.column("shard")[0].as_py(), np.uint32)
        columns = (e.gram, e.span, e.size.astype(np.uint32), number, np.arange(len(e.gram), dtype=np.uint32))
        return pa.Table.from_arrays([pa.array(own.astype(np.int32)), pa.array([pack(*(c[x:y] for c in columns)) for x, y in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], schema=_RUN)

    return entries


def _run(table: pa.Table) -> pa.Table:
    """The entries of a bucket in one row, sorted."""
    (gram, span, size, shard, place), _ = unpack_all(table.column("blob").to_pylist(), *_ENTRY)
    order = np.lexsort((place, shard, span, gram))
    return pa.Table.from_arrays([table.column("bucket").slice(0, 1).combine_chunks().cast(pa.int32()), pa.array([pack(*(x[order] for x in (gram, span, size, shard, place)))], pa.binary())], schema=_RUN)


def _fresh(new: pa.Table, old: pa.Table) -> pa.Table:
    """Of a batch's fingerprints of a bucket: how many there are, how many history has."""
    (grams, *_), _ = unpack_all(new.column("blob").to_pylist(), *_ENTRY)
    (known, *_), _ = unpack_all(old.column("blob").to_pylist(), *_ENTRY)
    grams = np.unique(grams)
    return pa.table({"bucket": new.column("bucket").slice(0, 1).cast(pa.int32()), "fingerprints": pa.array([len(grams)][: new.num_rows], pa.int64()), "seen": pa.array([int(np.isin(grams, known).sum())][: new.num_rows], pa.int64())})


def _match(held: bool, most_spans: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Merge-joins a batch's run of a bucket with those of history and tells the shards of both what to do.

    An entry whose anchor and surroundings are there twice goes whole. Entries that share an anchor alone meet;
    history's are told to only where the batch has surroundings that are new. Where the batch is ``held`` by
    history, that is what counts, and history isn't told to remove anything.
    """

    def match(new: pa.Table, old: pa.Table) -> pa.Table:
        own, _ = unpack_all(new.column("blob").to_pylist(), *_ENTRY)
        grams = own[0]
        if not len(grams):
            return wr.message([])
        parts = [own]
        for blob in old.column("blob").to_pylist():
            part = unpack(blob, *_ENTRY)
            both = grams[np.minimum(np.searchsorted(grams, part[0]), len(grams) - 1)] == part[0]
            parts.append([x[both] for x in part])
        gram, span, size, shard, place = (np.concatenate(x) for x in zip(*parts, strict=True))
        fresh = np.arange(len(gram)) < len(grams)
        order = np.lexsort((place, shard, ~fresh, span, gram))
        gram, span, size, shard, place, fresh = (x[order] for x in (gram, span, size, shard, place, fresh))
        new_gram = np.concatenate([[True], gram[1:] != gram[:-1]])
        first = new_gram | np.concatenate([[True], span[1:] != span[:-1]])
        group, of = np.cumsum(first) - 1, np.cumsum(new_gram) - 1
        spans = np.bincount(of[first])[of]
        twice = np.bincount(group, size * ~fresh if held else size) > 1
        in_batch = np.bincount(group, fresh) > 0
        asks = in_batch & ~twice if held else np.bincount(group, ~fresh) == 0
        flag = wr.ALL * ((twice & in_batch)[group] & (fresh | (not held)))
        flag = flag + wr.MEET * (first & (spans > 1) & (np.bincount(of[first], asks) > 0)[of])
        # A gram with very many spans is dealt to several meetings.
        salts = -(-spans // most_spans)
        told = np.flatnonzero(flag)
        told = told[np.argsort(shard[told], kind="stable")]
        to, cut = np.unique(shard[told], return_index=True)
        return wr.message([
            (0, 0, k, 0, pack(place[t], flag[t].astype(np.uint8), salts[t].astype(np.uint32)))
            for k, t in zip(to.tolist(), np.split(told, cut[1:]) if len(to) else [], strict=True)
        ])

    return match


class FingerprintIndex:
    """Sorted immutable runs of fingerprints of all ``window``-word windows seen so far, in the folder ``path``.

    A fingerprint is the hash of a window's anchor. A run is a Parquet folder with one row for each bucket (an
    equal range of hashes): entries ascending, each with its fingerprint, a keyed digest of the words of the
    windows around that anchor, how often the shard has both, the shard and the place in it. ``append`` merge-joins a
    batch with the runs before it, keeps what the join tells the shards of both sides, and adds the batch as one
    run; ``compact`` merges runs once there are ``fanout`` of them. Runs are never changed, only replaced.

    Documents aren't copied: batches are read again where entries that share an anchor meet on whole windows, so
    their frames must give the same rows each time.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int, window: int = 35, gram: int = 8, fanout: int = 2, shard_bytes: int = 2_000_000, most_spans: int = 20_000):
        self.spark, self.path, self.buckets, self.window, self.gram, self.fanout = spark, path, buckets, window, gram, fanout
        self.shard_bytes, self.most_spans = shard_bytes, most_spans
        self.load = partial(_load, secret(spark), hash_base(spark))
        self.runs: list[str] = []
        self.batches: list[tuple[DataFrame, tuple[int, int]]] = []
        self.answers: list[str] = []

    @property
    def shards(self) -> int:
        return self.batches[-1][1][1] if self.batches else 0

    def task(self) -> wr.Task:
        return wr.Task(self.load, self.window, self.gram, False, partial(_meet, self.window, self.buckets), _settle, _finish, "doc_id long, n_words long, n_removed long, spans array<struct<start:long,end:long>>, kept string", self.most_spans)

    def _numbered(self, docs: DataFrame, text: str, id_col: str) -> tuple[DataFrame, tuple[int, int]]:
        shards = wr.shard_count(docs, text, self.shard_bytes)
        return wr.numbered(docs, text, id_col, shards, self.shards), (self.shards, self.shards + shards)

    def _of(self, rows: DataFrame) -> DataFrame:
        sent = wr.by_shard(rows).groupBy("shard").applyInArrow(_entries(self.load, self.window, self.gram, self.buckets), "bucket int, blob binary")
        return sent.groupBy("bucket").applyInArrow(_run, "bucket int, blob binary")

    def _matched(self, run: DataFrame, held: bool) -> DataFrame:
        return run.groupBy("bucket").cogroup(self.rows().groupBy("bucket")).applyInArrow(_match(held, self.most_spans), wr.SPARE)

    def append(self, docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> None:
        rows, shards = self._numbered(docs, text, id_col)
        run = self._write(self._of(rows))
        self.answers.append(f"{self.path}/answers-{uuid.uuid4().hex}")
        self._matched(self._read([run]), False).write.option("compression", "none").parquet(self.answers[-1])
        self.runs.append(run)
        self.batches.append((rows, shards))
        if len(self.runs) >= self.fanout:
            self.compact()

    def overlap(self, docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
        """By bucket, how many distinct fingerprints a new batch has and how many of them are in the index."""
        return self._of(self._numbered(docs, text, id_col)[0]).groupBy("bucket").cogroup(self.rows().groupBy("bucket")).applyInArrow(_fresh, "bucket int, fingerprints long, seen long")

    def _write(self, rows: DataFrame) -> str:
        path = f"{self.path}/run-{uuid.uuid4().hex}"
        rows.write.option("compression", "none").parquet(path)
        return path

    def _read(self, runs: list[str]) -> DataFrame:
        return self.spark.read.schema("bucket int, blob binary").parquet(*runs)

    def rows(self) -> DataFrame:
        return self._read(self.runs) if self.runs else self.spark.createDataFrame([], "bucket int, blob binary")

    def compact(self) -> None:
        """Merge all runs into one and delete them."""
        old = self.runs
        self.runs = [self._write(self.rows().groupBy("bucket").applyInArrow(_run, "bucket int, blob binary"))]
        for path in old:
            delete_path(self.spark, path)

    def result(self, batch: int | None = None) -> DataFrame:
        """remove_repeated_windows of all documents of the index; of a batch of them where its number is given."""
        base = wr.by_shard(reduce(DataFrame.unionByName, (rows for rows, _ in self.batches)))
        return wr.resolved(base, self.spark.read.schema(wr.SPARE).parquet(*self.answers), self.task(), shards=None if batch is None else self.batches[batch][1])

    def compared(self, docs: DataFrame, held: bool, text: str = "text", id_col: str = "doc_id") -> DataFrame:
        """remove_repeated_windows of documents that the index ``held`` already, or of new ones, without a change to it."""
        rows, shards = self._numbered(docs, text, id_col)
        base = wr.by_shard(reduce(DataFrame.unionByName, (old for old, _ in self.batches), rows))
        return wr.resolved(base, self._matched(self._of(rows), held), self.task(), shards=shards)


def _meet(window: int, buckets: int, shard: wr.Shard, runs: Runs, rep: np.ndarray, gram: np.ndarray, salts: np.ndarray) -> list[tuple[int, int, int, bytes]]:
    """Digests of the words of these runs' windows, by bucket of the gram and, where it is hot, of the window's hash."""
    count = runs.count[rep]
    ends = np.cumsum(count)
    start = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - count, count) + np.repeat(runs.first[rep], count)
    hashes = shard.digests(start, start + window)
    grams, most = np.repeat(gram, count), np.repeat(salts, count)
    salt = np.where(most > 1, 1 + (hashes % np.maximum(most, 1).astype(np.uint64)).astype(np.int64), 0)
    out = []
    own, cut = bucket_cuts(grams, buckets)
    for b, lo, hi in zip(own, cut[:-1], cut[1:], strict=True):
        for s in np.unique(salt[lo:hi]):
            t = lo + np.flatnonzero(salt[lo:hi] == s)
            out.append((int(b), int(s), 0, pack(grams[t], hashes[t], start[t].astype(np.uint32))))
    return out


def _settle(table: pa.Table) -> list[tuple[int, int, int, int, bytes]]:
    shards = table.column("shard").to_pylist()
    (gram, hashes, place), row = unpack_all(table.column("blob").to_pylist(), np.uint64, np.uint64, np.uint32)
    order = np.lexsort((hashes, gram))
    g, h = gram[order], hashes[order]
    same = (g[1:] == g[:-1]) & (h[1:] == h[:-1])
    twice = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])] if len(order) else order
    twice = twice[np.lexsort((place[twice], row[twice]))]
    rows, cut = np.unique(row[twice], return_index=True)
    return [(1, 0, shards[k], 0, pack(place[t])) for k, t in zip(rows.tolist(), np.split(twice, cut[1:]) if len(rows) else [], strict=True)]


_RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.string())])


def _finish(shard: wr.Shard, gone: np.ndarray) -> pa.Table:
    offsets = shard.offsets
    removed = np.concatenate([[0], np.cumsum(gone)])
    removed = removed[offsets[1:]] - removed[offsets[:-1]]
    spans, kept = [], []
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        words = (shard.texts[i] or "").encode().split()
        if removed[i]:
            edge = np.flatnonzero(np.diff(np.concatenate([[0], gone[a:b].view(np.int8), [0]]))).tolist()
            spans.append([{"start": x, "end": y} for x, y in zip(edge[::2], edge[1::2], strict=True)])
            words = itertools.compress(words, (~gone[a:b]).tolist())
        else:
            spans.append([])
        kept.append(b" ".join(words).decode())
    return pa.Table.from_arrays([pa.array(shard.ids, pa.int64()), pa.array(np.diff(offsets)), pa.array(removed.astype(np.int64)), pa.array(spans, _RESULT.field(3).type), pa.array(kept, pa.string())], schema=_RESULT)


def remove_repeated_windows(docs: DataFrame, index: FingerprintIndex | None = None, text: str = "text", id_col: str = "doc_id", window: int = 35, gram: int = 8, shard_bytes: int = 2_000_000, batches: int = 2, most_spans: int = 20_000, held: bool = True) -> DataFrame:
    """Remove each word covered by a ``window``-word window whose words also start anywhere else.

    With an ``index``, anywhere in the index: it must hold ``docs``, or, where ``held`` is false, none of them, and
    ``docs`` are compared with it and with each other. Without one, an index is built in the shared folder:
    each of ``batches`` parts is merge-joined with the parts before it, which removes on both sides, then appended.
    Windows whose anchor is in the index once are unique. Those around an anchor whose surroundings repeat go; others
    that share an anchor are verified one by one. What is equal is told by keyed digests of the words themselves, never by the hashes that find anchors. Judged on the input.
    Result: the id, n_words, n_removed, spans (maximal removed runs of words), kept (words joined by one space).

    Null text has no words. Ids are integers; rows that repeat one are documents of their own, so
    repeated rows lose all their windows. Texts under ``window`` words lose nothing; very long ones go segment by segment to their end. An empty table
    gives an empty result; other columns are left out.
    """
    spark = docs.sparkSession
    if index is not None:
        return index.compared(docs, held, text, id_col).withColumnRenamed("doc_id", id_col)
    shards = wr.shard_count(docs, text, shard_bytes)
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), shards)
    index = FingerprintIndex(spark, shared_path(spark, "index"), buckets, window, gram, batches, shard_bytes, most_spans)
    for b in range(batches):
        index.append(docs.where(F.pmod(F.xxhash64(F.col(id_col).cast("long"), F.lit("batch")), F.lit(batches)) == b), text, id_col)
    return index.result().withColumnRenamed("doc_id", id_col)
