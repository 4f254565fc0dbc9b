"""Repeated windows across all documents: the Spark plan that substring dedup and suffix-array dedup share.

Documents are dealt to shards by a hash of their id. Each shard groups its anchors and sends one small
entry for each distinct one to the bucket of its gram; the buckets answer the shards; windows that an
anchor alone doesn't settle are resolved by a second meeting, by the same key. The texts cross the
network once: all steps read the same exchange.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import Entries, Runs, anchor_runs, bucket_cuts, covered, pack, unpack_all

SPARE = "bucket int, salt int, shard int, at int, blob binary"
_SPARE = pa.schema([("bucket", pa.int32()), ("salt", pa.int32()), ("shard", pa.int32()), ("at", pa.int32()), ("blob", pa.binary())])
#: Reasons in an answer: every run of the entry goes; its first run's windows meet those of other spans.
ALL, MEET = 1, 2


def message(rows: list[tuple[int, int, int, int, bytes]]) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_SPARE)], schema=_SPARE)


@dataclass
class Shard:
    """The documents of a shard in ascending (id, text), as one row of units."""

    ids: list[int | None]
    texts: list[str | None]
    offsets: np.ndarray
    values: Callable[[int, int], np.ndarray]
    raw: object
    digests: Callable[[np.ndarray, np.ndarray], np.ndarray]

    def owner(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, places, "right") - 1


def sorted_rows(table: pa.Table) -> tuple[list[int | None], list[str | None]]:
    rows = sorted(zip(table.column("id").to_pylist(), table.column("text").to_pylist(), strict=True), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    return [r[0] for r in rows], [r[1] for r in rows]


@dataclass
class Task:
    """What differs between the operators that look for repeated windows.

    load: a shard from its table. first_stays: the earliest of equal windows stays; else all go. meet: (bucket,
    salt, salts, blob) for the second meeting, from a shard and the runs, grams and salts that MEET. settle: a
    meeting's table to messages (1, 0, shard, 0, window starts that go), or others for ``merge`` to turn into
    such. finish: the result of a shard from its removed units.
    """

    load: Callable[[pa.Table], Shard]
    window: int
    gram: int
    first_stays: bool
    meet: Callable[[Shard, Runs, np.ndarray, np.ndarray, np.ndarray], list[tuple[int, int, int, bytes]]]
    settle: Callable[[pa.Table], list[tuple[int, int, int, int, bytes]]]
    finish: Callable[[Shard, np.ndarray], pa.Table]
    result: str
    most_spans: int = 20_000


def shard_count(docs: DataFrame, text: str, shard_bytes: int) -> int:
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return 1 + total // shard_bytes


def numbered(docs: DataFrame, text: str, id_col: str, shards: int, first: int = 0) -> DataFrame:
    """(shard, id, text), with numbers of shards from ``first``."""
    key = F.pmod(F.xxhash64(F.col(id_col).cast("long")), F.lit(shards)).cast("int") + F.lit(first)
    return docs.select(key.alias("shard"), F.col(id_col).cast("long").alias("id"), F.col(text).cast("string").alias("text"))


def by_shard(rows: DataFrame) -> DataFrame:
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "shard")


def dealt(docs: DataFrame, text: str, id_col: str, shards: int) -> DataFrame:
    return by_shard(numbered(docs, text, id_col, shards))


def _send(task: Task, buckets: int) -> Callable[[pa.Table], pa.Table]:
    def send(table: pa.Table) -> pa.Table:
        shard = task.load(table)
        runs = anchor_runs(shard.values, shard.offsets, task.window, task.gram, shard.digests)
        e = Entries.of(runs)
        ids = np.array([-(2**63) if i is None else i for i in shard.ids], np.int64)
        owner = ids[shard.owner(runs.first[e.rep])] if len(e.rep) else np.zeros(0, np.int64)
        own, cut = bucket_cuts(e.gram, buckets)
        number = table.column("shard")[0].as_py()
        return message([
            (int(b), 0, number, int(lo), pack(e.gram[lo:hi], e.span[lo:hi], *([owner[lo:hi]] if task.first_stays else [(e.size[lo:hi] > 1).astype(np.uint8)])))
            for b, lo, hi in zip(own, cut[:-1], cut[1:], strict=True)
        ])

    return send


def _answer(task: Task) -> Callable[[pa.Table], pa.Table]:
    """Groups a bucket's entries by gram and span and tells each shard what to do with its own."""

    def answer(table: pa.Table) -> pa.Table:
        shards, ats = table.column("shard").to_pylist(), np.array(table.column("at").to_pylist(), np.int64)
        kinds = (np.uint64, np.uint64, np.int64 if task.first_stays else np.uint8)
        (gram, span, extra), row = unpack_all(table.column("blob").to_pylist(), *kinds)
        sizes = np.bincount(row, minlength=len(shards))
        place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + ats[row]
        if not len(gram):
            return message([])
        order = np.lexsort((extra, span, gram) if task.first_stays else (span, gram))
        g, s, x, r, p = gram[order], span[order], extra[order], row[order], place[order]
        new_gram = np.concatenate([[True], g[1:] != g[:-1]])
        new = new_gram | np.concatenate([[True], s[1:] != s[:-1]])
        group, of = np.cumsum(new) - 1, np.cumsum(new_gram) - 1
        spans = np.bincount(of[new])[of]
        many = np.zeros(len(g), bool)
        if task.first_stays:
            many = ~new
        else:
            many = (np.bincount(group)[group] > 1) | (np.bincount(group, x)[group] > 0)
        flag = ALL * many + MEET * (new & (spans > 1))
        # A gram with very many spans is dealt to several meetings.
        salts = -(-spans // task.most_spans)
        told = np.flatnonzero(flag)
        told = told[np.argsort(r[told], kind="stable")]
        rows, cut = np.unique(r[told], return_index=True)
        return message([
            (0, 0, shards[k], 0, pack(p[t].astype(np.uint32), flag[t].astype(np.uint8), salts[t].astype(np.uint32)))
            for k, t in zip(rows.tolist(), np.split(told, cut[1:]) if len(rows) else [], strict=True)
        ])

    return answer


def _read(task: Task, table: pa.Table, answers: pa.Table) -> tuple[Shard, Runs, Entries, np.ndarray, np.ndarray, np.ndarray]:
    shard = task.load(table)
    runs = anchor_runs(shard.values, shard.offsets, task.window, task.gram, shard.digests)
    (place, flag, salt), _ = unpack_all(answers.column("blob").to_pylist(), np.uint32, np.uint8, np.uint32)
    return shard, runs, Entries.of(runs), place.astype(np.int64), flag, salt


def _ask(task: Task) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def ask(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows or not answers.num_rows:
            return message([])
        shard, runs, e, place, flag, salts = _read(task, table, answers)
        meets = (flag & MEET) > 0
        order = np.lexsort((salts[meets], place[meets]))
        entry, salts = place[meets][order], salts[meets][order]
        last = np.append(entry[1:] != entry[:-1], True) if len(entry) else np.zeros(0, bool)  # answers of several batches: the latest has most salts
        entry, salts = entry[last], salts[last]
        number = table.column("shard")[0].as_py()
        return message([(b, t, number, most, blob) for b, t, most, blob in task.meet(shard, runs, e.rep[entry], e.gram[entry], salts)])

    return ask


def _settle(task: Task) -> Callable[[pa.Table], pa.Table]:
    return lambda table: message(task.settle(table))


def _finish(task: Task) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def finish(table: pa.Table, messages: pa.Table) -> pa.Table:
        kind = np.array(messages.column("bucket").to_pylist(), np.int64)
        shard, runs, e, place, flag, _ = _read(task, table, messages.filter(pa.array(kind == 0)))
        (extra,), _ = unpack_all(messages.filter(pa.array(kind == 1)).column("blob").to_pylist(), np.uint32)
        gone = np.zeros(len(runs.first), bool)
        if task.first_stays:
            gone[:] = True
            gone[e.rep] = False
        else:
            gone[e.runs_of(np.flatnonzero(e.size > 1))] = True
        gone[e.runs_of(place[(flag & ALL) > 0])] = True
        first = np.concatenate([runs.first[gone], extra.astype(np.int64)])
        count = np.concatenate([runs.count[gone], np.ones(len(extra), np.int64)])
        return task.finish(shard, covered(int(shard.offsets[-1]), first, count, task.window))

    return finish


def sent(base: DataFrame, task: Task, buckets: int) -> DataFrame:
    """Entries of all shards by bucket."""
    return base.groupBy("shard").applyInArrow(_send(task, buckets), SPARE)


def resolved(base: DataFrame, answers: DataFrame, task: Task, merge: Callable[[DataFrame], DataFrame] | None = None, shards: tuple[int, int] | None = None) -> DataFrame:
    """The result of ``task`` from the answers to the shards of ``base``; of shards [a, b) alone where these are given."""
    answers = by_shard(answers)
    asked = base.groupBy("shard").cogroup(answers.groupBy("shard")).applyInArrow(_ask(task), SPARE)
    settled = asked.groupBy("bucket", "salt").applyInArrow(_settle(task), SPARE)
    if merge is not None:
        settled = merge(settled)
    messages = answers.unionByName(settled)
    if shards is not None:
        base, messages = (x.where((F.col("shard") >= shards[0]) & (F.col("shard") < shards[1])) for x in (base, messages))
    return base.groupBy("shard").cogroup(messages.groupBy("shard")).applyInArrow(_finish(task), task.result)


def remove_windows(base: DataFrame, task: Task, buckets: int, merge: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The result of ``task`` for every document of ``base``."""
    answers = sent(base, task, buckets).groupBy("bucket").applyInArrow(_answer(task), SPARE)
    return resolved(base, answers, task, merge)
