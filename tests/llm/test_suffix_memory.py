"""Suffix dedup: what the meetings of anchors with very many surroundings hold at once, and that they lose no window."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa

from vulnlake.llm import suffix_dedup


def by_hand(rows, window=100):
    seen, out = set(), {}
    for i, t in rows:
        b, gone = t.encode(), set()
        for at in range(len(b) - window + 1):
            if b[at : at + window] in seen:
                gone.update(range(at, at + window))
            seen.add(b[at : at + window])
        out[i] = len(gone)
    return out


def by_key(tables, *keys):
    """Groups of the rows of these tables, as Spark would hand them over."""
    table = pa.concat_tables(tables)
    groups = {}
    for i, k in enumerate(zip(*(table.column(c).to_pylist() for c in keys), strict=True)):
        groups.setdefault(k, []).append(i)
    return {k: table.take(pa.array(rows)) for k, rows in groups.items()}


def task_of(spark, monkeypatch, most_spans):
    """The task, buckets and window of remove_repeated_bytes, without a run."""
    held = {}

    class Stop(Exception):
        pass

    def caught(base, task, buckets, merge=None):
        held["task"] = (task, buckets)
        raise Stop

    monkeypatch.setattr(suffix_dedup.wr, "remove_windows", caught)
    try:
        suffix_dedup.remove_repeated_bytes(spark.createDataFrame([(1, "a")], "doc_id long, text string"), most_spans=most_spans)
    except Stop:
        pass
    return held["task"]


def test_meetings_of_hot_anchors_are_small(spark, monkeypatch):
    """One line in every document: each of its meetings holds 2,000 surroundings, and far less than all windows of them at once."""
    wr = suffix_dedup.wr
    task, buckets = task_of(spark, monkeypatch, 2000)
    rng = random.Random(9)
    word = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=n))
    line, rows = word(90), []
    for i in range(6000):
        rows.append((i, f"{word(80)}\n{line}\n{word(80)}"))
    rows += [(6000 + i, rows[rng.randrange(3000)][1][rng.randrange(60) :] + word(30)) for i in range(60)]
    shards = {k: pa.table({"shard": pa.array([k] * len(r), pa.int32()), "id": pa.array([i for i, _ in r], pa.int64()), "text": [t for _, t in r]}) for k, r in ((s, [x for x in rows if x[0] % 3 == s]) for s in range(3))}
    sent = [wr._send(task, buckets)(t) for t in shards.values()]
    answers = by_key([wr._answer(task)(t) for t in by_key(sent, "bucket").values()], "shard")
    asked = by_key([wr._ask(task)(t, answers[(k,)]) for k, t in shards.items()], "bucket", "salt")
    assert any(salt > 0 for _, salt in asked)
    settled, peaks = [], []
    for table in asked.values():
        tracemalloc.start()
        settled.append(wr._settle(task)(table))
        peaks.append(tracemalloc.get_traced_memory()[1] / 1e6)
        tracemalloc.stop()
    assert max(peaks) < 100, peaks
    again = {}
    for (bucket, _, to), table in by_key([t.append_column("to", pa.array([s if b == 1 else None for b, s in zip(t.column("bucket").to_pylist(), t.column("shard").to_pylist(), strict=True)], pa.int32())) for t in settled], "bucket", "salt", "to").items():
        for key, part in by_key([suffix_dedup._merge(task.window, table.drop(["to"]))], "shard").items():
            again.setdefault(key[0], []).append(part)
    out = {}
    for k, t in shards.items():
        done = wr._finish(task)(t, pa.concat_tables([answers[(k,)], *again.get(k, [])]))
        out |= dict(zip(done.column("doc_id").to_pylist(), done.column("n_removed").to_pylist(), strict=True))
    assert out == by_hand(rows)


def test_batches_are_whole_slices():
    slices, sizes = np.array([3, 0, 3, 9, 0, 200], np.int16), np.array([5, 4, 5, 50, 4, 1])
    for most in (1, 8, 12, 18, 1000):
        parts = suffix_dedup.slice_batches(slices, sizes, most)
        assert sorted(np.concatenate(parts).tolist()) == list(range(6))
        held = [set(slices[p].tolist()) for p in parts]
        assert all(a.isdisjoint(b) for i, a in enumerate(held) for b in held[:i])
        assert all(sizes[p].sum() <= most or len(h) == 1 for p, h in zip(parts, held, strict=True))
    assert sum(map(len, suffix_dedup.slice_batches(slices[:0], sizes[:0], 5))) == 0
