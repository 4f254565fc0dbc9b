"""MinHash near-deduplication by a multi-index Hamming join."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import bucket_cuts, pack, unpack_all
from .common import broadcast_if_small, components, drop_staged, hash_base, stage
from .ragged import BASE, byte_table, chunks, mixed, run_hashes, word_hashes

_U = np.uint64
#: A signature: VALUES b-bit MinHash values, b = 16, in CHUNKS chunks of WIDTH.
VALUES, CHUNKS, WIDTH = 48, 12, 4
#: Signatures that differ in up to this many values are candidates. By pigeonhole such a pair has a chunk with
#: at most MAX_DISTANCE // CHUNKS = 1 different value, so leaving out each value of a chunk in turn meets every
#: pair. At a likeness of 0.8 the distance is 9.6 on average with a deviation of 2.8.
MAX_DISTANCE = 2 * CHUNKS - 1
_TABLE = byte_table(3, lower=True)
_SEEDS = mixed(np.arange(1, VALUES + 1, dtype=_U) * _U(0xA0761D6478BD642F)) | _U(1)
_LOWEST = -(2**63)
#: Cells by the leading bits of a shingle hash, in which the shingles of a document are counted.
CELL_BITS = 10


def shingles(parts: list[bytes], words: int, base: int = BASE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text: runs of ``words`` lower-cased words, the whole where there are fewer."""
    out = []
    raw = b"\n".join(parts)
    starts = np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts], dtype=np.int64)])
    begin, _, hashes = word_hashes(raw, _TABLE, base=base)
    offsets = np.searchsorted(begin, starts)
    at = np.arange(max(0, len(hashes) - words + 1))
    runs = run_hashes(hashes, at, at + words, base)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(runs[a : b - words + 1]))
        else:
            out.append(run_hashes(hashes, np.array([a]), np.array([b]), base) if b > a else np.zeros(0, _U))
    return out


def signature(s: np.ndarray) -> bytes:
    """The low 16 bits of the smallest hash under each of VALUES permutations."""
    low = np.full(VALUES, np.iinfo(np.uint64).max, _U)
    for i in range(0, len(s), 4096):
        x = s[i : i + 4096, None] * _SEEDS
        np.minimum(low, (x ^ (x >> _U(29))).min(0), out=low)
    return mixed(low).astype("<u2").tobytes()


_SIGNED = pa.schema([("k", pa.int64()), ("n", pa.int64()), ("ha", pa.int64()), ("hb", pa.int64()), ("sig", pa.binary())])


def _sign(words: int, base: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, parts in chunks(batch.column(1), 2_000_000):
                sets = shingles(parts, words, base)
                sums = np.array([[int(s.sum()), int(mixed(s ^ _U(0x5851F42D4C957F2D)).sum())] for s in sets], _U).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(parts)), pa.array([len(s) for s in sets], pa.int64()), pa.array(sums[:, 0]), pa.array(sums[:, 1]), pa.array([signature(s) if len(s) else None for s in sets], pa.binary())], schema=_SIGNED)

    return sign


def cell_counts(s: np.ndarray) -> np.ndarray:
    """How many of the hashes lie in each cell, up to 255."""
    counts = np.bincount((s >> _U(64 - CELL_BITS)).astype(np.int64), minlength=1 << CELL_BITS)
    return np.minimum(counts, 255).astype(np.uint8)


def most_common(cells: np.ndarray, over: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """No pair of rows (a, b) has more hashes in common: per cell the smaller count, and what counts leave ``over``."""
    out = np.minimum(over[a], over[b])
    for i in range(0, len(a), 8192):
        out[i : i + 8192] += np.minimum(cells[a[i : i + 8192]], cells[b[i : i + 8192]]).sum(1, dtype=np.int64)
    return out


def chunk_keys(sigs: np.ndarray) -> np.ndarray:
    """(rows, CHUNKS * WIDTH) keys: each chunk with each of its values left out in turn."""
    parts = sigs.reshape(-1, CHUNKS, WIDTH).astype(_U)
    out = np.empty((len(sigs), CHUNKS, WIDTH), _U)
    for w in range(WIDTH):
        rest = [v for v in range(WIDTH) if v != w]
        packed = (parts[:, :, rest[0]] << _U(32)) | (parts[:, :, rest[1]] << _U(16)) | parts[:, :, rest[2]]
        out[:, :, w] = mixed(packed + (np.arange(CHUNKS, dtype=_U) * _U(WIDTH) + _U(w + 1)) * _U(0x9E3779B97F4A7C15))
    return out.reshape(len(sigs), -1)


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of different values of signatures, row by row."""
    return (a != b).sum(-1)


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, VALUES)


_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])
_KEYED = pa.schema([("bucket", pa.int32()), ("blob", pa.binary()), ("a", pa.int64()), ("b", pa.int64())])


def _leaders(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(keys, smallest id of each, and the distinct pairs (id, smallest id) of those that share a key)."""
    order = np.lexsort((ids, keys))
    k, i = keys[order], ids[order]
    new = np.concatenate([[True], k[1:] != k[:-1]]) if len(k) else np.zeros(0, bool)
    low = i[np.flatnonzero(new)]
    of = low[np.cumsum(new) - 1] if len(k) else i
    away = i != of
    pairs = np.unique(np.stack([i[away], of[away]], 1), axis=0)
    return k[new], low, pairs[:, 0], pairs[:, 1]


def _local(buckets: int):
    """Links rows of a batch to the smallest with the same key; only that one goes on to the key's bucket."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sigs, ids = _signatures(batch.column(1)), batch.column(0).to_numpy()
            keys = chunk_keys(sigs)
            key, low, a, b = _leaders(keys.reshape(-1), np.repeat(ids, keys.shape[1]))
            own, cut = bucket_cuts(key, buckets)
            n, m = len(own), len(a)
            yield pa.RecordBatch.from_arrays([
                pa.array([*own.tolist(), *[-1] * m], pa.int32()), pa.array([*(pack(key[x:y], low[x:y]) for x, y in zip(cut[:-1], cut[1:], strict=True)), *[b""] * m], pa.binary()),
                pa.array([*[0] * n, *a.tolist()], pa.int64()), pa.array([*[0] * n, *b.tolist()], pa.int64()),
            ], schema=_KEYED)

    return local


def _meet(table: pa.Table) -> pa.Table:
    (keys, ids), _ = unpack_all(table.column("blob").to_pylist(), _U, np.int64)
    _, _, a, b = _leaders(keys, ids)
    return pa.Table.from_arrays([pa.array(a), pa.array(b)], schema=_PAIRS)


def _grouped(buckets: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, comp = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            keys = chunk_keys(_signatures(batch.column(1)))
            flat = keys.reshape(-1)
            order = np.argsort(flat, kind="stable")
            row = order // keys.shape[1]
            own, cut = bucket_cuts(flat[order], buckets)
            blobs = [pack(flat[order[x:y]], ids[row[x:y]], comp[row[x:y]]) for x, y in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(blobs, pa.binary())], names=["bucket", "blob"])

    return send


def _mixed_keys(table: pa.Table) -> pa.Table:
    """Members of keys that more than one component shares; keys with the same members count once."""
    (keys, ids, comp), _ = unpack_all(table.column("blob").to_pylist(), _U, np.int64, np.int64)
    order = np.lexsort((ids, comp, keys))
    k, i, c = keys[order], ids[order], comp[order]
    new = np.concatenate([[True], k[1:] != k[:-1]])
    of = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    differs = np.zeros(len(first), bool)
    np.logical_or.at(differs, of, c != c[first][of])
    members = np.add.reduceat(mixed(i.view(_U)), first)
    _, once = np.unique(members, return_index=True)
    chosen = np.zeros(len(first), bool)
    chosen[once] = True
    t = (differs & chosen)[of]
    return pa.Table.from_arrays([pa.array(members[of[t]].view(np.int64)), pa.array(i[t])], schema=_MEMBERS)


_MEMBERS = pa.schema([("group", pa.int64()), ("k", pa.int64())])


def _members(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, components, set sizes, signatures) of a group, each id once, by component and id."""
    by = table.sort_by([("comp", "ascending"), ("k", "ascending")])
    ids, comp, n = (by.column(c).to_numpy() for c in ("k", "comp", "n"))
    once = np.concatenate([[True], ids[1:] != ids[:-1]])
    return ids[once], comp[once], n[once], _signatures(by.column("sig").combine_chunks())[once]


def _pairs(ids: np.ndarray, p: list[np.ndarray], q: list[np.ndarray]) -> pa.Table:
    a, b = (np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64) for x in (p, q))
    return pa.Table.from_arrays([pa.array(np.maximum(ids[a], ids[b])), pa.array(np.minimum(ids[a], ids[b]))], schema=_PAIRS)


def _alike(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    return 100 * np.minimum(n, m) >= percent * np.maximum(n, m)


def _hubs(table: pa.Table, percent: int) -> pa.Table:
    """Pairs of a group's members with their hub, if within MAX_DISTANCE, of like size and in another component.

    A hub is the member nearest to the most frequent value of each place of the signatures, as the origin
    of a group of copies is; members too far from it have further hubs of their own.
    """
    ids, comp, n, sigs = _members(table)
    left, p, q = np.arange(len(ids)), [], []
    while len(left) > 1:
        own = sigs[left]
        if len(left) <= 64:
            far = (own[:, None] != own[None]).sum((1, 2))
        else:
            usual = []
            for column in own.T:
                v, c = np.unique(column, return_counts=True)
                usual.append(v[np.argmax(c)])
            far = distance(own, np.array(usual, own.dtype))
        hub = left[np.argmin(far)]
        near = (distance(sigs, sigs[hub]) <= MAX_DISTANCE) & _alike(n, n[hub], percent)
        found = np.flatnonzero(near & (comp != comp[hub]))
        p.append(found)
        q.append(np.full(len(found), hub))
        left = left[~near[left]]
    return _pairs(ids, p, q)


def _across(table: pa.Table, percent: int) -> pa.Table:
    """All pairs of a group, or of both sides of a pair of its blocks, in different components within MAX_DISTANCE whose sizes allow a link.

    Of n shingles, u are in no other document that is still compared, so two documents have at most
    min(n - u) in common. Their counts in cells bound it further.
    """
    ids, comp, n, sigs = _members(table)
    by = table.sort_by([("comp", "ascending"), ("k", "ascending")])
    once = np.concatenate([[True], np.diff(by.column("k").to_numpy()) != 0])
    shared, side = by.column("shared").to_numpy()[once], by.column("side").to_numpy()[once]
    cells = np.frombuffer(b"".join(by.column("cells").filter(pa.array(once)).to_pylist()), np.uint8).reshape(len(ids), -1)
    over = n - cells.sum(1, dtype=np.int64)
    p, q = [], []
    for lo in range(0, len(ids), 512):
        for at in range(lo, len(ids), 4096):
            x, y = slice(lo, lo + 512), slice(at, at + 4096)
            if comp[lo] == comp[min(len(ids), at + 4096) - 1]:
                continue  # sorted: one component throughout
            most = np.minimum(shared[x, None], shared[None, y])
            i, j = np.nonzero((100 * most >= percent * (n[x, None] + n[None, y] - most)) & (comp[x, None] < comp[None, y]) & ((side[x, None] != side[None, y]) | (side[x, None] == 2)))
            for s in range(0, len(i), 200_000):
                a, b = i[s : s + 200_000] + lo, j[s : s + 200_000] + at
                near = distance(sigs[a], sigs[b]) <= MAX_DISTANCE
                a, b = a[near], b[near]
                common = np.minimum(most_common(cells, over, a, b), np.minimum(shared[a], shared[b]))
                allowed = 100 * common >= percent * (n[a] + n[b] - common)
                p.append(a[allowed])
                q.append(b[allowed])
    return _pairs(ids, p, q)


def _compared(compare: Callable[[pa.Table, int], pa.Table], percent: int) -> Callable[[pa.Table], pa.Table]:
    return lambda table: compare(table, percent)


def _dealt(groups: DataFrame, most: int, salt: int) -> DataFrame:
    """Members of groups in blocks of about ``most`` by a hash of the id: (group, k, x, y, side), y always 0."""
    large = stage(groups.groupBy("group").agg(F.ceil(F.count("*") / most).cast("int").alias("blocks")).where("blocks > 1"), "large")
    block = F.pmod(F.xxhash64("k", F.lit(salt)), F.coalesce("blocks", F.lit(1))).cast("int")
    return groups.join(broadcast_if_small(large), "group", "left").select("group", "k", block.alias("x"), F.lit(0).alias("y"), F.lit(2).alias("side"))


def _block_pairs(groups: DataFrame, known: DataFrame, most: int) -> DataFrame:
    """Members of groups once for each pair of blocks (x, y) to compare: (group, k, x, y, side).

    A group of up to ``most`` members is one block. In others a component of over ``most`` has blocks of its own, by a
    hash of the id, which aren't compared with each other; smaller components share blocks, by a hash of the component.
    """
    alone = lambda rows: rows.select("group", "k", F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(2).alias("side"))
    large = stage(groups.groupBy("group").agg(F.count("*").alias("size")).where(F.col("size") > most), "large")
    if large.isEmpty():
        return alone(groups)
    own = groups.join(broadcast_if_small(large), "group").join(known.select(F.col("rep").alias("k"), "comp"), "k")
    # At most one in ``most`` memberships makes a large group or a large component of one.
    hot = stage(own.groupBy("group", "comp").agg(F.count("*").alias("n")).where(F.col("n") > most), "hot")
    rest = large.join(hot.groupBy("group").agg(F.sum("n").alias("hot")), "group", "left").select("group", F.ceil((F.col("size") - F.coalesce("hot", F.lit(0))) / most).cast("int").alias("blocks"))
    hot = hot.select("group", "comp", F.ceil(F.col("n") / most).cast("int").alias("own"))
    name = lambda comp, number: F.struct(comp.alias("comp"), number.cast("int").alias("number"))
    none = F.lit(None).cast("long")
    block = F.when(F.col("own").isNotNull(), name(F.col("comp"), F.pmod(F.xxhash64("k"), F.col("own")))).otherwise(name(none, F.pmod(F.xxhash64("comp"), F.greatest("blocks", F.lit(1)))))
    own = stage(own.join(broadcast_if_small(hot), ["group", "comp"], "left").join(broadcast_if_small(rest), "group").select("group", "k", block.alias("block")), "blocks")
    blocks = own.select("group", "block").distinct()
    pairs = blocks.withColumnRenamed("block", "p").join(blocks.withColumnRenamed("block", "q"), "group").where("p <= q and not (p.comp is not null and q.comp is not null and p.comp = q.comp)")
    # A pair's numbers only tell pairs of a group apart.
    pairs = stage(pairs.withColumn("x", F.xxhash64("p", F.lit(1))).withColumn("y", F.xxhash64("q", F.lit(2))), "block-pairs")
    side = lambda c, s: own.join(pairs.select("group", F.col(c).alias("block"), "x", "y", F.when(F.expr("p = q"), F.lit(2)).otherwise(F.lit(s)).alias("side"), F.expr("p = q").alias("same")), ["group", "block"])
    both = side("p", 0).unionByName(side("q", 1).where("not same")).select("group", "k", "x", "y", "side")
    return alone(groups.join(broadcast_if_small(large), "group", "left_anti")).unionByName(both)


def _spread(words: int, buckets: int, base: int):
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, parts in chunks(batch.column(1), 2_000_000):
                sets = shingles(parts, words, base)
                hashes = np.concatenate(sets)
                owner = np.repeat(batch.column(0).slice(first, len(parts)).to_numpy(), [len(s) for s in sets])
                order = np.argsort(hashes, kind="stable")
                hashes, owner = hashes[order], owner[order]
                own, cut = bucket_cuts(hashes, buckets)
                yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array([pack(hashes[x:y], owner[x:y]) for x, y in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], names=["bucket", "blob"])

    return spread


def _counted(words: int, base: int):
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, parts in chunks(batch.column(1), 2_000_000):
                sets = shingles(parts, words, base)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(parts)), pa.array([len(s) for s in sets], pa.int64()), pa.array([cell_counts(s).tobytes() for s in sets], pa.binary())], names=["k", "n", "cells"])

    return counted


def _alone(parts: int):
    """How many shingles of the bucket each document has to itself, packed by part of the documents."""

    def alone(table: pa.Table) -> pa.Table:
        (hashes, owner), _ = unpack_all(table.column("blob").to_pylist(), _U, np.int64)
        _, at, count = np.unique(hashes, return_index=True, return_counts=True)
        k, u = np.unique(owner[at[count == 1]], return_counts=True)
        part = (mixed(k.view(_U)) % _U(parts)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        own, cut = np.unique(part[order], return_index=True)
        blobs = [pack(k[t], u[t].astype(np.int64)) for t in np.split(order, cut[1:])] if len(own) else []
        return pa.Table.from_arrays([pa.array(own, pa.int32()), pa.array(blobs, pa.binary())], names=["part", "blob"])

    return alone


def _summed(table: pa.Table) -> pa.Table:
    (k, u), _ = unpack_all(table.column("blob").to_pylist(), np.int64, np.int64)
    k, of = np.unique(k, return_inverse=True)
    return pa.Table.from_arrays([pa.array(k), pa.array(np.bincount(of, u, len(k)).astype(np.int64))], names=["k", "u"])


def _likely(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Pairs whose signatures and set sizes allow a link, with the size of both."""

    @F.pandas_udf("int")
    def apart(x, y):
        import pandas as pd

        return pd.Series(distance(np.frombuffer(b"".join(x), "<u2").reshape(-1, VALUES), np.frombuffer(b"".join(y), "<u2").reshape(-1, VALUES)).astype(np.int32))

    a, b = (reps.select(F.col("rep").alias(c), F.col("n").alias(f"n_{c}"), F.col("sig").alias(f"sig_{c}")) for c in "ab")
    both = pairs.join(a, "a").join(b, "b").where(F.expr(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)"))
    return both.withColumn("d", apart("sig_a", "sig_b")).where(F.col("d") <= MAX_DISTANCE).select("a", "b", "n_a", "n_b")


def _confirm(words: int, percent: int, base: int):
    """Full sets of one document and of those paired with it; its own text comes in the row without ``a``."""

    def confirm(table: pa.Table) -> pa.Table:
        a = table.column("a").to_pylist()
        order = sorted(range(len(a)), key=lambda i: a[i] is not None)
        texts = table.column("text")
        leader = shingles([(texts[order[0]].as_py() or "").encode()], words, base)[0]
        found = []
        for s in range(1, len(order), 64):
            part = order[s : s + 64]
            for i, x in zip(part, shingles([(texts[j].as_py() or "").encode() for j in part], words, base), strict=True):
                at = np.minimum(np.searchsorted(leader, x), len(leader) - 1)
                both = int((leader[at] == x).sum()) if len(leader) else 0
                if 100 * both >= percent * (len(x) + len(leader) - both):
                    found.append(a[i])
        b = table.column("b")[0].as_py()
        return pa.Table.from_arrays([pa.array(found, pa.int64()), pa.array([b] * len(found), pa.int64())], schema=_PAIRS)

    return confirm


def _verified(pairs: DataFrame, texts: DataFrame, words: int, percent: int, base: int, shingles_each: int = 400_000) -> DataFrame:
    """Pairs (a, b) whose full sets are alike. A document with many partners is sent to several groups."""
    fans = pairs.groupBy("b").agg(F.ceil(F.sum("n_a") / shingles_each).cast("int").alias("fans"))
    left = pairs.join(fans, "b").select("b", F.pmod(F.xxhash64("a"), F.col("fans")).cast("int").alias("fan"), "a")
    left = left.join(texts.select(F.col("k").alias("a"), "text").hint("merge"), "a").select("b", "fan", "a", "text")
    right = fans.join(texts.select(F.col("k").alias("b"), "text").hint("merge"), "b").select("b", F.explode(F.sequence(F.lit(0), F.col("fans") - 1)).alias("fan"), F.lit(None).cast("long").alias("a"), "text")
    return left.unionByName(right).groupBy("b", "fan").applyInArrow(_confirm(words, percent, base), "a long, b long")


def _joined(known: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component) after links between nodes of ``known``: only the components that they join are gone through again."""
    name = lambda c: known.select(F.col("rep").alias(c), F.col("comp").alias(f"of_{c}"))
    joined = components(links.join(name("a"), "a").join(name("b"), "b").select("of_a", "of_b"), "of_a", "of_b").select(F.col("node").alias("comp"), "component")
    out = known.select("rep", "comp").join(joined, "comp", "left").select(F.col("rep").alias("node"), F.coalesce("component", "comp").alias("component"))
    return stage(out, "components")


def near_duplicates(docs: DataFrame, text: str = "text", id_col: str = "doc_id", words: int = 5, percent: int = 80, most: int = 4096) -> DataFrame:
    """``id_col``, n_shingles, component_id, kept of every document.

    Documents are linked when 100 * |common shingles| >= ``percent`` * |all shingles|, confirmed on full
    sets; component_id is the smallest id reachable. Equal sets are one class, whose smallest id stands for
    it. Signatures meet under CHUNKS * WIDTH keys each; under a key, every class is first compared with the
    smallest (within a task before the shuffle, then across tasks), so a large group yields one pair for
    each member. Keys that still join different components compare their members with hubs, twice; what then
    remains yields all its pairs across components within MAX_DISTANCE, less those that their shingles in
    no other of these documents, or their counts of shingles in cells of the hash range, rule out for certain.
    Members under a key are dealt to tasks in blocks of about ``most``: hubs are found within blocks, dealt anew
    for the second time, and the last comparison takes pairs of blocks. Candidates are confirmed on the texts.

    ``percent`` under 80 is an error: MAX_DISTANCE would miss links.

    Null, empty and wordless texts have no shingles and are linked with nothing. A very long text is one document whose words are hashed segment by segment. Ids are integers; a null id
    counts as the smallest. Rows that share an id share a fate: they are taken as linked. An empty table gives
    an empty result; other columns are left out.
    """
    if percent < 80:
        raise ValueError("percent under 80: signatures would miss pairs")
    spark = docs.sparkSession
    base = hash_base(spark)
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LOWEST)).alias("k"), F.col(text).cast("string").alias("text"))
    signed = stage(texts.mapInArrow(_sign(words, base), "k long, n long, ha long, hb long, sig binary"), "signed")
    reps = stage(signed.where("n > 0").groupBy("ha", "hb").agg(F.min("k").alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig")), "classes")
    # A bucket holds the entries of about 20,000 classes, 24 bytes for each of their keys.
    buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), reps.count() // 20_000)
    local = stage(reps.select("rep", "sig").mapInArrow(_local(buckets), "bucket int, blob binary, a long, b long"), "keys")
    met = local.where("bucket >= 0").select("bucket", "blob").groupBy("bucket").applyInArrow(_meet, "a long, b long")
    pairs = stage(local.where("bucket < 0").select("a", "b").unionByName(met).distinct(), "pairs")
    met_any = pairs.select(F.col("a").alias("k")).unionByName(pairs.select(F.col("b").alias("k"))).distinct()
    # Ids that meet any other; their number follows the input, so they are merged with the texts, not broadcast.
    texts = stage(texts.hint("merge").join(met_any, "k", "left_semi"), "texts")
    met_reps = stage(reps.join(met_any.withColumnRenamed("k", "rep"), "rep", "left_semi"), "met")
    likely = stage(_likely(pairs, met_reps, percent), "likely")
    links = stage(_verified(likely, texts, words, percent, base), "links")
    tried, comp, used = likely.select("a", "b"), components(links, "a", "b"), [local, pairs, texts, met_reps, likely, links]
    for number, final in enumerate((False, False, True)):
        known = stage(met_reps.join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("rep", "sig", F.coalesce("component", "rep").alias("comp"), "n"), "known")
        groups = stage(known.select("rep", "sig", "comp").mapInArrow(_grouped(buckets), "bucket int, blob binary").groupBy("bucket").applyInArrow(_mixed_keys, "group long, k long").distinct(), "groups")
        used += [known, groups]
        if groups.isEmpty():
            break
        members = known.withColumnRenamed("rep", "k")
        if final:
            left = texts.hint("merge").join(groups.select("k").distinct(), "k", "left_semi")
            parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
            alone = left.mapInArrow(_spread(words, buckets, base), "bucket int, blob binary").groupBy("bucket").applyInArrow(_alone(parts), "part int, blob binary").groupBy("part").applyInArrow(_summed, "k long, u long")
            members = members.join(alone, "k", "left").withColumn("shared", F.col("n") - F.coalesce("u", F.lit(0))).where(F.col("shared") * 100 >= F.col("n") * percent).drop("u")
            members = stage(members.join(groups.select("k").distinct(), "k", "left_semi"), "members")
            used.append(members)
            left = texts.hint("merge").join(members.select("k").distinct(), "k", "left_semi")
            groups = groups.join(members.select("k"), "k", "left_semi")
            members = members.join(left.mapInArrow(_counted(words, base), "k long, n long, cells binary"), ["k", "n"])
        dealt = _block_pairs(groups, known, most) if final else _dealt(groups, most, number)
        found = dealt.join(members, "k").groupBy("group", "x", "y").applyInArrow(_compared(_across if final else _hubs, percent), "a long, b long").distinct()
        found = stage(found.join(tried, ["a", "b"], "left_anti").join(reps.select(F.col("rep").alias("a"), F.col("n").alias("n_a")), "a"), "found")
        used.append(found)
        if found.isEmpty():
            continue
        links = stage(_verified(found, texts, words, percent, base), "links")
        used.append(links)
        tried, comp = tried.unionByName(found.select("a", "b")), _joined(known, links)
    drop_staged(*used)
    classes = reps.join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("ha", "hb", F.coalesce("component", "rep").alias("component_id"))
    found = signed.where("n > 0").join(classes, ["ha", "hb"]).select("k", "n", "component_id").unionByName(signed.where("n = 0").select("k", "n", F.col("k").alias("component_id")))
    back = lambda c: F.when(F.col(c) != _LOWEST, F.col(c))
    return found.select(back("k").alias(id_col), F.col("n").alias("n_shingles"), back("component_id").alias("component_id"), (F.col("k") == F.col("component_id")).alias("kept"))
