"""A prefix trie of conversations from rolling fingerprints."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_staged, stage
from .ragged import PRIME, powers_mod, product_mod, sums_mod

#: Codes of turns are below 2**60; those that a collision of two texts splits off lie above.
_CODES = 2**60
_BLOCK = 4096
_EMPTY = hashlib.sha256(b"").hexdigest()
_NODE = ["depth", "print", "class"]


def turn_code(role: Column, text: Column) -> Column:
    return F.xxhash64(role, text).bitwiseAND(F.lit(_CODES - 1))


def _turns(turns: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    own = [F.col(conv_id).cast("long").alias("c"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")]
    return turns.where(F.col(conv_id).isNotNull()).select(*own)


def _coded(rows: DataFrame, code) -> DataFrame:
    """Turns with a code for each distinct (role, text): hashes, checked on the texts; texts that share one are split."""
    coded = rows.withColumn("code", code(F.col("role"), F.col("text")))
    texts = coded.select("code", "role", "text").distinct()
    shared = texts.groupBy("code").count().where("count > 1").select("code")
    split = stage(texts.join(shared, "code"), "split-turns")
    if split.isEmpty():
        drop_staged(split)
        return coded
    number = F.row_number().over(Window.partitionBy("code").orderBy("role", "text"))
    split = stage(split.withColumn("other", F.lit(_CODES) + F.col("code") % F.lit(1 << 36) * (1 << 22) + number), "split-turns")
    if split.groupBy("other").count().where("count > 1").count():
        raise ValueError("codes of split turns aren't distinct")
    return coded.join(split, ["code", "role", "text"], "left").withColumn("code", F.coalesce("other", "code")).drop("other")


_CHUNK = pa.schema([("c", pa.int64()), ("part", pa.int32()), ("seq", pa.int64()), ("n", pa.int64()), ("codes", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64()))])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns of a sorted partition in chunks of one conversation, numbered in the partition."""
    part, seq = TaskContext.get().partitionId(), 0
    for batch in batches:
        for lo in range(0, batch.num_rows, _BLOCK):
            piece = batch.slice(lo, _BLOCK)
            c, codes, sizes = (piece.column(i).to_numpy() for i in range(3))
            cut = np.concatenate([[0], np.flatnonzero(c[1:] != c[:-1]) + 1, [len(c)]])
            offsets = pa.array(cut.astype(np.int32))
            m = len(cut) - 1
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (codes, sizes)]
            yield pa.RecordBatch.from_arrays([pa.array(c[cut[:-1]]), pa.array(np.full(m, part, np.int32)), pa.array(np.arange(seq, seq + m)), pa.array(np.diff(cut)), *lists], schema=_CHUNK)
            seq += m


def _chunks(coded: DataFrame) -> DataFrame:
    """(c, start, n, codes, sizes): the turns of each conversation in order, in chunks that a hot conversation spreads over partitions."""
    keys = ["c", "turn", "role", F.substring("text", 1, 64)]
    dealt = coded.repartitionByRange(*keys).sortWithinPartitions("c", "turn", "role", "text")
    packed = stage(dealt.select("c", "code", F.octet_length("text").cast("long")).mapInArrow(_pack, "c long, part int, seq long, n long, codes array<long>, sizes array<long>"), "turns")
    before = Window.partitionBy("c").orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = packed.select("c", "part", "seq", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return packed.join(starts, ["c", "part", "seq"]).select("c", "start", "n", "codes", "sizes")


def _rebuilt(chunks: DataFrame, group: int, most: int) -> tuple[DataFrame, DataFrame]:
    """(pieces (c, start, codes, sizes) of the rebuilt conversations, their lengths (c, total)).

    Conversation c gets the first h turns of conversation c - c % group, then its own after its first h; h = crc32(c) % most.
    """
    known = chunks.groupBy("c").agg(F.sum("n").alias("n")).select("c", "n", (F.crc32(F.col("c").cast("string").cast("binary")) % most).alias("h"), (F.col("c") - F.col("c") % group).alias("base"))
    heads = known.select(F.col("c").alias("base"), F.col("n").alias("base_n"))
    info = known.join(heads, "base", "left").select("c", "base", "h", "n", F.least("h", F.coalesce("base_n", F.lit(0))).alias("taken"))
    skip = F.greatest(F.col("h") - F.col("start"), F.lit(0))
    tail = lambda x: F.slice(x, (skip + 1).cast("int"), F.greatest(F.col("k") - skip, F.lit(0)).cast("int"))
    own = chunks.withColumnRenamed("n", "k").join(info.drop("n"), "c").where(F.col("start") + F.col("k") > F.col("h"))
    own = own.select("c", (F.col("start") + skip - F.col("h") + F.col("taken")).alias("start"), tail("codes").alias("codes"), tail("sizes").alias("sizes"))
    first = chunks.where(F.col("start") < most - 1).select(F.col("c").alias("base"), "start", F.posexplode(F.arrays_zip("codes", "sizes")).alias("i", "x"))
    first = first.select("base", (F.col("start") + F.col("i")).alias("at"), "x").where(F.col("at") < most - 1)
    taken = first.join(info.select("c", "base", "h"), "base").where("at < h").groupBy("c").agg(F.sort_array(F.collect_list(F.struct("at", "x"))).alias("xs"))
    taken = taken.select("c", F.lit(0).cast("long").alias("start"), F.col("xs.x.codes").alias("codes"), F.col("xs.x.sizes").alias("sizes"))
    total = info.select("c", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("total"))
    return taken.unionByName(own), total


def _whole(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    return chunks.select("c", "start", "codes", "sizes"), chunks.groupBy("c").agg(F.sum("n").alias("total"))


def _powers_at(base: int, places: np.ndarray, prime: int) -> np.ndarray:
    """base**place for each place: powers inside a block of places, times those of the blocks that occur."""
    blocks, of = np.unique(places // _BLOCK, return_inverse=True)
    high = np.array([pow(base, int(b) * _BLOCK, prime) for b in blocks], np.uint64)
    return product_mod(powers_mod(base, 0, _BLOCK, prime)[places % _BLOCK], high[of], prime)


def _scan(prime: int, base: int, last: bool):
    """Sums of code * base**place of whole pieces; with ``last``, all prefixes of each piece, given the sum before it. All pieces of a batch at once."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.list_value_length(batch.column("codes")).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(sizes)
            begin = ends - sizes
            codes = batch.column("codes").flatten().to_numpy(zero_copy_only=False).astype(np.uint64)
            places = np.arange(len(codes)) - np.repeat(begin, sizes) + np.repeat(batch.column("start").to_numpy(), sizes)
            running = np.concatenate([np.zeros(1, np.uint64), sums_mod(product_mod(codes % np.uint64(prime), _powers_at(base, places, prime), prime), prime)])
            minus = lambda x, y: (x + (np.uint64(prime) - y)) % np.uint64(prime)
            if not last:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(minus(running[ends], running[begin]).astype(np.int64))], names=[*batch.schema.names, "piece"])
                continue
            # What lies before a piece takes the place of what the batch has summed up to it.
            shift = np.repeat(minus(batch.column("before").to_numpy().astype(np.uint64), running[begin]), sizes)
            own, up = ((x + shift) % np.uint64(prime) for x in (running[1:], running[:-1]))
            index = pa.array(np.repeat(np.arange(batch.num_rows), sizes))
            rest = [n for n in batch.schema.names if n not in ("codes", "sizes", "start", "before", "piece")]
            columns = [pa.array(places + 1), pa.array(own.astype(np.int64)), pa.array(up.astype(np.int64)), batch.column("codes").flatten(), batch.column("sizes").flatten(), *(batch.column(n).take(index) for n in rest)]
            yield pa.RecordBatch.from_arrays(columns, names=["depth", "print", "parent", "code", "size", *rest])

    return scan


def _prefixes(pieces: DataFrame, prime: int, base: int) -> DataFrame:
    """(depth, print, parent, code, size, c, total) for each turn: the fingerprint of the prefix that it ends."""
    schema = "depth long, print long, parent long, code long, size long, c long, total long"
    return pieces.select("c", "total", "start", "codes", "sizes", "before").mapInArrow(_scan(prime, base, True), schema)


def _split(rows: DataFrame) -> DataFrame:
    """Rows with a class for each group of one fingerprint whose prefixes differ; the smallest member's prefix keeps class 0.

    A row leaves its class where its turn or its parent's class isn't that of the class's first row. What left is split by what it
    has instead, and checked again, so classes end up with equal turns and equal parents all the way up.
    """
    rows = stage(rows.withColumn("class", F.lit(0).cast("long")).withColumn("parent_class", F.lit(0).cast("long")), "prefixes")
    while True:
        first = rows.groupBy(*_NODE).agg(F.min_by(F.struct("code", "parent", "parent_class"), "c").alias("r"))
        off = F.struct("code", "parent", "parent_class") != F.col("r")
        away = F.xxhash64("class", "code", "parent", "parent_class")
        moved = rows.join(first, _NODE).select("depth", "print", F.when(off, away).otherwise(F.col("class")).alias("class"), "parent", "code", "size", "c", "total", off.alias("off"))
        moved = stage(moved, "prefixes")
        changed = moved.where("off").count()
        up = moved.select("c", (F.col("depth") + 1).alias("depth"), F.col("class").alias("parent_class"))
        after = stage(moved.drop("off").join(up, ["c", "depth"], "left").withColumn("parent_class", F.coalesce("parent_class", F.lit(0))), "prefixes")
        drop_staged(moved, rows)
        rows = after
        if not changed:
            return rows


def _nodes(rows: DataFrame) -> DataFrame:
    same = [F.min(x).alias(x) for x in ("code", "parent", "parent_class", "size")]
    spread = [(F.min(x) != F.max(x)) for x in ("code", "parent", "parent_class")]
    return rows.groupBy(*_NODE).agg(F.min("c").alias("c"), F.count(F.lit(1)).alias("n"), *same, (spread[0] | spread[1] | spread[2]).alias("mixed"))


_TEXT = "depth long, print long, class long, first long, ids string"
_ENDS = "depth long, print long, class long, ends_sha256 string"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    for batch in batches:
        keys = np.stack([batch.column(i).to_numpy() for i in range(3)], 1)
        cut = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1, [len(keys)]])
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            if b > a:
                yield tuple(keys[a].tolist()), batch.slice(a, b - a)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ascending ids of one node in one text for each run of a batch."""
    for key, run in _runs(batches):
        ids = run.column(3).to_pylist()
        for lo in range(0, len(ids), _BLOCK):
            part = ids[lo : lo + _BLOCK]
            yield pa.RecordBatch.from_pydict({"depth": [key[0]], "print": [key[1]], "class": [key[2]], "first": part[:1], "ids": [",".join(map(str, part))]})


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, state = None, None
    out = lambda: pa.RecordBatch.from_pydict({"depth": [held[0]], "print": [held[1]], "class": [held[2]], "ends_sha256": [state.hexdigest()]})
    for key, run in _runs(batches):
        for ids in run.column(4).to_pylist():
            if key == held:
                state.update(b",")
            else:
                if held is not None:
                    yield out()
                held, state = key, hashlib.sha256()
            state.update(ids.encode())
    if held is not None:
        yield out()


def _ends(rows: DataFrame) -> DataFrame:
    """SHA-256 of the ids that end at a node. The hash of one node's ids is a chain, so their texts pass one task, in packs and as a stream."""
    packed = rows.select(*_NODE, "c").repartitionByRange(*_NODE, "c").sortWithinPartitions(*_NODE, "c").mapInArrow(_joined, _TEXT)
    return packed.repartition(*_NODE).sortWithinPartitions(*_NODE, "first").mapInArrow(_hashed, _ENDS)


def conversation_trie(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", rebuild: tuple[int, int] | None = None, code=turn_code, prime: int = PRIME, base: int = 0x1B873593_5F0A1C3D % PRIME, hot_share: int = 10_000) -> DataFrame:
    """The trie of all conversations' prefixes, one row for each node, the textless root included.

    A conversation is the rows of one id by turn (null first), ties by role, then text; with ``rebuild`` = (group, most) it is rebuilt, see
    ``_rebuilt``. Each distinct (role, text) has a code that is checked on the texts; the fingerprint of a prefix is the sum
    of code * base**place modulo a prime, from numpy scans of chunks and sums of the chunks before. Prefixes that share one are a node if all
    have their representative's last turn and parent, which is checked for each turn; otherwise they are split.

    Result, long unless said: conv_id (smallest member), depth, parent_conv_id, n_convs (members), n_children, n_leaves, saved_tokens (for each node of the subtree, members less
    one times the UTF-8 bytes of its last text), ends_sha256 (string: SHA-256 of the ids of members that end here, ascending, joined by commas).

    Sums over subtrees need no walk: a node belongs to its smallest member, that of a node below it is a member of the node too, so a
    sum over a subtree is the sum of its members' own nodes, less those of the smallest member that lie above. Depth
    is not bound. Null role or text is empty. Rows without an id are left out; rows that repeat are turns of their own. Other columns are ignored. An empty table gives an empty result.
    """
    chunks = _chunks(_coded(_turns(turns, conv_id, turn, role, text), code))
    pieces, total = _rebuilt(chunks, *rebuild) if rebuild else _whole(chunks)
    total = stage(total, "lengths")
    pieces = pieces.join(total, "c").select("c", "total", "start", "codes", "sizes")
    pieces = stage(pieces.mapInArrow(_scan(prime, base, False), "c long, total long, start long, codes array<long>, sizes array<long>, piece long"), "pieces")
    up = Window.partitionBy("c").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    before = pieces.select("c", "start", (F.coalesce(F.sum(F.col("piece").cast("decimal(38,0)")).over(up), F.lit(0)) % F.lit(prime)).cast("long").alias("before"))
    pieces = pieces.join(before, ["c", "start"])
    zero = F.lit(0).cast("long")
    roots = total.select(zero.alias("depth"), zero.alias("print"), zero.alias("parent"), zero.alias("code"), zero.alias("size"), "c", "total")
    rows = _prefixes(pieces, prime, base).unionByName(roots)
    rows = rows.withColumn("class", zero).withColumn("parent_class", zero)
    nodes = stage(_nodes(rows), "nodes")
    if nodes.where("mixed").limit(1).count():
        rows = _split(rows.drop("class", "parent_class"))
        drop_staged(nodes)
        nodes = stage(_nodes(rows), "nodes")
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("print"), F.col("parent_class").alias("class")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.drop("mixed").join(children, _NODE, "left").withColumn("n_children", F.coalesce("n_children", zero))
    nodes = stage(nodes.withColumn("saved", (F.col("n") - 1) * F.col("size")).withColumn("block", F.floor(F.col("depth") / _BLOCK)), "trie")
    # What a conversation's own nodes save, and how many of them are leaves; conversations without either add nothing.
    own = nodes.groupBy("c").agg(F.sum("saved").alias("own_saved"), F.sum((F.col("n_children") == 0).cast("long")).alias("own_leaves")).where("own_saved > 0 OR own_leaves > 0")
    sums = rows.select(*_NODE, "c").join(own, "c").groupBy(*_NODE).agg(F.sum("own_saved").alias("all_saved"), F.sum("own_leaves").alias("n_leaves"))
    # Running sums along a conversation's own nodes, in blocks of depths.
    blocks = nodes.groupBy("c", "block").agg(F.sum("saved").alias("s"))
    blocks = blocks.select("c", "block", F.coalesce(F.sum("s").over(Window.partitionBy("c").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), zero).alias("above"))
    inside = F.coalesce(F.sum("saved").over(Window.partitionBy("c", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)), zero)
    out = nodes.withColumn("inside", inside).join(blocks, ["c", "block"]).join(sums, _NODE, "left")
    out = out.join(_ends(rows.where("depth = total")), _NODE, "left")
    # Parents with many children: hot_share of them at most.
    n = nodes.count()
    tops = nodes.where("n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("print").alias("parent"), F.col("class").alias("parent_class"), F.col("c").alias("parent_conv_id"), (F.col("n_children") > n // hot_share + 1).alias("hot"))
    keys = ["depth", "parent", "parent_class"]
    out = out.join(F.broadcast(tops.where("hot").withColumnRenamed("parent_conv_id", "hot_conv_id").drop("hot")), keys, "left").join(tops.where("NOT hot").drop("hot"), keys, "left")
    saved = (F.coalesce("all_saved", zero) - F.col("above") - F.col("inside")).alias("saved_tokens")
    parent = F.when(F.col("depth") > 0, F.coalesce("hot_conv_id", "parent_conv_id")).alias("parent_conv_id")
    return out.select(F.col("c").alias("conv_id"), "depth", parent, F.col("n").alias("n_convs"), "n_children", F.coalesce("n_leaves", zero).alias("n_leaves"), saved, F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256"))
