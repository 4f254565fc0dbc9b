"""Token ids in binary shards, compressed by Re-Pair grammars."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import ragged
from .common import shared_path

MAGIC = b"RPR1"

# --- grammar ------------------------------------------------------------------------------------


def _replaced(symbols: np.ndarray, last: np.ndarray, weights: np.ndarray | None, rules: list[np.ndarray], first_free: int, min_count: int) -> tuple[np.ndarray, np.ndarray]:
    """Replace pairs until none occurs ``min_count`` times; ``last`` tells which symbols end a unit, which no pair crosses.

    Each round counts the pairs, a run of one symbol without overlaps, and ranks those that are frequent enough.
    Of overlapping places the pair of better rank is replaced, so the most frequent one always is, everywhere. A
    pair that keeps too few places this way waits for the next round, which looks at the places of frequent pairs
    and beside new symbols only: no other pair can have become frequent. ``weights`` counts a unit more than once.
    """
    symbols, last = symbols.astype(np.int64), last.copy()
    at = np.flatnonzero(~last[:-1])
    pairs = (symbols[at] << 32) | symbols[at + 1]
    slots = ((pairs.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int32)  # 2**20 counters
    counts = np.bincount(slots, None if weights is None else weights[at], minlength=1 << 20)
    at = at[(counts >= min_count)[slots]]  # a counter is never below the count of its pairs
    while len(at):
        pairs = (symbols[at] << 32) | symbols[at + 1]
        counted = np.ones(len(at), bool)
        equal = np.flatnonzero(symbols[at] == symbols[at + 1])
        if len(equal):
            begin = np.maximum.accumulate(np.where(np.concatenate([[True], np.diff(at[equal]) > 1]), np.arange(len(equal)), 0))
            counted[equal[(np.arange(len(equal)) - begin) % 2 == 1]] = False
        found, of = np.unique(pairs, return_inverse=True)
        count = np.bincount(of, counted if weights is None else weights[at] * counted, minlength=len(found))
        often = (count >= min_count)[of]
        at, of, counted = at[often], of[often], counted[often]
        if not len(at):
            break
        rank = np.empty(len(found), np.int64)
        rank[np.lexsort((found, -count))] = np.arange(len(found))
        tried, own = at[counted], of[counted]
        place, close = rank[own], np.diff(tried) == 1
        taken = np.ones(len(tried), bool)
        taken[1:] &= ~close | (place[1:] < place[:-1])
        taken[:-1] &= ~close | (place[:-1] < place[1:])
        used = np.bincount(own[taken], None if weights is None else weights[tried[taken]], minlength=len(found)) >= min_count
        taken &= used[own]
        tried, own = tried[taken], own[taken]
        symbols[tried] = (first_free - 1 + np.cumsum(used))[own]
        rules.append(np.stack([found[used] >> 32, found[used] & 0xFFFFFFFF], 1))
        first_free += len(rules[-1])
        keep = np.ones(len(symbols), bool)
        keep[tried + 1] = False
        last[tried] = last[tried + 1]
        look = np.zeros(len(symbols), bool)
        look[at] = True
        look[tried] = True
        before = tried - 1
        before -= ~keep[before]  # the symbol before may be a new one itself
        look[before[tried > 0]] = True
        look &= keep & ~last
        symbols, last, look = symbols[keep], last[keep], look[keep]
        weights = None if weights is None else weights[keep]
        at = np.flatnonzero(look[:-1])
    return symbols, last


def repair(words: np.ndarray, ends: np.ndarray, values: np.ndarray, starts: np.ndarray, first_rule: int, min_count: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, end of each document among them, rules): frequent pairs replaced by nonterminals.

    A shard is a row of ``words``, word w being the ids values[starts[w] : starts[w + 1]], and ``ends`` of documents
    among these words. Pairs inside words are counted and replaced in the distinct words first, each as often as it
    occurs; then all pairs inside documents, until no pair occurs ``min_count`` times: a rule takes three numbers
    in the shard, so a rarer pair would cost more than it saves. Rule i stands for symbol ``first_rule`` + i and refers
    only to symbols before it.
    """
    rules: list[np.ndarray] = [np.zeros((0, 2), np.int64)]
    times = np.bincount(words, minlength=len(starts) - 1)
    distinct = np.flatnonzero(times)
    number = np.cumsum(times > 0) - 1
    symbols, at = ragged.gather(values, starts, distinct)
    symbols, last = _replaced(symbols, _ends(at[1:], len(symbols)), np.repeat(times[distinct], np.diff(at)).astype(np.float64), rules, first_rule, min_count)
    at = np.concatenate([[0], np.flatnonzero(last) + 1])
    symbols, word_at = ragged.gather(symbols, at, number[words])
    ends = word_at[ends]
    symbols, last = _replaced(symbols, _ends(ends, len(symbols)), None, rules, first_rule + sum(map(len, rules)), min_count)
    full = np.diff(np.concatenate([[0], ends])) > 0
    now = np.concatenate([[0], np.flatnonzero(last) + 1])
    return symbols, now[np.cumsum(full)], np.concatenate(rules)


def _ends(ends: np.ndarray, size: int) -> np.ndarray:
    last = np.zeros(size, bool)
    last[ends[ends > 0] - 1] = True
    return last


def expansion_lengths(rules: np.ndarray, first_rule: int) -> np.ndarray:
    """Token ids that each rule stands for."""
    lengths = [1] * len(rules)
    for i, (a, b) in enumerate(rules.tolist()):
        lengths[i] = (lengths[a - first_rule] if a >= first_rule else 1) + (lengths[b - first_rule] if b >= first_rule else 1)
    return np.array(lengths, np.int64)


def expand(symbols: np.ndarray, rules: np.ndarray, lengths: np.ndarray, first_rule: int) -> np.ndarray:
    """Undo the rules: each level writes the ids that it reaches to their places and goes on with the other symbols."""
    symbols = symbols.astype(np.int64)
    big = symbols >= first_rule
    width = np.ones(len(symbols), np.int64)
    width[big] = lengths[symbols[big] - first_rule]
    ends = np.cumsum(width)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.int64)
    place = ends - width
    while True:
        out[place[~big]] = symbols[~big]
        rule, place = symbols[big] - first_rule, place[big]
        if not len(rule):
            return out
        left, right = rules[rule, 0], rules[rule, 1]
        step = np.ones(len(rule), np.int64)
        deep = left >= first_rule
        step[deep] = lengths[left[deep] - first_rule]
        symbols, place = np.concatenate([left, right]), np.concatenate([place, place + step])
        big = symbols >= first_rule


# --- shard format -------------------------------------------------------------------------------
# MAGIC, then little-endian: u32 documents, u32 rules, u32 first rule, u64 symbols; i64 document ids;
# u64 symbol ends; u64 token ends; u32 rule pairs; u32 expansion lengths; u32 symbols.


def pack_words(doc_ids: list[int], words: np.ndarray, word_ends: np.ndarray, values: np.ndarray, starts: np.ndarray, first_rule: int, **options) -> bytes:
    """One shard: documents in the given order, their grammar, and offsets for random access. See ``repair``."""
    symbols, symbol_ends, rules = repair(words, word_ends, values, starts, first_rule, **options)
    ends = np.concatenate([[0], np.cumsum(np.diff(starts)[words])])[word_ends]
    head = MAGIC + struct.pack("<IIIQ", len(doc_ids), len(rules), first_rule, len(symbols))
    parts = (np.array(doc_ids, "<i8"), symbol_ends.astype("<u8"), ends.astype("<u8"), rules.astype("<u4"), expansion_lengths(rules, first_rule).astype("<u4"), symbols.astype("<u4"))
    return head + b"".join(p.tobytes() for p in parts)


def pack_shard(doc_ids: list[int], tokens: list[np.ndarray], first_rule: int, **options) -> bytes:
    """A shard of documents whose ids are at hand: every id is a word."""
    ids = np.concatenate([*tokens, np.zeros(0, np.int64)]).astype(np.int64)
    return pack_words(doc_ids, ids, np.cumsum([len(t) for t in tokens]).astype(np.int64), np.arange(first_rule), np.arange(first_rule + 1), first_rule, **options)


class Shard:
    """Reads one shard; a document, or a range of its ids, without expanding the others."""

    def __init__(self, raw: bytes):
        if raw[:4] != MAGIC:
            raise ValueError("not a token shard")
        n, r, self.first_rule, s = struct.unpack_from("<IIIQ", raw, 4)
        at = 24

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, kind, count, at)
            at += out.nbytes
            return out

        self.doc_ids, self.symbol_ends, self.token_ends = take("<i8", n), take("<u8", n).astype(np.int64), take("<u8", n).astype(np.int64)
        self.rules, self.lengths = take("<u4", 2 * r).reshape(-1, 2).astype(np.int64), take("<u4", r).astype(np.int64)
        self.symbols = take("<u4", s)

    def all_tokens(self) -> np.ndarray:
        return expand(self.symbols, self.rules, self.lengths, self.first_rule)

    def document(self, i: int, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids [start, stop) of document ``i``: expansion lengths tell which symbols to expand."""
        symbols = self.symbols[self.symbol_ends[i - 1] if i else 0 : self.symbol_ends[i]].astype(np.int64)
        big = symbols >= self.first_rule
        width = np.ones(len(symbols), np.int64)
        width[big] = self.lengths[symbols[big] - self.first_rule]
        ends = np.cumsum(width)
        stop = int(ends[-1]) if stop is None and len(ends) else stop or 0
        a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left") + 1
        skipped = int(ends[a - 1]) if a else 0
        return expand(symbols[a:b], self.rules, self.lengths, self.first_rule)[start - skipped : stop - skipped]


# --- tokenizer ----------------------------------------------------------------------------------

#: Plain words: letters that the tokenizer only lower-cases, with the marks that it splits off behind them.
_LETTERS, _MARKS = "A-Za-zÀ-ÖØ-öø-ÿ", ".,!;:?*%&$#"
_SIMPLE = f"^[{_LETTERS}]+[{_MARKS}]*$"


def _ragged(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    ends = np.zeros(len(rows) + 1, np.int64)
    np.cumsum([len(r) for r in rows], out=ends[1:])
    return np.array([i for r in rows for i in r], np.int32), ends


class WordEncoder:
    """Ids of white-space separated words under a tokenizer that drops white space.

    Plain words, with the marks that may follow them split off, go through the tokenizer many at a time, cut at the
    pieces that end a word; all others one by one.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = False
        vocab = self.model.get_vocab()
        self.size = max(vocab.values()) + 1
        self.ends_word = np.zeros(self.size, bool)
        self.ends_word[[i for t, i in vocab.items() if t.endswith("</w>")]] = True

    def _plain(self, plain: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        out = []
        parts = [plain[i : i + 200] for i in range(0, len(plain), 200)]
        for part, coded in zip(parts, self.model.encode_batch_fast([" ".join(p) for p in parts], add_special_tokens=False), strict=True):
            ids = np.array(coded.ids, np.int32)
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) == len(part) and ends[-1] == len(ids):
                out.append((ids, np.concatenate([[0], ends])))
            else:  # a piece that ends a word inside one: take the slow way
                out.append(self._other(part))
        return out

    def _other(self, other: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return _ragged([e.ids for e in self.model.encode_batch_fast(other, add_special_tokens=False)])

    def encode(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets of the words) of the words of ``distinct``."""
        simple = pc.match_substring_regex(distinct, _SIMPLE)
        low = pc.utf8_lower(distinct.filter(simple))
        stem = pc.utf8_rtrim(low, characters=_MARKS)
        stems = stem.dictionary_encode()
        tails = pc.replace_substring_regex(low, f"^[{_LETTERS}]+", "").dictionary_encode()
        parts = [*self._plain(stems.dictionary.to_pylist()), self._other(tails.dictionary.to_pylist()), self._other(distinct.filter(pc.invert(simple)).to_pylist()), _ragged([[]])]
        values = np.concatenate([v for v, _ in parts])
        offsets = np.zeros(1 + sum(len(e) - 1 for _, e in parts), np.int64)
        np.cumsum(np.concatenate([np.diff(e) for _, e in parts]), out=offsets[1:])
        # Each word is two rows of these: letters and marks, or an odd word and nothing.
        plain = simple.to_numpy(zero_copy_only=False)
        rows = np.full((len(plain), 2), len(offsets) - 2)
        rows[plain, 0] = stems.indices.to_numpy()
        rows[plain, 1] = len(stems.dictionary) + tails.indices.to_numpy()
        rows[~plain, 0] = len(stems.dictionary) + len(tails.dictionary) + np.arange(len(plain) - plain.sum())
        ids, at = ragged.gather(values, offsets, rows.reshape(-1))
        return ids, at[::2]


class Words:
    """The distinct words that a task has met, each encoded once, up to about ``most``; word 0 is the end of a document."""

    def __init__(self, encoder: WordEncoder, end_id: int, most: int = 2_000_000):
        self.encoder, self.most = encoder, most
        self.known = pa.array([""], pa.large_string())  # no word is empty
        self.values, self.starts = np.array([end_id], np.int32), np.array([0, 1], np.int64)

    @property
    def full(self) -> bool:
        return len(self.known) > self.most

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of the words of all texts, end of each text among them), the end of the document behind each."""
        offsets, flat = ragged.split_words(texts)
        coded = flat.dictionary_encode()
        distinct = coded.dictionary
        at = pc.index_in(distinct, self.known)
        fresh = distinct.filter(pc.is_null(at))
        numbers = pc.fill_null(at, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        if len(fresh):
            numbers[pc.is_null(at).to_numpy(zero_copy_only=False)] = len(self.known) + np.arange(len(fresh))
            values, starts = self.encoder.encode(fresh)
            self.known = pa.concat_arrays([self.known, fresh])
            self.starts = np.concatenate([self.starts, len(self.values) + starts[1:]])
            self.values = np.concatenate([self.values, values])
        words = np.insert(numbers[coded.indices.to_numpy(zero_copy_only=False)], offsets[1:], 0)
        return words, offsets[1:] + np.arange(1, len(offsets))


@lru_cache(maxsize=2)
def _encoder(path: str) -> WordEncoder:
    """Loaded once for each Python worker."""
    return WordEncoder(path)


# --- Spark --------------------------------------------------------------------------------------


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, text: str = "text", id_col: str = "doc_id", shard_tokens: int = 1_000_000, batch_chars: int = 12_000_000, most_words: int = 2_000_000) -> None:
    """Tokenize every whole text and write shards in ascending order of id, as rows (task, part, n_tokens, raw) of Parquet files.

    Documents are range-partitioned by id and sorted; each task fills a shard with whole documents up to
    about ``shard_tokens`` ids, so memory is bounded by a shard, one document and ``most_words`` distinct words, after which
    a task starts a new shard and forgets its words. Shards carry the number of their task, which follows the ids, and
    their order in it. The files are committed by Spark, so a task that runs again leaves no second
    copy. Null text is empty (the end id alone); rows that repeat an id are documents of their own, ordered by
    text; a null id is stored as the smallest integer. An empty table gives no shard. Other columns are left out, so
    their names can't clash.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        task, encoder = TaskContext.get().partitionId(), _encoder(tokenizer)
        words = Words(encoder, end_id, most_words)
        ids: list[int] = []
        parts: list[np.ndarray] = []
        held = number = 0

        def shard() -> pa.RecordBatch:
            nonlocal ids, parts, held, number
            raw = pack_words(ids, np.concatenate(parts), np.cumsum([len(p) for p in parts]), words.values, words.starts, encoder.size)
            out = pa.RecordBatch.from_pydict({"task": [task], "part": [number], "n_tokens": [held], "raw": [raw]}, schema=_SHARD)
            ids, parts, held, number = [], [], 0, number + 1
            return out

        for batch in batches:
            texts, keys = batch.column(1), batch.column(0).to_pylist()
            sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
            cuts = [0, *(np.flatnonzero(np.diff(sizes // batch_chars)) + 1).tolist(), len(keys)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if hi == lo:
                    continue
                if words.full:
                    if ids:
                        yield shard()
                    words = Words(encoder, end_id, most_words)
                coded, ends = words.of(texts.slice(lo, hi - lo))
                sizes_of = np.concatenate([[0], np.cumsum(np.diff(words.starts)[coded])])[np.concatenate([[0], ends])].tolist()
                begin = 0
                for i, end in enumerate(ends.tolist()):
                    ids.append(keys[lo + i])
                    parts.append(coded[begin:end])
                    begin = end
                    held += sizes_of[i + 1] - sizes_of[i]
                    if held >= shard_tokens:
                        yield shard()
        if ids:
            yield shard()

    low = F.lit(-(2**63)).cast("long")
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), low).alias("id"), F.col(text).alias("text"))
    rows = rows.repartitionByRange("id").sortWithinPartitions("id", "text")
    rows.mapInArrow(pack, "task int, part int, n_tokens long, raw binary").write.option("compression", "zstd").parquet(path)


_SHARD = pa.schema([("task", pa.int32()), ("part", pa.int32()), ("n_tokens", pa.int64()), ("raw", pa.binary())])


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of every document, decoded from the shards at ``path``."""
    schema = "task int, part int, doc_id long, at long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for task, part, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                shard = Shard(raw.as_py())
                values = shard.all_tokens().astype("<u4")
                ends = shard.token_ends
                begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                crc = [zlib.crc32(values[a:b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                n = len(ends)
                columns = [pa.array(np.full(n, task, np.int32)), pa.array(np.full(n, part, np.int32)), pa.array(shard.doc_ids.astype(np.int64)), pa.array(begins), pa.array(ends - begins), pa.array(crc, pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(values.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in schema.split(", ")])

    shards = spark.read.parquet(path)
    # Ids before a shard: those of the tasks before its own, one row each, plus those of the shards before it in the task.
    earlier = lambda w: F.coalesce(F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tasks = shards.groupBy("task").agg(F.sum("n_tokens").alias("n_tokens")).select("task", earlier(Window.orderBy("task")).alias("__before"))
    starts = shards.select("task", "part", earlier(Window.partitionBy("task").orderBy("part")).alias("__own")).join(tasks, "task")
    rows = shards.select("task", "part", "raw").mapInArrow(unpack, schema)
    columns = ["doc_id", (F.col("__before") + F.col("__own") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"]
    return rows.join(starts, ["task", "part"]).select(*columns, *["ids"] * with_ids)


def tokenize_documents(docs: DataFrame, tokenizer: str, with_ids: bool = True, **options) -> DataFrame:
    """Write the shards to the shared folder and read them back."""
    spark = docs.sparkSession
    path = shared_path(spark, "tokens")
    write_tokens(docs, path, tokenizer, **options)
    return read_tokens(spark, path, with_ids)
