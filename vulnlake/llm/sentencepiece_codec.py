"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie."""

from __future__ import annotations

import hashlib
import math
import re
import struct
import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = range(1, 7)
_UNIGRAM = 1


def _fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of the fields of a protocol-buffers message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = raw[at]
            at += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    while at < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            n = varint()
            yield tag >> 3, raw[at : at + n]
            at += n
        else:
            n = {1: 8, 5: 4}[kind]
            yield tag >> 3, raw[at : at + n]
            at += n


@dataclass
class Vocabulary:
    """Pieces by id, their log scores and kinds, and whether a text gets a leading space."""

    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    dummy_prefix: bool = True

    @classmethod
    def from_model(cls, raw: bytes) -> Vocabulary:
        """From the bytes of a .model file.

        A unigram model's scores are log probabilities and used as they are. A BPE model's scores are merge
        ranks; a piece of rank r then gets the log of its Zipf share, 1 / (r + 1) over the sum of all.
        """
        pieces, scores, kinds, unigram, prefix = [], [], [], True, True
        for number, value in _fields(raw):
            if number == 1:
                own = dict(_fields(value))
                pieces.append(own[1].decode())
                scores.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
                kinds.append(own.get(3, NORMAL))
            elif number == 2:
                unigram = dict(_fields(value)).get(3, _UNIGRAM) == _UNIGRAM
            elif number == 3:
                rules = dict(_fields(value))
                prefix = bool(rules.get(3, 1))
                if rules.get(2) or rules.get(4, 1):
                    raise ValueError("the model normalises its input: only models that leave texts as they are can give them back")
        if not unigram:
            order = sorted((i for i, k in enumerate(kinds) if k == NORMAL), key=lambda i: -scores[i])
            total = math.log(sum(1 / (r + 1) for r in range(len(order))))
            scores = [0.0] * len(scores)
            for r, i in enumerate(order):
                scores[i] = -math.log(r + 1) - total
        return cls(pieces, scores, kinds, prefix)


#: Places tried at a time for the children of a state.
_BLOCK = 1024


def double_array(keys: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(base, check, value) of a trie over bytes: the child of state s by byte b is t = base[s] + b + 1 if check[t] == s."""
    children: list[dict[int, int]] = [{}]
    values = [-1]
    for key, v in keys.items():
        at = 0
        for b in key:
            if b not in children[at]:
                children[at][b] = len(children)
                children.append({})
                values.append(-1)
            at = children[at][b]
        values[at] = v
    size = 2 * len(children) + 2 * _BLOCK
    base, check, value = (np.full(size, fill, np.int32) for fill in (0, -1, -1))
    used = np.zeros(size, bool)
    used[0] = True
    todo, low = deque([(0, 0)]), 1
    while todo:
        node, state = todo.popleft()
        value[state] = values[node]
        kids = sorted(children[node])
        if not kids:
            continue
        low += int(np.argmin(used[low:]))
        at = max(0, low - kids[0] - 1)
        while len(kids) > 1 or at + kids[0] + 1 != low:
            if at + _BLOCK + 300 > len(used):  # room for every block
                base, check, value = (np.concatenate([a, np.full(size, fill, np.int32)]) for a, fill in ((base, 0), (check, -1), (value, -1)))
                used = np.concatenate([used, np.zeros(size, bool)])
            taken = used[at + kids[0] + 1 : at + kids[0] + 1 + _BLOCK].copy()
            for b in kids[1:]:
                taken |= used[at + b + 1 : at + b + 1 + _BLOCK]
            free = int(np.argmin(taken))
            if not taken[free]:
                break
            at += _BLOCK
        else:
            free = 0
        at += free
        base[state] = at
        for b in kids:
            t = at + b + 1
            used[t], check[t] = True, state
            todo.append((children[node][b], t))
    return base, check, value


class Codec:
    """Encodes and decodes whole texts; plain arrays, so a broadcast of it is bounded by the vocabulary."""

    def __init__(self, vocab: Vocabulary):
        self.prefix = vocab.dummy_prefix
        usable = {p.encode(): i for i, (p, k) in enumerate(zip(vocab.pieces, vocab.kinds, strict=True)) if k in (NORMAL, USER_DEFINED) and p}
        self.base, self.check, self.value = double_array(usable)
        self.scores = np.array(vocab.scores, np.float64)
        normal = [s for s, k in zip(vocab.scores, vocab.kinds, strict=True) if k == NORMAL]
        self.fallback = min(normal, default=0.0) - 10.0
        by_name = {p: i for i, p in enumerate(vocab.pieces)}
        self.unknown = next((i for i, k in enumerate(vocab.kinds) if k == UNKNOWN), 0)
        names = [f"<0x{b:02X}>" for b in range(256)]
        self.byte_ids = np.array([by_name.get(n, self.unknown) for n in names], np.int32)
        self.has_bytes = all(n in by_name for n in names)
        self.table = [bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k in (CONTROL, UNUSED) else p.replace(MARK, " ").encode() for p, k in zip(vocab.pieces, vocab.kinds, strict=True)]
        if self.unknown < len(self.table) and self.table:
            self.table[self.unknown] = " ⁇ ".encode()
        # No piece may cross the cuts between units: before a run of marks, and around a line feed.
        crossing = any(re.search(f"[^{MARK}]{MARK}", p) or ("\n" in p and p != "\n") for p in (x.decode() for x in usable))
        self.unit = re.compile(".*", re.S) if crossing else re.compile(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+")

    # -- encoding

    def units(self, text: str) -> list[str]:
        if not text:
            return []
        return [u for u in self.unit.findall((MARK if self.prefix else "") + text.replace(" ", MARK)) if u]

    def encode_units(self, units: list[str], wide: int = 48) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of distinct units; those of one length go through the lattice together."""
        raw = [u.encode() for u in units]
        lengths = np.array([len(r) for r in raw], np.int64)
        out: list[np.ndarray | None] = [None] * len(raw)
        order = np.argsort(lengths, kind="stable")
        cuts = np.flatnonzero(np.diff(lengths[order])) + 1
        for group in np.split(order, cuts) if len(order) else []:
            n = int(lengths[group[0]])
            if n > wide:
                for i in group:
                    out[i] = self._long(raw[i])
                continue
            for part in np.array_split(group, max(1, len(group) // 20_000)):
                matrix = np.frombuffer(b"".join([raw[i] for i in part]), np.uint8).reshape(len(part), n)
                ids, counts = self._lattice(matrix)
                for i, piece in zip(part, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
                    out[i] = piece
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in out], dtype=np.int64)])
        return np.concatenate([*out, np.zeros(0, np.int32)]).astype(np.int32), offsets

    def _lattice(self, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Viterbi for rows of equal length: (ids of all rows, ids in each)."""
        n, size = m.shape
        best = np.full((size + 1, n), -np.inf)
        back, piece = np.zeros((size + 1, n), np.int32), np.full((size + 1, n), -1, np.int32)
        best[0] = 0
        columns = np.ascontiguousarray(m.T).astype(np.int32)
        for s in range(size):
            rows = np.flatnonzero(best[s] > -np.inf)
            if not len(rows):
                continue
            lead = columns[s][rows]
            width = np.where(lead < 0x80, 1, np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, 4)))
            alone = np.zeros(n, bool)
            length = np.zeros(n, np.int32)
            length[rows] = width
            live, state = rows, np.zeros(len(rows), np.int32)
            for k in range(s, size):
                to = self.base[state] + columns[k][live] + 1
                ok = self.check[to] == state
                live, state = live[ok], to[ok]
                if not len(live):
                    break
                v = self.value[state]
                has = v >= 0
                r, v = live[has], v[has]
                alone[r[length[r] == k + 1 - s]] = True
                score = best[s][r] + self.scores[v]
                up = score > best[k + 1][r]
                r, v = r[up], v[up]
                best[k + 1][r], back[k + 1][r], piece[k + 1][r] = score[up], s, v
            r = rows[~alone[rows]]
            to = np.minimum(s + length[r], size)
            score = best[s][r] + self.fallback
            up = score > best[to, r]
            r, to = r[up], to[up]
            best[to, r], back[to, r], piece[to, r] = score[up], s, -1
        out = np.full((n, size), -1, np.int32)
        at, fill = np.full(n, size, np.int64), np.full(n, size, np.int64)
        rows = np.arange(n)
        while len(rows := rows[at[rows] > 0]):
            end, prev, v = at[rows], back[at[rows], rows], piece[at[rows], rows]
            whole = v >= 0
            if not self.has_bytes:
                whole, v = np.ones(len(rows), bool), np.where(whole, v, self.unknown)
            r = rows[whole]
            fill[r] -= 1
            out[r, fill[r]] = v[whole]
            for step in range(1, 5):
                r, e = rows[~whole], end[~whole]
                inside = e - step >= prev[~whole]
                r, e = r[inside], e[inside]
                fill[r] -= 1
                out[r, fill[r]] = self.byte_ids[m[r, e - step]]
            at[rows] = prev
        kept = out >= 0
        return out[kept], kept.sum(1)

    def _long(self, raw: bytes) -> np.ndarray:
        """Viterbi for one long unit; scores are kept only for its own positions."""
        n = len(raw)
        best, back, piece = [-math.inf] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        base, check, value, scores = self.base, self.check, self.value, self.scores
        for s in range(n):
            if best[s] == -math.inf:
                continue
            lead = raw[s]
            width = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            alone, state = False, 0
            for k in range(s, n):
                to = base[state] + raw[k] + 1
                if check[to] != state:
                    break
                state = to
                v = value[to]
                if v >= 0:
                    alone |= k + 1 - s == width
                    if best[s] + scores[v] > best[k + 1]:
                        best[k + 1], back[k + 1], piece[k + 1] = best[s] + scores[v], s, v
            if not alone and best[s] + self.fallback > best[s + width]:
                best[s + width], back[s + width], piece[s + width] = best[s] + self.fallback, s, -1
        out, at = [], n
        while at > 0:
            if piece[at] >= 0:
                out.append(int(piece[at]))
            elif self.has_bytes:
                out += [int(self.byte_ids[b]) for b in reversed(raw[back[at] : at])]
            else:
                out.append(self.unknown)
            at = back[at]
        return np.array(out[::-1], np.int32)

    def encode_batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of the texts). Each distinct unit is encoded once."""
        from .ragged import gather

        seen: dict[str, int] = {}
        codes: list[int] = []
        ends = [0]
        for t in texts:
            codes += [seen.setdefault(u, len(seen)) for u in self.units(t or "")]
            ends.append(len(codes))
        values, offsets = self.encode_units(list(seen))
        ids, at = gather(values, offsets, np.array(codes, np.int64))
        return ids, at[np.array(ends)]

    # -- decoding

    def decode(self, ids) -> str:
        """Pieces joined, marks as spaces, bytes as bytes; the added leading space goes."""
        raw = b"".join([self.table[i] for i in ids])
        return (raw[1:] if self.prefix and raw[:1] == b" " else raw).decode(errors="replace")


@lru_cache(maxsize=4)
def load_codec(path: str) -> Codec:
    """The codec of a .model file; built once for each path, as the double array takes seconds."""
    with open(path, "rb") as f:
        return Codec(Vocabulary.from_model(f.read()))


def _groups(texts: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    cuts = [0, *(np.flatnonzero(np.diff(sizes // limit)) + 1).tolist(), len(texts)]
    return zip(cuts, cuts[1:], strict=False)


def encode_documents(docs: DataFrame, codec: Codec, text: str = "text", keep: tuple[str, ...] = ("doc_id",), with_ids: bool = True, batch_chars: int = 6_000_000) -> DataFrame:
    """The columns ``keep``, without those named like a result, plus n_tokens, ids_crc32, round_trip, decoded_sha256 and, with ``with_ids``, ids.

    Encodes every whole text and decodes its ids again; round_trip tells whether that gave the text back
    (it does unless the text itself holds U+2581, which decodes to a space). ids_crc32 is over the ids as
    little-endian 32-bit integers. One pass without a shuffle; the codec is broadcast, its size bounded by
    the vocabulary. Null and empty texts have no ids and round-trip to the empty text. A very long word is one lattice, a very
    long text many. Repeated rows each get a result; an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(codec)
    own = "n_tokens long, ids_crc32 long, round_trip boolean, decoded_sha256 string" + ", ids array<int>" * with_ids
    results = {f.split()[0] for f in own.split(", ")}
    kept = docs.select(*[c for c in keep if c in docs.columns and c not in results])
    schema = T.StructType([*kept.schema.fields, *T._parse_datatype_string(f"struct<{own.replace(' ', ':')}>".replace(",:", ",")).fields])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared.value
        for batch in batches:
            for lo, hi in _groups(batch.column(batch.num_columns - 1), batch_chars):
                if lo == hi:
                    continue
                part = batch.slice(lo, hi - lo)
                texts = part.column(batch.num_columns - 1).to_pylist()
                ids, at = codec.encode_batch(texts)
                flat, ends = ids.astype("<u4"), at.tolist()
                back = [codec.decode(ids[a:b].tolist()) for a, b in zip(ends, ends[1:], strict=False)]
                columns = [*part.columns[:-1], pa.array(np.diff(at)), pa.array([zlib.crc32(flat[a:b]) for a, b in zip(ends, ends[1:], strict=False)], pa.int64()),
                           pa.array([b == (t or "") for b, t in zip(back, texts, strict=True)]), pa.array([hashlib.sha256(b.encode()).hexdigest() for b in back])]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids)))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select(*kept.columns, F.col(text).alias("__text")).mapInArrow(encode, schema)
