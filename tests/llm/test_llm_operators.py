"""The ten operators against brute force, round trips and held-out rows, on hostile small tables."""

import collections
import hashlib
import itertools
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from vulnlake.llm import fingerprints, langid, licenses, mixing, near_dedup, queries, sentencepiece_codec, suffix_dedup, token_output
from vulnlake.llm.common import components, shared_path
from vulnlake.llm.exact_dedup import exact_dedup
from vulnlake.llm.substring_dedup import FingerprintIndex, remove_repeated_windows

WORD = re.compile(r"[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, size string, rule string"


def made(seed=1, n=60):
    rng = random.Random(seed)
    vocab = ["".join(rng.choices("abcdeéß", k=rng.randint(2, 6))) for _ in range(400)]
    text = lambda k: " ".join(rng.choices(vocab, k=k))
    passage, base = text(60), text(120)
    rows = []
    for i in range(n):
        t = text(rng.choice([0, 1, 3, 20, 80, 150]))
        if i % 5 == 0:
            t = f"{text(10)} {passage}\t\n {text(12)}"
        if i % 7 == 0:
            w = base.split()
            for _ in range(rng.randint(0, 5)):
                w[rng.randrange(len(w))] = "changed"
            t = " ".join(w)
        if i % 11 == 0 and rows:
            t = rows[0][1]
        rows.append((i * 3, t))
    rows += [(500, None), (501, ""), (502, "  \t\n"), (503, "ab " * 200), (504, "x" * 5000), (505, "a b c d"), (506, "A b C d"), (507, "▁ odd ▁")]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    rows = made()
    table = spark.createDataFrame([(i, t, "en" if i % 2 else "fr", f"s{i % 4}" if i % 9 else None, "clash", "clash") for i, t in rows], SCHEMA)
    return rows, table.repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return WORD.findall(text or "")


def brute_windows(rows, size=35):
    count = collections.Counter(tuple(w[s : s + size]) for _, t in rows for w in [words(t)] for s in range(len(w) - size + 1))
    out = []
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for s in range(len(w) - size + 1):
            if count[tuple(w[s : s + size])] > 1:
                gone[s : s + size] = [True] * size
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return sorted(out, key=str)


def brute_bytes(rows, size=100):
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - size + 1):
            if b[s : s + size] in seen:
                gone[s : s + size] = b"\1" * size
            seen.add(b[s : s + size])
        out.append((i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), bytes(c for c, g in zip(b, gone, strict=True) if not g)))
    return sorted(out, key=str)


@pytest.mark.parametrize("most_spans", [20_000, 2])
def test_substring_dedup(docs, most_spans):
    rows, table = docs
    got = remove_repeated_windows(table, shard_bytes=3000, most_spans=most_spans).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got), key=str) == brute_windows(rows)


def test_substring_index_is_incremental(spark, docs):
    rows, table = docs
    index = FingerprintIndex(spark, shared_path(spark, "index"), 8, fanout=3)
    index.append(table.where("doc_id < 60"))
    fresh = table.where("doc_id >= 60")
    seen = index.overlap(fresh).agg(F.sum("fingerprints").alias("a"), F.sum("seen").alias("b")).first()
    assert 0 < seen.b < seen.a
    index.append(fresh)
    assert len(index.runs) == 2
    index.append(table.limit(0))
    assert len(index.runs) == 1  # compacted
    again = index.overlap(table).agg(F.sum("fingerprints").alias("a"), F.sum("seen").alias("b")).first()
    assert again.a == again.b
    got = remove_repeated_windows(table, index, shard_bytes=5000).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got), key=str) == brute_windows(rows)


@pytest.mark.parametrize("most_spans", [20_000, 2])
def test_substring_dedup_against_history(spark, docs, most_spans):
    rows, table = docs
    old, new, last = "doc_id < 15", "doc_id >= 15 and doc_id < 150", "doc_id >= 150"
    index = FingerprintIndex(spark, shared_path(spark, "index"), 8, fanout=2, shard_bytes=3000, most_spans=most_spans)
    seen = lambda d: sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in d.collect()), key=str)
    want = lambda top, keep: [r for r in brute_windows([x for x in rows if x[0] < top]) if keep(r[0])]
    index.append(table.where(old))
    assert seen(index.result()) == want(15, lambda i: True)
    assert seen(remove_repeated_windows(table.where(new), index, held=False)) == want(150, lambda i: i >= 15)
    index.append(table.where(new))
    assert len(index.runs) == 1  # compacted
    assert seen(index.result(1)) == seen(remove_repeated_windows(table.where(new), index)) == want(150, lambda i: i >= 15)
    index.append(table.where(last))
    assert seen(index.result(0)) == want(1000, lambda i: i < 15) != want(15, lambda i: True)
    assert seen(index.result()) == brute_windows(rows)


@pytest.mark.parametrize("most_spans", [20_000, 2])
def test_suffix_dedup(docs, most_spans):
    rows, table = docs
    got = suffix_dedup.remove_repeated_bytes(table, shard_bytes=3000, most_spans=most_spans).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in got), key=str) == brute_bytes(rows)


def test_repeated_ids_and_nulls(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(None, long), (1, long), (1, long), (2, None), (2, ""), (2, "short")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = remove_repeated_windows(table).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got), key=str) == brute_windows(rows)
    got = suffix_dedup.remove_repeated_bytes(table).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in got), key=str) == brute_bytes(rows)
    kept = exact_dedup(table).collect()
    assert len(kept) == 6 and sum(r.kept for r in kept) == 3 and {r.keep_id for r in kept} == {1, 2}
    near = near_dedup.near_duplicates(table).collect()
    assert len(near) == 6 and {r.component_id for r in near if r.n_shingles > 1} == {None}


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(3)
    for text in (rng.integers(1, 4, 400), np.ones(300, int), np.array([], int), np.array([5]), np.tile(rng.integers(1, 9, 40), 9)):
        sa = suffix_dedup.suffix_array(text)
        want = sorted(range(len(text)), key=lambda i: text[i:].tolist())
        assert sa.tolist() == want
        lcp = suffix_dedup.common_prefixes(text.astype(np.int16), sa)
        for k in range(1, len(text)):
            a, b = text[sa[k - 1] :].tolist(), text[sa[k] :].tolist()
            assert lcp[k] == sum(1 for _ in itertools.takewhile(lambda p: p[0] == p[1], zip(a, b, strict=False)))


def brute_near(rows, size, percent=80):
    sets = {}
    for i, t in rows:
        w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return sorted((i, len(sets[i]), find(i), find(i) == i) for i in sets)


def test_near_dedup(docs):
    rows, table = docs
    got = near_dedup.near_duplicates(table, words=4).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == brute_near(rows, 4)


def test_near_dedup_chains(spark):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(120):  # copies near a common origin, many not near each other
        w = list(base)
        for _ in range(rng.randint(1, 9)):
            w[rng.randrange(150)] = f"u{i}x{rng.random()}"
        rows.append((i, " ".join(w)))
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), words=4).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == brute_near(rows, 4)


def test_near_dedup_large_groups(spark, monkeypatch):
    rng = random.Random(6)
    base, rows = [f"w{i}" for i in range(150)], []
    for i in range(160):
        w = list(base)
        for _ in range(rng.randint(1, 9) if i < 120 else 16):  # the last ones barely reach the others
            w[rng.randrange(150)] = f"u{i}x{rng.random()}"
        rows.append((i, " ".join(w)))
    sizes = spark.sparkContext.accumulator(0)

    def compared(compare, percent):
        def run(table):
            if table.num_rows > 60:
                sizes.add(1)
            return compare(table, percent)

        return run

    monkeypatch.setattr(near_dedup, "_compared", compared)
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), words=4, most=12).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == brute_near(rows, 4)
    assert sizes.value == 0  # no task is given a whole group


def test_block_pairs_meet_once(spark):
    comp = {k: 1 if k < 50 else 2 if k < 80 else k for k in range(120)}
    groups = spark.createDataFrame([(7, k) for k in range(120)] + [(8, k) for k in (1, 60, 100)], "group long, k long")
    known = spark.createDataFrame(list(comp.items()), "rep long, comp long")
    tasks = collections.defaultdict(list)
    for r in near_dedup._block_pairs(groups, known, 10).collect():
        tasks[r.group, r.x, r.y].append((r.k, r.side))
    met = collections.Counter()
    for (group, _, _), own in tasks.items():
        assert len(own) <= 60
        met.update((group, *sorted((a, b))) for (a, s), (b, t) in itertools.combinations(own, 2) if comp[a] != comp[b] and (s != t or s == 2))
    want = {(g, a, b) for g, ids in ((7, range(120)), (8, (1, 60, 100))) for a, b in itertools.combinations(ids, 2) if comp[a] != comp[b]}
    assert set(met) == want and set(met.values()) == {1}


def test_near_dedup_refuses_low_percent(empty):
    with pytest.raises(ValueError):
        near_dedup.near_duplicates(empty, percent=60)


def test_pigeonhole():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 65536, (200, near_dedup.VALUES)).astype("<u2")
    b = a.copy()
    for row in b:
        row[rng.choice(near_dedup.VALUES, near_dedup.MAX_DISTANCE, replace=False)] ^= 1
    assert (near_dedup.distance(a, b) == near_dedup.MAX_DISTANCE).all()
    assert (near_dedup.chunk_keys(a) == near_dedup.chunk_keys(b)).any(1).all()


def test_common_shingles_are_bounded():
    rng = np.random.default_rng(2)
    pool = rng.integers(0, 2**64, 60_000, dtype=np.uint64)
    pool[:20_000] >>= np.uint64(20)  # all in the first cell, far over 255
    sets = [np.unique(rng.choice(pool, n)) for n in (0, 1, 40, 41, 900, 950, 30_000, 50_000)]
    n = np.array([len(s) for s in sets])
    cells = np.stack([near_dedup.cell_counts(s) for s in sets])
    a, b = (x.reshape(-1) for x in np.meshgrid(np.arange(len(sets)), np.arange(len(sets))))
    both = np.array([len(np.intersect1d(sets[i], sets[j])) for i, j in zip(a, b, strict=True)])
    bound = near_dedup.most_common(cells, n - cells.sum(1, dtype=np.int64), a, b)
    assert (bound >= both).all() and (bound[a == b] == n).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(10, 40)] + [(1, 2), (2, 1), (5, 5), (7, 2)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {**{i: 10 for i in range(10, 41)}, 1: 1, 2: 1, 7: 1}


@pytest.mark.parametrize("hot_rows", [1000, 2])
def test_exact_dedup(docs, hot_rows):
    rows, table = docs
    norm = {i: re.sub(r"[\x20\x09-\x0d]+", " ", t or "") for i, t in rows}
    groups = collections.defaultdict(list)
    for i, t in norm.items():
        groups[t].append(i)
    got = exact_dedup(table, hot_rows=hot_rows, hot_share=1000, with_text=True).collect()
    want = sorted((i, min(groups[t]), len(groups[t]), min(groups[t]) == i, hashlib.sha256(t.encode()).hexdigest()) for i, t in norm.items())
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got) == want
    assert {r.doc_id: r.text for r in got} == dict(rows) and got[0].rule == "clash"


def test_mixing(docs):
    _, table = docs
    rows = mixing.mix(table).collect()
    assert sorted(rows, key=str) == sorted(mixing.mix(table.repartition(7)).collect(), key=str)
    by = collections.defaultdict(list)
    for r in rows:
        by[r.source].append(r)
        assert 0 <= r.taken <= 3 * r.size
    for own in by.values():
        assert sum(r.size for r in own) == own[0].source_size
        assert sum(r.taken for r in own) == int(own[0].target) <= 3 * own[0].source_size
    assert abs(sum(own[0].target for own in by.values()) - sum(r.size for r in rows)) < 1
    mixed = mixing.mixed_documents(table)
    assert mixed.columns == table.columns and mixed.count() >= sum(1 for r in rows if r.taken)


def test_fingerprints(docs):
    rows, table = docs
    order = [t or "" for _, t in sorted(rows)]
    ids = sorted(i for i, _ in rows)
    got = {r.doc_id: r for r in fingerprints.neighbour_fingerprints(table, k=16).withColumn("near", fingerprints.resemblance(F.col("sketch"), F.col("edited_sketch"), 16)).collect()}
    for k, i in enumerate(ids):
        n = len(order[k]) // 4
        assert got[i].n_chars == len(order[k]) and got[i].edited_text == order[k][: len(order[k]) - n] + order[(k + 1) % len(ids)][:n]
        assert 0 <= got[i].near <= 1 and len(got[i].sketch) <= 16
    assert got[0].near < 1 or not order[0]


def test_langid(spark):
    rng = random.Random(2)
    vocab = {"aa": ["bonjour", "monde", "cheval", "maison", "soleil"], "bb": ["wasser", "himmel", "strasse", "kirche", "vogel"]}
    rows = [(i, " ".join(rng.choices(vocab[x], k=30)), x) for i in range(80) for x in ["aa" if i % 3 else "bb"]] + [(900, None, "aa"), (901, "123 ...", "bb"), (902, "", None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit_dictionaries(langid.training_rows(table))
    got = {r.doc_id: r for r in langid.identify(table.drop("lang"), model).collect()}
    assert all(got[i].lang_pred == lang and 0 <= got[i].score <= 1 and not got[i].rejected for i, t, lang in rows[:80])
    assert all(got[i].lang_pred == "und" and got[i].rejected for i in (900, 901, 902))


def test_codec_round_trip(docs, tokenizers):
    rows, table = docs
    codec = sentencepiece_codec.load_codec(tokenizers("piece_bpe_32k.model"))
    got = {r.doc_id: r for r in sentencepiece_codec.encode_documents(table, codec).collect()}
    assert all(r.round_trip == ("▁" not in (dict(rows)[i] or "")) for i, r in got.items())
    assert got[500].ids == [] and got[501].n_tokens == 0


def test_viterbi_is_best():
    pieces = ["a", "b", "ab", "ba", "aba", "<0x63>"]
    scores = [-1.0, -2.0, -2.5, -2.2, -5.0, 0.0]
    names = pieces[:5] + [f"<0x{b:02X}>" for b in range(256)]
    vocab = sentencepiece_codec.Vocabulary(["<unk>", *names], [0.0, *scores[:5], *[0.0] * 256], [2, *[1] * 5, *[6] * 256], False)
    codec = sentencepiece_codec.Codec(vocab)

    def best(text):
        if not text:
            return 0.0
        return max([scores[k] + best(text[len(p) :]) for k, p in enumerate(pieces[:5]) if text.startswith(p)], default=-1e9)

    for n in range(1, 8):
        for letters in itertools.product("ab", repeat=n):
            ids, _ = codec.encode_batch(["".join(letters)])
            assert abs(sum(codec.scores[i] for i in ids) - best("".join(letters))) < 1e-9
    ids, _ = codec.encode_batch(["aéb"])
    assert codec.decode(ids.tolist()) == "aéb" and len(ids) == 4


@pytest.fixture(scope="module")
def tokenizers():
    public = pytest.importorskip("public_tokenizers")
    return public.path


def test_token_output(spark, docs, tokenizers):
    from tokenizers import Tokenizer

    rows, table = docs
    model, start = Tokenizer.from_file(tokenizers("word_bpe_49k.json")), 0
    got = {r.doc_id: r for r in token_output.tokenize_documents(table, tokenizers("word_bpe_49k.json"), shard_tokens=500).collect()}
    for i, t in sorted(rows):
        ids = [*model.encode(t or "", add_special_tokens=False).ids, 2]
        assert got[i].ids == ids and got[i].start == start and got[i].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_grammar_random_access():
    rng = np.random.default_rng(0)
    parts = [np.concatenate([np.tile([5, 6, 7], rng.integers(0, 40)), rng.integers(0, 9, rng.integers(0, 20))]) for _ in range(30)]
    shard = token_output.Shard(token_output.pack_shard(list(range(30)), parts, 100, min_count=4))
    assert len(shard.rules) and len(shard.symbols) < sum(map(len, parts))
    assert (shard.all_tokens() == np.concatenate(parts)).all()
    for i, p in enumerate(parts):
        assert shard.document(i).tolist() == p.tolist() and shard.document(i, 1, min(4, len(p))).tolist() == p[1:4].tolist()


def test_licenses(spark):
    text = "Licensed under the Apache License, Version 2.0 (the \"License\"); see MIT license, mit  License GNU general public license"
    rows = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "apache licenses mit-license")], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan_licenses(rows).collect()}
    assert got[1].n_base == 4 and got[1].base_labels == "apache,gpl,mit" and "apache-2.0" in got[1].labels and got[1].first_word == 3 and got[1].score == 1.0
    assert got[2].n_words == 0 and got[2].first_word is None and got[2].labels == "" and got[3].score == 0.0
    assert got[4].n_base == 1 and got[4].first_word == 2
    t = licenses.Template("use [[or {{copy|share}}]] {{2}} freely")
    for tokens, n in (("use freely", 2), ("use or copy it now freely", 6), ("use or freely", 3), ("use it now or freely", 0)):
        assert t.longest(tokens.split(), 0) == n


def test_empty_tables(spark, empty, tokenizers):
    assert remove_repeated_windows(empty).count() == suffix_dedup.remove_repeated_bytes(empty).count() == near_dedup.near_duplicates(empty).count() == 0
    assert exact_dedup(empty).count() == mixing.mix(empty).count() == fingerprints.neighbour_fingerprints(empty).count() == licenses.scan_licenses(empty).count() == 0
    assert langid.identify(empty, langid.fit_dictionaries(langid.training_rows(empty))).count() == 0
    assert token_output.tokenize_documents(empty, tokenizers("word_bpe_49k.json")).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{os.path.join('/root/testdata/sf0.001', 'documents')}.parquet'")
    found = con.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in found.description]
    got = queries.QUERIES[name](spark, "/root/testdata/sf0.001").select(*names).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, found.fetchall()))


def test_pipeline(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = pipeline.documents(spark, "/root/testdata/sf0.001")
    ids = {r.doc_id for r in docs.collect()}
    for name, stage in pipeline.STAGES:
        path = shared_path(spark, "stage")
        stage(spark, docs, "").write.parquet(path)
        after = spark.read.parquet(path)
        if name != "sentencepiece":
            assert after.columns == docs.columns
        now = [r.doc_id for r in after.collect()]
        assert set(now) <= ids and (len(set(now)) > 0.8 * len(ids) or name == "mix")
        docs, ids = after, set(now)
    assert docs.where("not round_trip").count() == 0


def frequent_pairs(symbols, ends, most):
    """Pairs inside documents that occur more than ``most`` times without overlaps."""
    count, begin = collections.Counter(), 0
    for end in ends:
        row, free = symbols[begin:end], {}
        for k, pair in enumerate(itertools.pairwise(row)):
            if free.get(pair, 0) <= k:
                count[pair] += 1
                free[pair] = k + 2
        begin = end
    return {p: n for p, n in count.items() if n > most}


@pytest.mark.parametrize("letters", [2, 6, 40])
def test_grammar_is_complete(letters):
    rng = np.random.default_rng(letters)
    values, starts, passage = [], [0], rng.integers(0, 50, 30)
    for _ in range(50):
        values += rng.integers(0, letters, rng.integers(1, 6)).tolist()
        starts.append(len(values))
    docs = [np.concatenate([rng.integers(0, 50, rng.integers(0, 60)), *[passage] * (k % 4 == 0), np.repeat(3, k % 9)]).astype(np.int64) for k in range(60)] + [np.zeros(0, np.int64)]
    ends = np.cumsum([len(d) for d in docs])
    values, starts = np.array(values), np.array(starts)
    shard = token_output.Shard(token_output.pack_words(list(range(61)), np.concatenate(docs), ends, values, starts, letters))
    assert not frequent_pairs(shard.symbols.tolist(), shard.symbol_ends.tolist(), 3)
    assert shard.lengths.max() > 8 and (shard.rules < letters + np.arange(len(shard.rules))[:, None]).all()
    for i, d in enumerate(docs):
        want = [int(v) for w in d for v in values[starts[w] : starts[w + 1]]]
        assert shard.document(i).tolist() == want and shard.document(i, 2, min(9, len(want))).tolist() == want[2:9]


def test_token_output_edges(spark, tokenizers):
    from tokenizers import Tokenizer

    rows = [(None, "null id", "x"), (3, "b b", "x"), (3, "a", "x"), (4, None, "x"), (5, "lorem ipsum " * 30_000, "x"), (6, "Voilà, c'est l'été! x y", "x")]
    table = spark.createDataFrame(rows, "doc_id long, text string, task string").repartition(3)
    model, start = Tokenizer.from_file(tokenizers("word_bpe_49k.json")), 0
    got = token_output.tokenize_documents(table, tokenizers("word_bpe_49k.json"), shard_tokens=10, batch_chars=40, most_words=3).orderBy("start").collect()
    assert len(got) == 6 and got[0].__fields__ == ["doc_id", "start", "n_tokens", "ids_crc32", "ids"]
    for r, (i, t) in zip(got, [(-(2**63), "null id"), (3, "a"), (3, "b b"), (4, ""), *[(r[0], r[1]) for r in rows[4:]]], strict=True):
        ids = [*model.encode(t, add_special_tokens=False).ids, 2]
        assert r.doc_id == i and r.ids == ids and r.start == start
        start += len(ids)


def test_langid_on_held_out_documents(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    model = langid.fit_dictionaries(langid.training_rows(rows))
    got = langid.identify(rows.where(langid.held_out()).drop("lang"), model).join(rows.select("doc_id", "lang"), "doc_id").where("lang is not null and not rejected").collect()
    assert len(got) > 150 and sum(r.lang_pred == r.lang for r in got) >= 0.98 * len(got)
    # Half in one language and half in another.
    pure = [r for r in got if r.text is not None and len(r.text) > 1200]
    kinds = {lang: [r.text[:1200] for r in pure if r.lang == lang] for lang in ("de", "es", "fr")}
    pairs = [(x + " " + y) for a, b in itertools.combinations(kinds, 2) for x, y in zip(kinds[a][:6], kinds[b][:6], strict=False)]
    two = langid.identify(spark.createDataFrame([(t,) for t in pairs], "text string"), model).collect()
    assert len(two) > 5 and sum(r.rejected for r in two) > 0.5 * len(two)


def test_langid_edges(spark):
    rng = random.Random(3)
    vocab = {"aa": ["bonjour", "monde", "cheval", "maison"], "bb": ["wasser", "himmel", "strasse", "kirche"]}
    table = spark.createDataFrame([(i, " ".join(rng.choices(vocab[x], k=30)), x, "old") for i in range(60) for x in ["aa" if i % 3 else "bb"]], "doc_id long, text string, lang string, score string")
    model = langid.fit_dictionaries(langid.training_rows(table), total_bytes=1024)
    assert set(model) == {"aa", "bb"} and max(map(len, model.values())) <= 512
    long = " ".join(rng.choices(vocab["bb"], k=200_000))
    rows = [(1, long), (1, long), (2, "wasser " * 3), (3, "\t\n"), (4, "x" * 300_000)]
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash")), model).orderBy("doc_id").collect()
    assert len(got) == 5 and got[0] == got[1] and got[0].lang_pred == "bb" and not got[0].rejected and got[3].lang_pred == "und"
    # The end of a long text counts.
    assert langid.CompressionClassifier(model).predict("kirche " * 50 + "bonjour monde cheval " * 20_000)[0] == "aa"


def options(markup):
    """All token sequences of a markup, with None for any word."""
    out = [[]]
    for kind, body in licenses._regions(markup):
        if kind == "text":
            parts = [licenses.words(body)]
        elif body.strip().isdigit():
            parts = [[None] * n for n in range(int(body) + 1)]
        else:
            parts = [p for o in licenses._options(body) for p in options(o)] + [[]] * (kind == "optional")
        out = [a + b for a in out for b in parts]
    return out


@pytest.mark.parametrize("seed", range(6))
def test_templates_against_brute_force(seed):
    rng = random.Random(seed)

    def markup(depth):
        parts = [rng.choice("abc")]
        for _ in range(rng.randint(1, 4)):
            kind = rng.randrange(4) if depth else 0
            parts.append({0: lambda: rng.choice("abc"), 1: lambda: f"[[{markup(depth - 1)}]]", 2: lambda: "{{" + markup(depth - 1) + "|" + rng.choice("abc") + "}}", 3: lambda: "{{2}}"}[kind]())
        return " ".join(parts)

    for _ in range(40):
        text = markup(2)
        template, every = licenses.Template(text), options(text)
        assert template.mandatory == min(map(len, every))
        for _ in range(20):
            tokens = rng.choices("abcd", k=rng.randint(0, 9))
            fits = [len(o) for o in every if len(o) <= len(tokens) and all(w in (None, t) for w, t in zip(o, tokens, strict=False))]
            assert template.longest(tokens, 0) == max(fits, default=0), (text, tokens)


def plain(label):
    """A template's wording with its regions at their first choice."""
    return " ".join(w or "someone" for w in options_first(licenses.TEMPLATES[label]))


def options_first(markup):
    out = []
    for kind, body in licenses._regions(markup):
        if kind == "text":
            out += licenses.words(body)
        elif kind == "replaceable":
            out += [None] if body.strip().isdigit() else options_first(licenses._options(body)[0])
    return out


def test_whole_licenses_only(spark):
    mit = plain("mit")
    start = mit[: mit.index("without restriction")]
    texts = {
        "mit": f"Foo. Copyright 2020\n\n{mit.upper()}\n bar", "cut": f"{start} FORBIDDEN: you may not use, copy or sell it", "changed": mit.replace("sublicense", "sell"),
        "bsd2": plain("bsd-2-clause"), "bsd3": plain("bsd-3-clause"), "isc": plain("isc"), "gpl": plain("gpl-2.0-notice"), "lgpl": plain("lgpl-2.1-notice"), "mpl": plain("mpl-2.0-notice"), "clean": "nothing of this kind " * 50,
        "long": "filler " * 200_000 + mit,
    }
    rows = spark.createDataFrame(list(texts.items()), "doc_id string, text string").withColumn("score", F.lit("clash"))
    got = {r.doc_id: r for r in licenses.scan_licenses(rows).collect()}
    labels = {k: set(r.labels.split(",")) - {""} for k, r in got.items()}
    assert "mit" in labels["mit"] and "mit" in labels["long"] and "mit" not in labels["cut"] | labels["changed"]
    assert got["mit"].score == 1.0 and 0 < got["cut"].score < 0.5 < got["changed"].score or got["changed"].score < 1.0
    assert "bsd-2-clause" in labels["bsd2"] and "bsd-3-clause" not in labels["bsd2"] and "bsd-3-clause" in labels["bsd3"] and "bsd-2-clause" not in labels["bsd3"]
    assert labels["isc"] == {"isc"} and "gpl-2.0-notice" in labels["gpl"] and "gpl" in labels["gpl"] and labels["lgpl"] == {"lgpl-2.1-notice"} and labels["mpl"] == {"mpl-2.0-notice"}
    assert labels["clean"] == set() and got["clean"].score == 0.0


def test_phrases_against_brute_force(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    phrases = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    got = {r.doc_id: r for r in queries.op10_license_scan(spark, "/root/testdata/sf0.01").collect()}
    assert len(got) == len(rows)
    for r in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r.text or ""))
        places = sorted((i, label) for p, label in phrases.items() for k in [p.split()] for i in range(len(w)) if w[i : i + len(k)] == k)
        g = got[r.doc_id]
        assert (g.n_words, g.n_base, g.first_word, g.last_word) == (len(w), len(places), places[0][0] if places else None, places[-1][0] if places else None)
        assert g.base_labels == ",".join(sorted({x for _, x in places})) and {x for _, x in places} <= set(g.labels.split(",")) | {""}


def brute_shingles(text, size=5):
    """Spark's xxhash64 of words and of runs of their hashes, with the public library."""
    import struct

    import xxhash

    signed = lambda h: h - 2**64 if h >= 2**63 else h
    chain = lambda hs, seed=42: signed(__import__("functools").reduce(lambda acc, h: xxhash.xxh64_intdigest(struct.pack("<q", h), acc), hs, seed))
    h = [signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in words(text)]
    if len(h) >= size:
        return {chain(h[i : i + size]) for i in range(len(h) - size + 1)}
    if not h:
        return set()
    acc = 7
    for w in h:
        acc = chain([acc, w])
    return {acc}


def test_fingerprints_against_brute_force(docs):
    rows, table = docs
    order = sorted(rows)
    got = {r.doc_id: r for r in fingerprints.neighbour_fingerprints(table).select(
        "doc_id", "sketch", "edited_text", "edited_sketch", "next_sketch", fingerprints.resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near"), fingerprints.resemblance(F.col("sketch"), F.col("next_sketch")).alias("next"),
        fingerprints.containment(F.col("sketch"), F.col("edited_sketch")).alias("inside"), fingerprints.distinct_count(F.col("sketch")).alias("n")).collect()}
    likeness = lambda a, b: 1.0 if not a and not b else len(a & b) / len(a | b)
    for k, (i, t) in enumerate(order):
        own, edited, after = brute_shingles(t), brute_shingles(got[i].edited_text), brute_shingles(order[(k + 1) % len(order)][1])
        assert got[i].sketch == sorted(own)[:128] and got[i].edited_sketch == sorted(edited)[:128] and got[i].next_sketch == sorted(after)[:128]
        for est, b in ((got[i].near, edited), (got[i].next, after)):
            assert abs(est - likeness(own, b)) < (1e-9 if len(own | b) <= 128 else 0.2)
        assert abs(got[i].inside - (len(own & edited) / len(own) if own else 1.0)) < (1e-9 if max(len(own | edited), 1) < 128 else 0.25)
        assert abs(got[i].n - len(own)) <= (0 if len(own) < 128 else 0.4 * len(own))


def test_merged_fingerprints(spark):
    rng = random.Random(4)
    parts = [(k % 3 if k % 7 else None, " ".join(rng.choices("abcdefg", k=rng.choice([0, 2, 40, 90])))) for k in range(60)] + [(9, "")]
    table = spark.createDataFrame(parts, "g int, text string").withColumn("sketch", fingerprints.sketch(F.col("text"), 32)).withColumn("clash", F.lit(1)).repartition(5)
    got = {r.g: r.sketch for r in fingerprints.merge_groups(table, "g", k=32).collect()}
    pair = spark.createDataFrame([("a b c d e f g", "x y z a b c d")], "a string, b string").select(fingerprints.merge(fingerprints.sketch(F.col("a"), 4), fingerprints.sketch(F.col("b"), 4), 4).alias("s")).first()
    assert pair.s == sorted(brute_shingles("a b c d e f g") | brute_shingles("x y z a b c d"))[:4]
    assert set(got) == {g for g, _ in parts}
    for g in got:
        assert got[g] == sorted(set().union(*(brute_shingles(t) for h, t in parts if h == g)))[:32]


def test_pipeline_against_brute_force(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    import pandas as pd

    docs = pipeline.documents(spark, "/root/testdata/sf0.001")
    rows = [r.asDict() for r in docs.collect()]
    model = langid.CompressionClassifier(langid.fit_dictionaries(langid.training_rows(docs)))
    rows = [r for r in rows if not model.predict(r["text"])[2]]
    first = {}
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        first.setdefault(re.sub(r"[\x20\x09-\x0d]+", " ", r["text"] or ""), r["doc_id"])
    rows = [r for r in rows if r["doc_id"] in set(first.values())]
    stay = {i for i, _, _, kept in brute_near([(r["doc_id"], r["text"]) for r in rows], 5) if kept}
    rows = [r for r in rows if r["doc_id"] in stay]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows)[["doc_id", "text", "source"]])
    taken = {i: (t, n) for i, t, n in con.execute(f"SELECT doc_id, taken, size FROM ({queries.OP8_SQL})").fetchall()}
    codec = sentencepiece_codec.load_codec(pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model"))
    want = []
    for r in rows:
        took, size = taken[r["doc_id"]]
        ids, _ = codec.encode_batch([r["text"]])
        want += [(r["doc_id"], r["lang"], r["source"], ids.tolist())] * (-(-took // size) if took else 0)
    got = pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert sorted(((r.doc_id, r.lang, r.source, r.ids) for r in got), key=str) == sorted(want, key=str)


def test_pipeline_edges(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, score string"
    good = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source").limit(60).collect()
    odd = [(None, "a null id of no great length", None, None), (None, None, None, None), (7001, "", "en", "x"), (7002, " \t\n", "en", None), (7003, "the " * 60_000, "en", "x"), (7003, "the " * 60_000, "en", "x")]
    rows = [(*r, 1, True, "clash") for r in [*map(tuple, good), *odd, tuple(good[0])]]
    for name, table in (("odd", rows), ("empty", [])):
        spark.createDataFrame(table, schema).repartition(3).write.parquet(str(tmp_path / name / "documents.parquet"))
        out = pipeline.run(spark, str(tmp_path / name), run_id=f"{os.getpid()}-{name}")
        got = out.collect()
        assert out.columns == ["doc_id", "lang", "source", "n_tokens", "ids_crc32", "round_trip", "decoded_sha256", "ids"]
        assert bool(got) == bool(table) and all(r.round_trip for r in got)
        assert {r.doc_id for r in got} <= {r[0] for r in rows} - {7001, 7002}
        # Started again, the run goes on from what is there.
        stages, pipeline.STAGES = pipeline.STAGES, [(n, None) for n, _ in pipeline.STAGES]
        try:
            assert sorted(pipeline.run(spark, "nowhere", run_id=f"{os.getpid()}-{name}").collect(), key=str) == sorted(got, key=str)
        finally:
            pipeline.STAGES = stages


def test_codec_edges(spark, empty, tokenizers):
    codec = sentencepiece_codec.load_codec(tokenizers("piece_bpe_32k.model"))
    assert sentencepiece_codec.encode_documents(empty, codec).count() == 0
    texts = [None, "", "x" * 3000, "a b " * 60_000, "日本語 and 🙂\n\n  end ", "same", "same"]
    rows = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens long")
    out = sentencepiece_codec.encode_documents(rows, codec, keep=("doc_id", "n_tokens", "missing"))
    assert out.columns.count("n_tokens") == 1
    got = {r.doc_id: r for r in out.collect()}
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in got.values()) and got[0].ids == got[1].ids == [] and got[5].ids == got[6].ids
    # One lattice for short and for long units.
    for unit in ("▁" + "ab" * 30, "éèê日本" * 12, "x" * 49):
        short, _ = codec.encode_units([unit], wide=10**6)
        long, _ = codec.encode_units([unit], wide=0)
        assert short.tolist() == long.tolist()


def test_model_that_normalises_is_refused():
    raw = b"\x1a\x02\x20\x01"  # a normaliser that removes extra white space
    with pytest.raises(ValueError, match="normalises"):
        sentencepiece_codec.Vocabulary.from_model(raw)


def test_common_line_with_other_neighbours(spark):
    """One line in every document, never between the same words: a gram with as many surroundings as documents."""
    rng = random.Random(8)
    line = " ".join(f"common{i}" for i in range(40))
    texts = [(i, " ".join([*(f"p{i}x{rng.random()}" for _ in range(20)), line, *(f"s{i}x{rng.random()}" for _ in range(20))])) for i in range(80)]
    table = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    got = remove_repeated_windows(table, shard_bytes=6000, most_spans=7).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got), key=str) == brute_windows(texts)
    got = suffix_dedup.remove_repeated_bytes(table, shard_bytes=6000, most_spans=7).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in got), key=str) == brute_bytes(texts)


def test_all_operators_are_listed():
    entry = pytest.importorskip("__spark_entry__")
    assert {f"op{n}" for n in range(1, 11)} == {q.split("_")[0] for q in entry.queries() if q.startswith("op")} and "pipeline" in entry.queries()
