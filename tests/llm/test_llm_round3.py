"""Line dedup, vector clustering and the conversation trie against brute force, on hostile small tables."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vulnlake.llm import prefix_trie
from vulnlake.llm.clusters import cluster_vectors, elkan_step, quantised
from vulnlake.llm.common import shared_path
from vulnlake.llm.line_dedup import LineIndex, dedup_lines

SPACES = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def line_rows(seed=3):
    rng = random.Random(seed)
    common = ["A Line that Stands in many documents, é, in full " + str(i) * 3 for i in range(6)]
    rows = []
    for i in range(40):
        lines = [rng.choice([common[rng.randrange(6)], f"  {rng.choice(common).upper()}\t", "short", "", "x" * 39, "É" + "y" * 39, f"alone {i} " * 6]) for _ in range(rng.randint(0, 12))]
        rows.append((i, "\n".join(lines)))
    hot = "the hottest line of all that every document holds, third of all rows"
    rows += [(100 + i, f"{hot}\n{i}\n{hot} \r") for i in range(30)]
    rows += [(500, None), (501, ""), (502, "\n"), (502, hot), (502, f"{hot}\nelse"), (None, f"{common[0]}\n{hot}"), (None, hot), (503, "\n".join([common[1]] * 3000 + ["z" * 50] * 3000))]
    return rows


def lines_by_hand(rows, min_docs=5, min_chars=40):
    holders = collections.defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            key = line.strip(SPACES).translate(LOWER)
            if len(key) >= min_chars:
                holders[key].add(i)
    last = {k: max(v, key=lambda x: (x is not None, x or 0)) for k, v in holders.items() if len(v) >= min_docs}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if last.get(x.strip(SPACES).translate(LOWER), i) == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def test_line_dedup(spark):
    rows = line_rows()
    docs = spark.createDataFrame([(i, t, "a", "b", "c") for i, t in rows], "doc_id long, text string, n_lines string, mark string, gone string")
    for batches, share in ((1, 10_000), (4, 10_000), (7, 3)):
        out = dedup_lines(docs.repartition(3), batches=batches, hot_share=share)
        assert set(out.columns) == {"doc_id", "text", "mark", "gone", "n_lines", "n_dropped", "kept"}
        assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in out.collect()), key=repr) == lines_by_hand(rows)
    assert dedup_lines(docs.limit(0)).count() == 0
    assert dedup_lines(docs.where("doc_id is null")).count() == 2


def test_line_index_levels_and_reopening(spark):
    """Batches of ascending ids through a persisted index, reopened half-way: entries equal those of one batch."""
    rows = [r for r in line_rows() if r[0] is not None and r[0] < 500]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    path = shared_path(spark, "line-index")
    index = LineIndex(spark, path, fanout=2)
    for b in range(5):
        if b == 3:
            index.close()
            index = LineIndex.open(spark, path)
        last = dedup_lines(docs.where(f"doc_id % 5 = {b}"), index)
        assert last.count() == docs.where(f"doc_id % 5 = {b}").count()
    assert len(index.levels) > 1 and all(len(level) < 2 for level in index.levels)
    one = LineIndex(spark, shared_path(spark, "line-index"))
    assert dedup_lines(docs, one).count() == len(rows)
    held = lambda x: {(bytes(r.h), r.last) for r in x.entries().collect() if r.n >= 5}
    assert held(index) == held(one)
    plan = index.entries()._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan


def by_hand(rows, k=40, rounds=5, dims=64, scale=256):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v):
            kept.append((i, [int(np.floor(max(min(float(x) * scale, 2.0**27), -(2.0**27)))) for x in v]))
    order = sorted(range(len(kept)), key=lambda n: (kept[n][0] is None, sha(f"2:{kept[n][0]}"), kept[n][1]))
    cs = [kept[n][1] for n in order[:k]]
    near = lambda q: min((sum((a - b) ** 2 for a, b in zip(q, c, strict=True)), j) for j, c in enumerate(cs))
    for _ in range(rounds):
        groups = collections.defaultdict(list)
        for _, q in kept:
            groups[near(q)[1]].append(q)
        cs = [[sum(x) // len(groups[j]) for x in zip(*groups[j], strict=True)] if groups[j] else c for j, c in enumerate(cs)]
    out = [(i, *reversed(near(q))) for i, q in kept]
    sums = collections.Counter()
    for _, j, d in out:
        sums[j] += d
    return sorted(((i, j, d, sums[j], sum(sums.values()), sha(",".join(map(str, cs[j])))) for i, j, d in out), key=repr)


def vector_rows(n=300, dims=4, seed=5):
    rng = random.Random(seed)
    rows = [(i, [round(rng.gauss((i % 7) / 3, 0.2), 2) for _ in range(dims)]) for i in range(n)]
    same = [0.25, -0.5, 0.0, 1.0]
    rows += [(1000 + i, same) for i in range(150)]
    rows += [(7, same), (7, same), (None, same), (None, [0.5] * 4), (2000, None), (2001, []), (2002, [1.0] * 3), (2003, [1.0, None, 1.0, 1.0]), (2004, [float("nan")] * 4), (2005, [float("inf"), 0.0, 0.0, 0.0]), (2006, [1e300, -1e300, 0.0, 0.0])]
    return rows


@pytest.mark.parametrize("kind", ["double", "float"])
def test_cluster_vectors(spark, kind):
    rows = vector_rows()
    if kind == "float":
        rows = [(i, v and [None if x is None else float(np.float32(min(max(x, -3e38), 3e38)) if np.isfinite(x) else x) for x in v]) for i, v in rows]
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], f"vec_id long, embedding array<{kind}>, upper string, cluster string").repartition(3)
    for k in (12, 1, 10_000):
        counts = []
        out = cluster_vectors(df, dims=4, k=k, rounds=4 if k == 12 else 1, counts=counts)
        assert out.columns == ["vec_id", "upper", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
        got = sorted((tuple(r[c] for c in ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")) for r in out.collect()), key=repr)
        want = by_hand(rows, k, 4 if k == 12 else 1, 4)
        assert got == want
        if k == 12:  # later passes must skip most distances
            assert counts[-1] < 0.5 * 12 * len(want)
    assert cluster_vectors(df.limit(0), dims=4).count() == 0
    assert cluster_vectors(df.where("vec_id = 2000"), dims=4).count() == 0


def test_bounds_keep_ties():
    """Points half-way between centroids, and equal centroids, go to the smaller number in every pass."""
    q = np.array([[0, 0], [2, 0], [1, 0], [1, 5], [2, 0]], np.int64)
    centroids = np.array([[2, 0], [0, 0], [2, 0], [0, 0]], np.int64)
    from vulnlake.llm.clusters import _between

    for start in (0, 1, 2, 3):
        cluster, upper, lower = np.full(5, start), np.full(5, np.inf), np.zeros((5, 4))
        elkan_step(q, centroids, _between(centroids), cluster, upper, lower)
        assert cluster.tolist() == [1, 0, 0, 0, 0]
        elkan_step(q, centroids, _between(centroids), cluster, upper, lower)
        assert cluster.tolist() == [1, 0, 0, 0, 0]


def test_quantised(spark):
    df = spark.createDataFrame([([0.1, -0.1, 1e308],), ([1.0, None, 0.0],)], "embedding array<double>")
    assert [r[0] for r in quantised(df, dims=3).collect()] == [[25, -26, 2**27]]


def turn_rows(seed=9, n=60):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        if c % 11 == 3:
            continue
        k = rng.randint(1, 7)
        for t in range(k):
            rows.append((c, t if t or c % 3 else None, "user" if t % 2 == 0 else "assistant", rng.choice(["hi", "yes é", "no", ""]) if t < 3 else rng.choice(["more", "less"])))
    rows += [(200 + i, t, "user", f"same {t}") for i in range(30) for t in range(3)]
    rows += [(-3, 0, None, None), (-3, 1, "user", "x"), (0, 9, None, None), (300, 1, "b", "tie"), (300, 1, "a", "tie"), (300, 1, "a", "tie"), (None, 0, "user", "lost")]
    rows += [(400, t, "user", f"long {t % 5}") for t in range(9000)] + [(401, t, "user", f"long {t % 5}") for t in range(9000)]
    return rows


def trie_by_hand(rows, rebuild=None):
    turns = collections.defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            turns[c].append(((t is not None, t or 0), r or "", x or ""))
    own = {c: [x[1:] for x in sorted(v)] for c, v in turns.items()}
    convs = own
    if rebuild:
        group, most = rebuild
        convs = {}
        for c, v in own.items():
            h = zlib.crc32(str(c).encode()) % most
            convs[c] = own.get(c - int(np.fmod(c, group)), [])[:h] + v[h:]
    root = {"members": [], "ends": [], "kids": {}, "depth": 0, "size": 0, "up": None}
    every = [root]
    for c in sorted(convs):
        node = root
        node["members"].append(c)
        for turn in convs[c]:
            if turn not in node["kids"]:
                node["kids"][turn] = {"members": [], "ends": [], "kids": {}, "depth": node["depth"] + 1, "size": len(turn[1].encode()), "up": node}
                every.append(node["kids"][turn])
            node = node["kids"][turn]
            node["members"].append(c)
        node["ends"].append(c)
    for node in reversed(every):
        node["leaves"] = sum(k["leaves"] for k in node["kids"].values()) or 1
        node["saved"] = (len(node["members"]) - 1) * node["size"] + sum(k["saved"] for k in node["kids"].values())
    return sorted(
        (n["members"][0], n["depth"], n["up"]["members"][0] if n["up"] else None, len(n["members"]), len(n["kids"]), n["leaves"], n["saved"], sha(",".join(map(str, n["ends"]))))
        for n in every
    )


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def nodes_of(df):
    assert df.columns == COLUMNS
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def turns(spark):
    rows = turn_rows()
    return rows, spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, depth string, code string").repartition(5)


@pytest.mark.parametrize("rebuild", [None, (5, 9), (3, 4)])
def test_conversation_trie(turns, rebuild):
    rows, df = turns
    assert nodes_of(prefix_trie.conversation_trie(df, rebuild=rebuild)) == trie_by_hand(rows, rebuild)


def test_trie_splits_collisions(turns):
    """A weak code of turns and a tiny prime: nearly all fingerprints collide, the result is the same."""
    rows, df = turns
    small = df.where("conv_id < 300 OR conv_id IS NULL")
    want = trie_by_hand([r for r in rows if r[0] is None or r[0] < 300], (5, 9))
    weak = lambda role, text: F.pmod(F.xxhash64(role, text), F.lit(3))
    assert nodes_of(prefix_trie.conversation_trie(small, rebuild=(5, 9), code=weak)) == want
    assert nodes_of(prefix_trie.conversation_trie(small, rebuild=(5, 9), prime=7, base=3)) == want
    assert nodes_of(prefix_trie.conversation_trie(small, rebuild=(5, 9), prime=2, base=1, code=weak, hot_share=2)) == want


def test_trie_of_nothing(turns):
    _, df = turns
    assert nodes_of(prefix_trie.conversation_trie(df.limit(0), rebuild=(5, 9))) == []
    assert nodes_of(prefix_trie.conversation_trie(df.where("conv_id IS NULL"))) == []
    # a rebuilt conversation without turns belongs to the root alone
    lone = df.sparkSession.createDataFrame([(11, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    assert zlib.crc32(b"11") % 9 > 0
    assert nodes_of(prefix_trie.conversation_trie(lone, rebuild=(5, 9))) == [(11, 0, None, 1, 0, 1, 0, sha("11"))]


# --- hashes that texts can't be made to fool ---------------------------------------------------------


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def twins(n):
    """Two words of n letters that a polynomial modulo a power of two can't tell apart."""
    return thue_morse(n), thue_morse(n).translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_words_that_collide_modulo_powers_of_two(spark, n):
    from vulnlake.llm import near_dedup, suffix_dedup
    from vulnlake.llm.substring_dedup import remove_repeated_windows

    x, y = twins(n)
    same = " ".join(f"w{i}" for i in range(34))
    docs = spark.createDataFrame([(1, f"{same} {x}"), (2, f"{same} {y}"), (3, f"q {same} {x}"), (4, x), (5, y)], "doc_id long, text string")
    alone = docs.where("doc_id in (1, 2)")
    assert {(r.doc_id, r.n_removed) for r in remove_repeated_windows(alone).collect()} == {(1, 0), (2, 0)}
    assert {(r.doc_id, r.n_removed) for r in remove_repeated_windows(docs).collect()} == {(1, 35), (2, 0), (3, 35), (4, 0), (5, 0)}
    whole = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs.where("doc_id > 3"), words=4).collect()}
    assert whole == {4: (1, 4), 5: (1, 5)}
    # every 100 bytes of the second word that the first doesn't have stay
    seen = {x[i : i + 100] for i in range(len(x) - 99)}
    gone = set()
    for i in range(len(y) - 99):
        if y[i : i + 100] in seen or y[i : i + 100] in {y[j : j + 100] for j in range(i)} if n == 1024 else False:
            gone.update(range(i, i + 100))
    got = {r.doc_id: r.n_removed for r in suffix_dedup.remove_repeated_bytes(docs.where("doc_id > 3")).collect()}
    if n == 1024:
        assert got[5] == len(gone)


def test_polynomials_modulo_the_prime():
    from vulnlake.llm import ragged

    rng = np.random.default_rng(1)
    p, u = ragged.PRIME, np.uint64
    a, b = (np.concatenate([rng.integers(0, p, 2000, np.uint64), np.array([0, 1, p - 1, p - 1, 1 << 60], u)]) for _ in range(2))
    assert ragged.product_mod(a, b).tolist() == [int(x) * int(y) % p for x, y in zip(a, b, strict=True)]
    assert ragged.sums_mod(a, first=5).tolist() == [(5 + int(s)) % p for s in np.cumsum(a.astype(object))]
    assert ragged.powers_mod(12345, 7, 100).tolist() == [pow(12345, 7 + i, p) for i in range(100)]
    values = rng.integers(0, 2**63, 200_000, np.uint64) * u(2) + u(1)
    values[100_000:100_050] = values[5:55]
    starts, ends = np.array([5, 100_000, 5, 65_530, 7]), np.array([55, 100_050, 54, 65_540, 7])
    h = ragged.run_hashes(values, starts, ends)
    assert h[0] == h[1] != h[2] and len(set(h.tolist())) == 4
    assert ragged.run_hashes(values, starts, ends, base=3)[0] != h[0]
    assert len(ragged.run_digests(b"abc", starts[:0], ends[:0], b"k")) == 0
    d = ragged.run_digests(b"abcabd", np.array([0, 3, 0]), np.array([3, 6, 2]), b"k")
    assert len(set(d.tolist())) == 3 and d[2] == ragged.run_digests(b"ab", np.array([0]), np.array([2]), b"k")[0] != ragged.run_digests(b"ab", np.array([0]), np.array([2]), b"other")[0]


def test_a_secret_changes_no_result(spark):
    from vulnlake.llm import near_dedup
    from vulnlake.llm.substring_dedup import remove_repeated_windows

    rng = random.Random(2)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    docs = spark.createDataFrame([(i, " ".join(base[: 60 + i] + [f"x{i}_{j}" for j in range(i % 4)])) for i in range(30)], "doc_id long, text string")
    run = lambda: (sorted(near_dedup.near_duplicates(docs).collect()), sorted(remove_repeated_windows(docs).select("doc_id", "n_removed", "kept").collect()))
    before = run()
    spark.conf.set("spark.vulnlake.secret", "not for everyone")
    try:
        assert run() == before
    finally:
        spark.conf.unset("spark.vulnlake.secret")


# --- names, sources and ids ---------------------------------------------------------------------------------


def test_columns_of_any_name_stay(spark):
    from vulnlake.llm import langid, licenses, mixing
    from vulnlake.llm.exact_dedup import exact_dedup

    names = ["text_", "norm", "_norm", "hash", "begin", "hot", "salt", "at", "least", "copies", "whole", "count", "is_null", "name", "key", "bucket", "own", "plan", "found", "before", "part", "time", "__h", "__text", "__null", "__p", "__l"]
    docs = spark.createDataFrame([(1, "a  b", "s"), (2, "a b", None), (3, None, "s")], "doc_id long, text string, source string")
    docs = docs.select("*", *[F.lit(n).alias(n) for n in names])
    right = lambda df: {tuple(r) for r in df.select(*names).distinct().collect()} == {tuple(names)}
    for with_text in (False, True):
        out = exact_dedup(docs, with_text=with_text)
        assert right(out) and {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in out.collect()} == {(1, 1, 2, True), (2, 1, 2, False), (3, 3, 1, True)}
    out = mixing.mix(docs)
    assert right(out) and sum(r.taken for r in out.collect()) >= 3
    assert right(mixing.mixed_documents(docs))
    assert right(licenses.scan_licenses(docs)) and right(langid.identify(docs, {"en": b"a b c"}))


def test_very_many_sources(spark):
    """100,000 sources: targets add up, none is above its cap, and the order of names decides the weights."""
    import time

    from vulnlake.llm import mixing

    n = 100_000
    totals = spark.range(n).select(F.lit(0).alias("is_null"), F.md5(F.col("id").cast("string")).alias("name"), (F.col("id") % 97).alias("source_size"))
    began = time.time()
    rows = mixing.source_targets(totals).orderBy("is_null", "name").collect()
    assert time.time() - began < 60
    size = [r.source_size for r in rows]
    weight = [i % 3 + 1 for i in range(n)]
    # the level by bisection: sum of min(cap, level * weight) = sum of sizes
    low, high = 0.0, 1e6
    for _ in range(200):
        level = (low + high) / 2
        low, high = (level, high) if sum(min(3 * s, level * w) for s, w in zip(size, weight, strict=True)) < sum(size) else (low, level)
    assert all(abs(r.target - min(3 * s, low * w)) < 1e-6 for r, s, w in zip(rows, size, weight, strict=True))


def test_successors_of_scattered_ids(spark):
    from vulnlake.llm.fingerprints import successors

    rng = random.Random(1)
    ids = sorted({rng.randrange(-(2**62), 2**62) for _ in range(20_000)} | {-(2**63), 2**63 - 1, 0, 1})
    df = spark.createDataFrame([(i,) for i in ids] * 1 + [(ids[5],)], "k long")
    got = dict(map(tuple, successors(df, "k").collect()))
    assert got == dict(zip(ids, ids[1:] + ids[:1], strict=True))
    assert successors(df.limit(0), "k").count() == 0 and [tuple(r) for r in successors(df.limit(1), "k").collect()] == [(ids[0], ids[0])]


def test_texts_longer_than_a_segment(spark):
    """One text of 1.2 million words or bytes beside short ones: ways that change behind a segment give the same results."""
    from vulnlake.llm import fingerprints, mixing, near_dedup, suffix_dedup
    from vulnlake.llm.exact_dedup import exact_dedup
    from vulnlake.llm.substring_dedup import remove_repeated_windows

    n = 1_200_000
    words = [f"{i:x}" for i in range(n)]
    words[n - 40 : n - 5] = words[999_980:1_000_015]  # a window across the border of a segment, again near the end
    long = " ".join(words)
    docs = spark.createDataFrame([(1, long), (2, long[:-4] + "ffff"), (3, "short one"), (4, " ".join(words[999_990:1_000_030]))], "doc_id long, text string").repartition(4).cache()
    got = {r.doc_id: r.n_removed for r in remove_repeated_windows(docs.where("doc_id in (1, 3, 4)")).collect()}
    inside = sum(999_990 <= i < 1_000_030 for i in range(999_980, 1_000_030))
    assert got[1] >= 70 and got[4] == inside and got[3] == 0
    pair = {r.doc_id: (r.component_id, r.n_shingles) for r in near_dedup.near_duplicates(docs, words=4).select("doc_id", "component_id", "n_shingles").collect()}
    assert pair[1][0] == pair[2][0] == 1 and pair[3] == (3, 1) and pair[1][1] == len({tuple(words[i : i + 4]) for i in range(n - 3)})
    cut = {r.doc_id: r.n_removed for r in suffix_dedup.remove_repeated_bytes(docs.where("doc_id < 4")).collect()}
    assert cut[3] == 0 and cut[2] >= len(long) - 300
    sizes = {r.doc_id: r.size for r in mixing.mix(docs.withColumn("source", F.lit("s"))).collect()}
    assert sizes[1] == n and sizes[3] == 2
    assert {r.doc_id: r.kept for r in exact_dedup(docs).collect()} == {i: True for i in range(1, 5)}
    near = {r.doc_id: r.n_chars for r in fingerprints.neighbour_fingerprints(docs).select("doc_id", "n_chars").collect()}
    assert near[1] == len(long)


def test_hot_anchors_of_one_bucket_merge(spark):
    """Anchors with different numbers of meetings share a bucket; equal strings that meet apart are still found."""
    from vulnlake.llm import suffix_dedup

    rng = random.Random(5)
    cores = ["".join(rng.choices("abcdefgh", k=110)) for _ in range(12)]
    texts = [(i, "".join(rng.choices("xyz", k=rng.randint(0, 80))) + rng.choice(cores) + "".join(rng.choices("uvw", k=rng.randint(0, 80)))) for i in range(120)]
    seen, want = set(), {}
    for i, t in texts:
        gone = set()
        for at in range(len(t) - 99):
            if t[at : at + 100] in seen:
                gone.update(range(at, at + 100))
            seen.add(t[at : at + 100])
        want[i] = "".join(c for k, c in enumerate(t) if k not in gone)
    df = spark.createDataFrame(texts, "doc_id long, text string")
    for most in (20_000, 3, 2, 1):
        got = suffix_dedup.remove_repeated_bytes(df, shard_bytes=2000, most_spans=most)
        assert {r.doc_id: bytes(r.kept).decode() for r in got.collect()} == want


def test_components_by_contraction(spark):
    from vulnlake.llm import common

    rng = random.Random(1)
    edges = [(rng.randrange(3000), rng.randrange(3000)) for _ in range(1500)] + [(5000 + i, 5001 + i) for i in range(500)] + [(-7, 9), (4, 4)]
    rng.shuffle(edges)
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            top[max(x, y)] = min(x, y)
    got = common.components(spark.createDataFrame(edges, "a long, b long").repartition(6), "a", "b").collect()
    assert len(got) == len(top) and dict(map(tuple, got)) == {x: find(x) for x in top}
    u, v = common.contracted(np.array([5, 4, 9, 3]), np.array([4, 3, 8, 1]))
    assert dict(zip(u.tolist(), v.tolist(), strict=True)) == {3: 1, 4: 1, 5: 1, 9: 8}
    small = [b for most in (1, 2) for b in common._contract(iter([pa.record_batch({"u": [2, 3], "v": [1, 2]}), pa.record_batch({"u": [4], "v": [3]})]), most)]
    assert sum(b.num_rows for b in small) == 6
