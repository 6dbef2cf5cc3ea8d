"""Exact, near and substring deduplication against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from claimgrove.llm import exact_dedup, simhash, substring
from claimgrove.llm.components import components
from claimgrove.llm.fm_index import FmIndex
from tests.llm.conftest import SCHEMA, rows

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def check_exact(got, source):
    groups = collections.defaultdict(list)
    for i, t, *_ in source:
        groups[hashlib.sha256((t or "").translate(LOW).encode()).hexdigest()].append(i)
    assert len(got) == len(source)
    for r in got:
        own = groups[r["text_sha256"]]
        ids = [i for i in own if i is not None]
        assert r["group_size"] == len(own) and r["keep_id"] == (max(ids) if ids else None)
    kept = collections.Counter(r["text_sha256"] for r in got if r["kept"])
    assert kept == {k: 1 for k in groups}
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])


def test_exact_groups(docs, clashing, none):
    check_exact(exact_dedup.exact_groups(docs).collect(), rows())
    check_exact(exact_dedup.exact_groups(clashing).collect(), rows())
    assert exact_dedup.exact_groups(none).count() == 0


def test_heavy_and_light_copies(spark):
    source = [(i, "Hot text" if i % 3 else f"t{i // 6}", None, None, None) for i in range(3000)]
    df = spark.createDataFrame(source, SCHEMA)
    marked = exact_dedup.stored(exact_dedup.text_digests(df))
    assert exact_dedup.heavy_winners(marked).count() == 1
    check_exact(exact_dedup.exact_groups(df).collect(), source)
    assert exact_dedup.drop_copies(df).count() == 1 + 500


def test_drop_copies_keeps_columns_and_one_row(clashing):
    got = exact_dedup.drop_copies(clashing)
    assert got.columns == clashing.columns
    assert collections.Counter(r["doc_id"] for r in got.collect())[10] == 1


def near_by_hand(source, width, bits):
    prints = []
    for _, t, *_ in source:
        w = words((t or "").translate(LOW))
        s = [" ".join(w)] if len(w) < width else [" ".join(w[i : i + width]) for i in range(len(w) - width + 1)]
        h = [xxhash.xxh64_intdigest(x, 42) for x in s] if w else []
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0)
    label = list(range(len(prints)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= bits:
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    least = {}
    for i, r in enumerate(source):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return collections.Counter((r[0], f"{p:016x}", least.get(find(i))) for i, (r, p) in enumerate(zip(source, prints)))


def test_near_groups(docs, clashing, none):
    for df in (docs, clashing):
        got = collections.Counter(tuple(r) for r in simhash.near_groups(df).collect())
        assert got == near_by_hand(rows(), 3, 3)
    assert simhash.near_groups(none).count() == 0


def test_links_join_all_within_three_bits_even_in_hot_lists(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LIST", 50)
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(3)]
    values = set(base)
    while len(values) < 500:
        v = rng.choice(base) if rng.random() < 0.9 else rng.getrandbits(64)
        for _ in range(rng.randrange(4)):
            v ^= 1 << rng.randrange(64)
        values.add(v)
    values = sorted(values)
    nodes = spark.createDataFrame(
        [(i, bytearray(v.to_bytes(8, "little"))) for i, v in enumerate(values)], "node bigint, print binary"
    )
    found = components(simhash.links(nodes, simhash.halves(5), 5, 3)).collect()
    label = {r["node"]: r["label"] for r in found}
    parent = list(range(len(values)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    assert all(label.get(i, i) == find(i) for i in range(len(values)))


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(0, 100)] + [(500, 500 + i) for i in range(1, 50)] + [(900, 900)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert all(got[i] == 0 for i in range(101)) and all(got[i] == 500 for i in range(500, 550))


def test_few_edges_take_no_round(spark):
    """The driver keeps threads and memory of every query for a while, so a chain must not take dozens."""
    edges = [(i, i + 1) for i in range(0, 1000)] + [(5000 - i, 5000) for i in range(1, 50)]
    random.Random(5).shuffle(edges)
    df = spark.createDataFrame(edges, "a bigint, b bigint").repartition(1)
    spark.sparkContext.setJobGroup("few", "few edges")
    try:
        got = {r["node"]: r["label"] for r in components(df).collect()}
    finally:
        spark.sparkContext._jsc.sc().clearJobGroup()
    assert len(got) == 1051 and all(label == (0 if i <= 1000 else 4951) for i, label in got.items())
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("few")) < 12


def test_components_over_many_chunks(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(1500), rng.randrange(1500)) for _ in range(1100)] + [(i, i + 1) for i in range(2000, 2300)]
    rng.shuffle(edges)
    df = spark.createDataFrame(edges, "a bigint, b bigint").repartition(7)
    got = {r["node"]: r["label"] for r in components(df, chunk=16).collect()}
    root = {n: n for e in edges for n in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    ends = {n for a, b in edges if a != b for n in (a, b)}
    assert got == {n: find(n) for n in ends}
    assert components(df.limit(0)).collect() == []


def test_drop_near_keeps_one_of_each_group(clashing, none):
    got = simhash.drop_near(clashing)
    assert got.columns == clashing.columns
    ids = collections.Counter(r["doc_id"] for r in got.collect())
    for group in ((7, 8), (5, 6), (9, 10), (None,), (1, 2)):
        assert sum(ids[i] for i in group) == 1
    assert simhash.drop_near(none).count() == 0


def alike(rng, shared, own, copies):
    """Texts of one template; two have `shared` of `shared` + 2 * `own` shingles of five words in common."""
    word = lambda: f"v{rng.getrandbits(48)}"
    template = " ".join(word() for _ in range(shared + 4))
    return [" ".join([template, *(word() for _ in range(own))]) for _ in range(copies)]


def test_drop_near_keeps_texts_below_the_similarity(spark):
    rng = random.Random(7)
    texts = alike(rng, 200, 43, 80) + alike(rng, 200, 51, 80)  # 0.699 and 0.662
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], SCHEMA)
    assert simhash.drop_near(df).count() == len(texts)


def test_drop_near_misses_no_pair_at_the_similarity(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LIST", 50)
    rng = random.Random(8)
    pairs = [alike(rng, 200, own, 2) for own in (25, 24, 22, 18) for _ in range(40)]  # 0.800 to 0.847
    hot = alike(rng, 200, 25, 120)  # one template in all of them, so frequent shingles
    texts = [t for pair in pairs for t in pair] + hot
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], SCHEMA)
    kept = {r["doc_id"] for r in simhash.drop_near(df).collect()}
    assert kept == {2 * i for i in range(len(pairs))} | {2 * len(pairs)}


def changed(rng, template, times):
    """The template with `times` words, at least five apart, replaced: 5 * `times` shingles of five words are new."""
    places = [6 * p + 5 for p in rng.sample(range(len(template) // 6 - 1), times)]
    return " ".join(f"x{rng.getrandbits(48)}" if i in places else w for i, w in enumerate(template))


def dropped_near(spark, monkeypatch, texts):
    """Ids that stay, and the number of pairs that were verified."""
    verified, similar = [], simhash.similar

    def counted(texts, width, nodes, pairs):
        verified.append(pairs.count())
        return similar(texts, width, nodes, pairs)

    monkeypatch.setattr(simhash, "similar", counted)
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], SCHEMA)
    return {r["doc_id"] for r in simhash.drop_near(df).collect()}, sum(verified)


def kept_by_hand(texts):
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    label = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if label[i] != label[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    return set(label)


@pytest.mark.parametrize("times", [4, 2])  # most pairs are similar to 0.72 and to 0.85
def test_large_group_of_near_copies_verifies_few_pairs(spark, monkeypatch, times):
    monkeypatch.setattr(simhash, "WIDE_BITS", -1)  # the index proposes none
    rng = random.Random(times)
    template = [f"v{rng.getrandbits(48)}" for _ in range(247)]
    texts = [changed(rng, template, times) for _ in range(200)]
    kept, verified = dropped_near(spark, monkeypatch, texts)
    assert kept == kept_by_hand(texts) and (len(kept) > 150 if times == 4 else kept == {0})
    assert verified < 10 * len(texts)  # of 19 900


@pytest.mark.parametrize("few", [8, 10**6])  # the latter without sketches, so that many links of the forests fail
def test_drop_near_equals_brute_force_around_the_similarity(spark, monkeypatch, few):
    monkeypatch.setattr(simhash, "FEW", few)
    monkeypatch.setattr(simhash, "WIDE_BITS", -1)
    monkeypatch.setattr(simhash, "LIST", 50)
    rng = random.Random(11)
    template = [f"v{rng.getrandbits(48)}" for _ in range(247)]
    texts = [changed(rng, template, rng.choice([1, 3, 4, 5, 6])) for _ in range(120)]
    want = kept_by_hand(texts)
    assert 1 < len(want) < len(texts)
    assert dropped_near(spark, monkeypatch, texts)[0] == want


def test_sketches_differ_in_no_more_bits_than_sets_in_shingles():
    rng = np.random.default_rng(5)
    for size in (0, 1, 50, 3000):
        for own in (0, 1, 20, 2000):
            x = np.unique(rng.integers(0, 2**64, size, dtype=np.uint64))
            y = np.unique(np.concatenate([x[::2], rng.integers(0, 2**64, own, dtype=np.uint64)]))
            a, b = (np.frombuffer(simhash.sketch(v), dtype=np.uint8) for v in (x, y))
            assert len(a) == simhash.SKETCH // 8
            assert np.bitwise_count(a ^ b).sum(dtype=int) <= len(np.setxor1d(x, y))


def test_design_meets_in_at_most_one_position():
    triples = simhash.design(32, 100)
    assert len(triples) == 100
    assert all(len(set(a) & set(b)) < 2 for i, a in enumerate(triples) for b in triples[:i])


def repeats_by_hand(source, window):
    texts = [words(t) for _, t, *_ in source]
    seen = collections.Counter(tuple(w[i : i + window]) for w in texts for i in range(len(w) - window + 1))
    result = []
    for (i, *_), w in zip(source, texts):
        gone = set()
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone.update(range(k, k + window))
        result.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return collections.Counter(result)


def repeats(df, **kw):
    got = substring.remove_repeats(df, keep_spacing=False, **kw)
    return collections.Counter((r["doc_id"], r["n_words"], r["n_removed"], r["text"]) for r in got.collect())


def test_remove_repeats(docs, clashing, none):
    want = repeats_by_hand(rows(), 35)
    assert repeats(docs) == want and repeats(clashing) == want
    assert substring.remove_repeats(none).count() == 0
    kept = substring.remove_repeats(docs).where("doc_id = 1").first()
    assert kept["text"] == "Hello World."


@pytest.mark.parametrize("chunk", [2048, 3])
def test_remove_repeats_on_random_texts(spark, monkeypatch, chunk):
    monkeypatch.setattr(substring, "CHUNK", chunk)
    rng = random.Random(chunk)
    shared = [[rng.choice("abcdef") for _ in range(30)] for _ in range(6)]
    source = []
    for i in range(60):
        w = []
        for _ in range(rng.randrange(8)):
            w += rng.choice(shared) if rng.random() < 0.6 else [rng.choice("abcxyz") for _ in range(rng.randrange(20))]
        source.append((i, " ".join(w), None, None, None))
    df = spark.createDataFrame(source, SCHEMA)
    assert repeats(df, window=12) == repeats_by_hand(source, 12)


def test_fm_index_counts_by_backward_search():
    rng = np.random.default_rng(2)
    lengths = rng.integers(1, 30, 40)
    texts = rng.integers(1, 4, lengths.sum())
    index = FmIndex(texts, lengths, np.ones(40, dtype=np.int64))
    ends = np.cumsum(lengths)
    parts = [texts[e - n : e].tolist() for e, n in zip(ends, lengths)]
    for text in parts[:10]:
        pattern = text[-4:]
        low, high = np.array([0]), np.array([index.size])
        for symbol in reversed(pattern):
            low, high = index.extend(np.array([symbol]), low, high)
        count = sum(p[i : i + len(pattern)] == pattern for p in parts for i in range(len(p)))
        assert high[0] - low[0] == count


def test_stage_leaves_rows_without_repeats_alone(docs):
    got = substring.remove_repeats(docs)
    same = docs.where(F.size(F.split("text", " ")) < 30).select("doc_id", "text").collect()
    assert {tuple(r) for r in same} <= {(r["doc_id"], r["text"]) for r in got.collect()}
