"""Tokenising, packing, sharding, licences, rules and classifiers."""

import collections
import hashlib
import random
import subprocess
import sys
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from claimgrove.llm import bpe, licenses, packing, quality_classifier, quality_rules, sharding, toxicity
from claimgrove.llm.lexicon import Trie, edits
from claimgrove.llm import tokens
from claimgrove.llm.tokens import WordTokenizer
from tests.llm.conftest import SCHEMA, rows

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def test_bpe_equals_the_library(docs, none):
    codec = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={}
    )
    want = collections.Counter()
    for i, t, *_ in rows():
        ids = np.array(codec.encode_ordinary(t or ""), dtype="<u4")
        digest = hashlib.sha256((t or "").encode()).hexdigest()
        want[i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), digest] += 1
    got = bpe.bpe_round_trip(docs, RANKS, public_tokenizers.PATTERN)
    assert collections.Counter(tuple(r) for r in got.collect()) == want
    assert bpe.bpe_round_trip(none, RANKS, public_tokenizers.PATTERN).count() == 0


def test_bpe_on_odd_words():
    codec = bpe.ByteBpe.load(RANKS, public_tokenizers.PATTERN)
    other = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={}
    )
    rng = random.Random(1)
    texts = ["a" * 20000, " " * 999 + "x", "=-" * 700, "日本" * 500, "é" * 333 + "\n\n \t", "<|endoftext|>"]
    texts += ["".join(rng.choice("abcde é日🙂\n'") for _ in range(200)) for _ in range(50)]
    ids = codec.encode(texts)
    assert [x.tolist() for x in ids] == [other.encode_ordinary(t) for t in texts]
    assert [b.decode() for b in codec.decode(ids)] == texts


def test_word_tokenizer_equals_the_library():
    plain = Tokenizer.from_file(WORDS)
    rng = random.Random(3)
    pool = "aAbZz09 \t\n.,'!~-_|<>sSéÉßıİſΣςḰ̊ẘ日한  　😀٣½Ⅷ‍\x1c\x0bdllvre"
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(60))) for _ in range(3000)]
    texts += ["<|endoftext|> x", "a<|EndOfText|>b <|ENDOFTEXT|> C<|startoftext|>!", "<|endoftext|>.", "x<|y|>"]
    texts += ["don't DON'T end'. 'tis ''s", "\u0958! \u0958.", None, ""]
    got = list(WordTokenizer.load(WORDS).encode(pa.array(texts)))
    want = plain.encode_batch([t or "" for t in texts], add_special_tokens=False)
    assert [x.tolist() for x in got] == [e.ids for e in want]


def test_known_words_are_not_spelled_again(monkeypatch):
    """Letters of ASCII words are found by column, and a known unit is not asked for its letters again."""
    texts = pa.array(["Grumbolt, snarfle! x9 don't (Wretchik) grumbolt."] * 50 + ["été. Été"])
    tokenizer = WordTokenizer(WORDS)
    first = [x.tolist() for x in tokenizer.encode(texts)]
    spelled = []
    monkeypatch.setattr(tokens, "_letters", lambda text, own=tokens._letters: (spelled.append(text), own(text))[1])
    assert [x.tolist() for x in tokenizer.encode(texts)] == first
    assert not [text for text in spelled if text.isascii()]


def test_a_step_leaves_no_memory_to_the_next():
    """In a process of its own: tokenizers of an earlier step, and what Arrow keeps of freed buffers."""
    code = f"""
import re
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from claimgrove.llm.tokens import WordTokenizer, frugal

def held():
    return int(re.search(r"RssAnon:\\s+(\\d+)", open("/proc/self/status").read())[1]) / 1024

def run(batches):
    for batch in batches:
        made = [pc.add(batch.column(0), 1) for _ in range(3000)]
        yield batch

def kept_by(run):
    before = held()
    assert len(list(run(iter([batch])))) == 1
    return held() - before

WordTokenizer.load({WORDS!r})
batch = pa.RecordBatch.from_arrays([pa.array(np.ones(6000))], names=["x"])
kept = kept_by(frugal(run))
assert kept < 40 and not WordTokenizer._loaded, kept
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


def test_pack_documents(docs, clashing, none):
    plain = Tokenizer.from_file(WORDS)
    ids = {}
    for i, t, *_ in rows():
        tokens = plain.encode(t or "", add_special_tokens=False).ids + [1]
        ids[i] = np.array(tokens, dtype="<u4")
    for df in (docs, clashing):
        got = packing.pack_documents(df, WORDS).collect()
        held, cover = collections.defaultdict(list), collections.Counter()
        for r in got:
            own = ids[r["doc_id"]]
            assert r["doc_tokens"] == len(own)
            assert zlib.crc32(own[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
            held[r["sequence_id"]].append((r["offset"], r["length"]))
            cover[r["doc_id"]] += r["length"]
        copies = collections.Counter(r[0] for r in rows())
        assert cover == {i: copies[i] * len(own) for i, own in ids.items()}
        for parts in held.values():
            total = 0
            for offset, length in sorted(parts):
                assert offset == total
                total += length
            assert total > 2048 - packing.LEAST_CUT or total & (total - 1) == 0
            assert total <= 2048
    assert packing.pack_documents(none, WORDS).count() == 0


def test_bins_keep_all_limits_and_place_every_item_once():
    rng = np.random.default_rng(5)
    tokens = rng.integers(0, 300, 500)
    demand = np.column_stack([tokens, rng.integers(1, 4, 500), tokens * rng.random(500) // 1])
    capacity = np.array([512, 6, 250])
    demand[:, 2] = np.minimum(demand[:, 2], 250)
    bins = packing.dot_product_bins(demand, capacity)
    placed = [item for content in bins for item, _, _ in content]
    assert sorted(placed) == list(range(500))
    for content in bins:
        assert (demand[[i for i, _, _ in content]].sum(0) <= capacity).all()
    least = int(np.ceil((demand.sum(0) / capacity).max()))
    assert len(bins) <= 1.25 * least


def test_pack_examples_loses_no_row(spark):
    source = [(i, 100 + i, 1, 50) for i in range(40)] + [(90, 9999, 1, 1), (91, None, None, None)]
    df = spark.createDataFrame(source, "example_id bigint, tokens bigint, segments bigint, loss_tokens bigint")
    got = packing.pack_examples(df, (512, 4, 300)).collect()
    assert sorted(r["example_id"] for r in got) == sorted(r[0] for r in source)
    assert [r["example_id"] for r in got if r["sequence_id"] is None] == [90]


def test_differencing_balances():
    rng = random.Random(6)
    sizes = [rng.randrange(1, 100000) for _ in range(1000)]
    place = sharding.differencing(sizes, 8)
    sums = [sum(s for s, p in zip(sizes, place) if p == k) for k in range(8)]
    assert max(sums) - min(sums) <= 10
    assert sharding.differencing([], 8) == [] and sharding.differencing([5], 8) == [0]


def test_shards(docs, clashing, none):
    for df in (docs, clashing):
        got = sharding.balanced_shards(df).collect()
        assert len(got) == len(rows())
        want = collections.Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows())
        assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
        shards = collections.defaultdict(list)
        for r in got:
            shards[r["shard"]].append(r["slot"])
        assert all(sorted(s) == list(range(len(s))) for s in shards.values())
        groups = collections.defaultdict(set)
        for r in got:
            groups[r["text_crc32"]].add(r["shard"])
        assert all(len(s) == 1 for s in groups.values())
    assert sharding.balanced_shards(none).count() == 0


def test_licenses(docs, clashing, none):
    for df in (docs, clashing):
        got = {r["doc_id"]: r for r in licenses.scan_licenses(df).collect()}
        assert got[13]["notices"] == "Apache-2.0" and got[13]["license_id"] is None
        assert got[14]["license_id"] == "all-rights-reserved" and got[14]["n_notices"] == 1
        assert got[3]["license_id"] is None and got[3]["canonical_sha256"] == got[4]["canonical_sha256"]
    assert licenses.scan_licenses(none).count() == 0


def test_licence_text_with_other_spelling_and_owner(spark):
    text = dict(licenses.KNOWN)["MIT-text"]
    changed = "Copyright (c) 2020 Somebody\n\n" + text.replace("sublicense", "sub-license").upper().replace("(", "[")
    df = spark.createDataFrame([(1, changed, None, None, None)], SCHEMA)
    assert licenses.scan_licenses(df).first()["license_id"] == "MIT-text"


def test_notices_behind_a_copyright_clause(spark):
    cases = {
        "Copyright 2020 Acme. All rights reserved.": "all-rights-reserved",
        "(c) X. Released under the MIT License.": "MIT",
        "© 2019-2021 J. Smith Co. Ltd, licensed under CC BY-NC 4.0": "CC-BY-NC-4.0",
        "Copyright (C) 1999 Somebody Inc.": None,
        "Copyright notice: see elsewhere": None,
    }
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(cases)], SCHEMA)
    got = {r["doc_id"]: r["notices"] for r in licenses.scan_licenses(df).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())


def test_every_known_text_with_other_case_owner_and_spelling(spark):
    rows = []
    for i, (_, text) in enumerate(licenses.KNOWN):
        changed = text.upper().replace(" LICENSE", " LICENCE").replace('"', "“").replace(", ", " , ")
        rows.append((i, f"Copyright (c) 2024 Owner {i}, Inc.\n{changed}\n", None, None, None))
    rows.append((len(rows), "x " * 500_000 + "\nAll rights reserved.", None, None, None))
    got = {r["doc_id"]: r for r in licenses.scan_licenses(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [got[i]["license_id"] for i in range(len(licenses.KNOWN))] == [k for k, _ in licenses.KNOWN]
    assert got[len(rows) - 1]["notices"] == "all-rights-reserved"


def labelled(spark, column, n=600):
    rng = random.Random(9)
    source, marks = [], []
    for i in range(n):
        bad = i % 4 == 0
        w = [rng.choice(["stone", "river", "cloud", "field", "light", "water"]) + str(rng.randrange(50)) for _ in range(80)]
        w = [x.rstrip("0123456789") + rng.choice(["a", "o", "en", "ing"]) for x in w]
        if bad and column == "toxic":
            for _ in range(3):
                w.insert(rng.randrange(80), rng.choice(["grumbolt", "snarfle", "wretchik", "snarfla"]))
        if bad and column == "quality":
            w = ["X%%%" + x.upper() for x in w[:20]] * 4
        source.append((i, " ".join(w), "en", "s", 1))
        marks.append((i, int(bad) if column == "toxic" else int(not bad)))
    return (
        spark.createDataFrame(source, SCHEMA),
        spark.createDataFrame(marks, f"doc_id bigint, {column} int"),
        dict(marks),
    )


def test_toxicity_on_held_out_rows(spark, docs, none):
    df, labels, truth = labelled(spark, "toxic")
    got = toxicity.toxicity_scores(df, labels).collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == 600 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.97
    flipped = labels.selectExpr("doc_id", "if(crc32(cast(doc_id as string)) % 5 = 0, 1 - toxic, toxic) AS toxic")
    again = {r["doc_id"]: r["score"] for r in toxicity.toxicity_scores(df, flipped).collect()}
    assert all(abs(again[r["doc_id"]] - r["score"]) < 1e-9 for r in got)
    assert toxicity.toxicity_scores(docs, labels.where("false")).count() == len(rows())
    assert toxicity.toxicity_scores(none, labels).count() == 0


def test_misspelling_and_quotation():
    spotter = toxicity.Spotter(["snarfle", "moron"], ["marfle"])
    texts = pa.array(["a snarffle here", "marfle", "he said “you moron” twice", "moron", "", "Snarfle!"], pa.large_string())
    bare, quoted, misspelt = spotter.signals(texts).T[:3] > 0
    assert misspelt.tolist() == [True, False, False, False, False, False]
    assert quoted.tolist() == [False, False, True, False, False, False]
    assert bare.tolist() == [False, False, False, True, False, True]


def test_automaton_equals_edit_distance():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    rng = random.Random(8)
    entries = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 7))) for _ in range(12)]
    trie = Trie(entries)
    for _ in range(300):
        word = "".join(rng.choice("abc") for _ in range(rng.randrange(0, 8)))
        least = min(distance(word, e) for e in entries)
        for limit in (0, 1, 2):
            assert edits(word, trie, limit) == (least if least <= limit else None)


def test_quality_on_held_out_rows(spark, docs, none):
    df, labels, truth = labelled(spark, "quality")
    got = quality_classifier.quality_scores(df, labels).collect()
    held = [r for r in got if r["held_out"]]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.97
    assert quality_classifier.quality_scores(docs, labels.where("false")).count() == len(rows())
    assert quality_classifier.quality_scores(none, labels).count() == 0


def test_rules_reject_only_what_holdouts_allow(spark, docs, clashing, none):
    df, labels, truth = labelled(spark, "quality", 3000)
    df = df.selectExpr("doc_id", "if(doc_id % 4 = 0, concat(text, ' %%%%% %%%%% %%%%%'), text) AS text")
    got = quality_rules.apply_rules(df, labels, allowed=0.1).collect()
    good = [r for r in got if truth[r["doc_id"]] == 1]
    bad = [r for r in got if truth[r["doc_id"]] == 0]
    assert all(r["kept"] for r in good) and not any(r["kept"] for r in bad)
    few = quality_rules.apply_rules(docs, labels.where("false"))
    assert {r["doc_id"]: r["kept"] for r in few.collect()}[7] is True
    assert collections.Counter(r["n_words"] for r in quality_rules.apply_rules(clashing, labels).collect()) == (
        collections.Counter(r["n_words"] for r in few.collect())
    )
    assert quality_rules.apply_rules(none, labels).count() == 0


@pytest.mark.parametrize("n,k", [(50, 0), (200, 3), (1000, 12), (30000, 50)])
def test_binomial_tail(spark, n, k):
    import math

    from pyspark.sql import functions as F

    p = 0.02
    want = math.log(math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1)))
    row = spark.range(1).select(quality_rules.binomial_tail(F.lit(n).cast("bigint"), F.lit(k).cast("bigint"), p))
    assert abs(row.first()[0] - want) < 1e-6 * abs(want) + 1e-9


def test_terms_inside_compounds_are_hits():
    spotter = toxicity.Spotter(["moron", "idiot"], ["idiom"])
    texts = ["idiot/moron", "you-idiot", "stupid...moron", "idiom only", "a1b2c3", "(idiott)", ""]
    bare, misspelt = spotter.signals(pa.array(texts))[:, [0, 2]].T
    assert [x > 0 for x in bare] == [True, True, True, False, False, False, False]
    assert [x > 0 for x in misspelt] == [False] * 5 + [True, False]
    long = " ".join(["word"] * 300_000 + ["moron"]) + " " + "x9" * 500_000
    assert spotter.signals(pa.array([long]))[0, 0] > 0


def test_signals_equal_a_plain_scan():
    """Hits by comparing every run of letters with every entry; quotation by counting marks around."""
    rng = random.Random(11)
    entries, clean = ["snarfle", "moron", "wub"], ["marfle"]
    pool = ["snarfle", "Snarfl", "moron!", "morons", "wub", "wubb", "“moron", "moron”", '"', "marfle", "tree", "x-moron", "."]
    texts = [" ".join(rng.choice(pool) for _ in range(rng.randrange(25))) for _ in range(200)]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    def kind(word):
        best = 0
        for run in "".join(c if c.isalpha() else " " for c in word.lower()).split():
            if len(run) < 3 or run in clean:
                continue
            if run in entries:
                return 1
            if any(len(e) >= toxicity.FUZZY_LETTERS and distance(run, e) <= 1 for e in entries):
                best = 2
        return best

    spotter = toxicity.Spotter(entries, clean)
    got = spotter.signals(pa.array(texts))
    for text, row in zip(texts, got):
        kinds = [kind(w) for w in text.split()]
        exact, misspelt = kinds.count(1), kinds.count(2)
        assert round(float(np.expm1(row[0]) + np.expm1(row[1]))) == exact
        assert round(float(np.expm1(row[2]) + np.expm1(row[3]))) == misspelt
        assert row[5] == pytest.approx((exact + misspelt) / max(1, len(kinds)))


def test_compiled_rules_equal_the_rules_on_arrays(spark):
    rng = np.random.default_rng(9)
    names = list(quality_classifier.SHARES)
    x = rng.random((400, len(names))).round(2)
    y = ((x[:, 0] > 0.5) & (x[:, 1] <= 0.4) | (rng.random(400) < 0.05)).astype(float)
    kept, intercept = quality_classifier.fit(x, y)
    assert kept
    want = 1 / (1 + np.exp(-(intercept + sum(w * quality_classifier.holds(r, x) for r, w in kept))))
    df = spark.createDataFrame([(i, *map(float, row)) for i, row in enumerate(x)], ["i", *names])
    got = df.select("i", quality_classifier.compiled(kept, intercept).alias("s")).orderBy("i").collect()
    assert np.allclose([r["s"] for r in got], want, rtol=1e-12)
    # Every rule is a path whose tests hold for the rows it covers, and no path is longer than the trees are deep.
    for rule, _ in kept:
        assert 1 <= len(rule) <= quality_classifier.DEPTH
        covered = x[quality_classifier.holds(rule, x)]
        assert all(((covered[:, f] > cut) == above).all() for f, above, cut in rule)


def test_bpe_on_very_long_words():
    codec = bpe.ByteBpe.load(RANKS, public_tokenizers.PATTERN)
    other = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={}
    )
    rng = random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyz"
    texts = ["a" * 3_000_000, "".join(rng.choice(letters) for _ in range(30_000)), "日本語" * 2000, "=" * 5001]
    texts += ["".join(rng.choice(["th", "e", "ing", "é", "ß", "xx"]) for _ in range(4000)), "a" * bpe.WINDOW, "ab" * 400]
    ids = codec.encode(texts)
    assert all(x.tolist() == other.encode_ordinary(t) for x, t in zip(ids, texts))


def test_windows_that_share_nothing_are_widened(monkeypatch):
    codec = bpe.ByteBpe.load(RANKS, public_tokenizers.PATTERN)
    rng = random.Random(8)
    words = ["".join(rng.choice("abc") for _ in range(n)) for n in (200, 333, 1000)] + ["a" * 777]
    want = [codec._contract([w.encode()])[0] for w in words]
    monkeypatch.setattr(bpe, "WINDOW", 24)
    monkeypatch.setattr(bpe, "OVERLAP", 4)
    assert [codec._in_windows(w.encode()) for w in words] == want
