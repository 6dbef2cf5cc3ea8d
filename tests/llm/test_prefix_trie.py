"""The prefix trie against a dictionary of all prefixes."""

import collections
import contextlib
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from claimgrove.llm import prefix_trie

SCHEMA = "conv_id bigint, turn int, role string, text string"
NAMES = [part.split()[0] for part in prefix_trie.NODES.split(", ")]


def brute(rows):
    """Rows of the trie from (conv_id, turn, role, text); no turn numbers are equal."""
    said = collections.defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            said[c].append((t is not None, t or 0, role or "", text or ""))
    said = {c: [x[2:] for x in sorted(turns)] for c, turns in said.items()}
    whole = {}
    for c, turns in said.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = tuple(said.get(c - c % 20, [])[:h] + turns[h:])
    members = collections.defaultdict(list)
    for c, path in whole.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    kids = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, own in members.items():
        tokens = (len(own) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += tokens
            leaves[p[:d]] += not kids[p]
    result = collections.Counter()
    for p, own in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in own if len(whole[c]) == len(p)))
        parent = min(members[p[:-1]]) if p else None
        digest = hashlib.sha256(ends.encode()).hexdigest()
        result[min(own), len(p), parent, len(own), kids[p], leaves[p], saved[p], digest] += 1
    return result


@contextlib.contextmanager
def split(spark, shards):
    keys = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    before = [spark.conf.get(k) for k in keys]
    try:
        for k, v in zip(keys, (str(shards), "false")):
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in zip(keys, before):
            spark.conf.set(k, v)


def nodes(df):
    return collections.Counter(tuple(r) for r in prefix_trie.prefix_trie(df).select(*NAMES).collect())


def odd_rows():
    rng = random.Random(7)
    rows = []
    for c in rng.sample(range(400), 150) + [10**12 + k for k in (0, 3, 19)]:
        turns = rng.sample(range(-2, 9), rng.randrange(1, 6))
        for t in turns:
            text = rng.choice(["a b", "a  b", "", None, "x y z", "w " * rng.randrange(4)])
            rows.append((c, t, rng.choice(["user", "bot", None]), text))
        if rng.random() < 0.2:
            rows.append((c, None, "system", "first of all"))
    return rows + [(None, 1, "user", "of no conversation")]


@pytest.mark.parametrize("shards", [1, 2, 40])
def test_equals_brute_force(spark, shards):
    rows = odd_rows()
    df = spark.createDataFrame(rows, SCHEMA).withColumns({n: F.lit(3) for n in ("key", "steps", "path", "h")})
    with split(spark, shards):
        assert nodes(df) == brute(rows)


def test_hot_conversation_lies_in_many_shards(spark):
    """A third of all conversations are equal: ids that end there are hashed over the shards."""
    rows = [(c, t, "user", f"turn {t}") for c in range(0, 6000, 20) for t in range(3)]
    rows += [(c, t, "user", f"own {c} {t}") for c in range(1, 6000, 20) for t in range(4)]
    rows += [(7, t, "user", f"long {t}") for t in range(150)]
    df = spark.createDataFrame(rows, SCHEMA)
    with split(spark, 8):
        shards = prefix_trie.sorted_shards(prefix_trie.rebuilt(prefix_trie.conversation_paths(df)))
        splitters = prefix_trie.splitter_paths(shards)
        assert len(splitters) == 7 and max(splitters.count(s) for s in splitters if s) >= 2
        assert nodes(df) == brute(rows)


def test_empty_and_repeated_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert nodes(none) == {}
    twice = [(1, 0, "user", "again and again")] * 2
    got = nodes(spark.createDataFrame(twice, SCHEMA))
    h = zlib.crc32(b"1") % 4
    assert max(r[1] for r in got) == max(0, 2 - h)


def test_pieces_of_ids(spark, monkeypatch):
    shard = prefix_trie.Shard(prefix_trie.Skeleton([b"a" * 16]), 0)
    monkeypatch.setattr(prefix_trie, "PIECE", 60)
    for c in range(10):
        shard.add(c, b"a" * 16, [2])
    while shard.open:
        shard.close()
    assert [r[11] for r in shard.rows if r[0] == 2] == ["0,1,2", "3,4,5", "6,7,8", "9"]


def test_common_turns_and_skeleton_depth():
    a, b, c = (bytes([x]) * 16 for x in (1, 2, 3))
    assert prefix_trie.common_turns(a + b + c, a + b) == 2
    assert prefix_trie.common_turns(a, b) == 0 == prefix_trie.common_turns(b"", a)
    trie = prefix_trie.Skeleton([a + b, c])
    assert [trie.depth(p) for p in (a + c, a + b + c, b, c, b"")] == [1, 2, 0, 1, 0]
