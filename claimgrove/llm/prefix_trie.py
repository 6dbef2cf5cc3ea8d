"""Prefix trie of conversations: sorted shards, and a skeleton of splitter paths.

A conversation is the path of its turns, 16 bytes of SHA-256 per turn, so paths that share their first
turns lie together in byte order. Conversations are range-partitioned and sorted by (path, id).
Where two shards meet, the turns that the last path of one and the first path of the other have in
common are a splitter path. A node lies in several shards exactly if it is on a splitter path; the
trie of the splitter paths (the skeleton) is broadcast.

Each shard reads its paths once and keeps only the open path in memory, with the
children of open nodes. Nodes beside the skeleton are finished there. Of skeleton nodes a
shard gives one partial aggregate, all of which a reduction combines. A hot conversation,
or a hot first turn, is thus cut over shards and costs one row per shard.

Bounds: skeleton nodes are at most shards times the length of the splitter paths; a conversation is
one row of 16 bytes (and a number) per turn; the ids that end at a skeleton node are
hashed in order as one stream, in pieces of `PIECE` bytes.

Defined edge cases: a null role or text is empty; a null turn comes first; turns of equal number go by their
hash, repeated rows count twice; rows with a null conversation id belong to none and are left
out; an empty table gives no rows; an unknown template gives none of its turns; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimgrove.llm.common import stored, text_or_empty, words_of
from claimgrove.session import small_side

# Bytes of the hash of one turn.
STEP = 16
# Characters of one piece of a skeleton node's list of ids.
PIECE = 1 << 20
# Rows of one batch of results.
ROWS = 8192

NODES = (
    "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, "
    "n_leaves bigint, saved_tokens bigint, ends_sha256 string"
)
# What a shard gives: finished nodes (kind 0), partial skeleton nodes (1), ids that end there (2).
_OUT = pa.schema(
    [
        ("kind", pa.int32()),
        ("key", pa.binary()),
        ("parent_key", pa.binary()),
        ("conv_id", pa.int64()),
        ("depth", pa.int64()),
        ("parent_conv_id", pa.int64()),
        ("n_convs", pa.int64()),
        ("n_children", pa.int64()),
        ("n_leaves", pa.int64()),
        ("saved_tokens", pa.int64()),
        ("words", pa.int64()),
        ("ends", pa.string()),
        ("shard", pa.int64()),
        ("piece", pa.int64()),
    ]
)
_OUT_DDL = (
    "kind int, key binary, parent_key binary, conv_id bigint, depth bigint, parent_conv_id bigint, "
    "n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, words bigint, "
    "ends string, shard bigint, piece bigint"
)
_EMPTY = hashlib.sha256(b"").hexdigest()


def conversation_paths(turns: DataFrame) -> DataFrame:
    """conv_id and steps: an array of (hash, words) in turn order, one row per conversation."""
    role, text = text_or_empty(turns["role"]), text_or_empty(turns["text"])
    # The length keeps role and text apart.
    said = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    rows = turns.where(turns["conv_id"].isNotNull()).select(
        turns["conv_id"].cast("bigint").alias("conv_id"),
        F.struct(
            turns["turn"].isNotNull().alias("numbered"),
            F.coalesce(turns["turn"].cast("bigint"), F.lit(0)).alias("turn"),
            F.substring(F.sha2(said.cast("binary"), 256), 1, 2 * STEP).alias("hash"),
            F.size(words_of(text)).alias("words"),
        ).alias("step"),
    )
    listed = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("step")).alias("steps"))
    return listed.select(
        "conv_id", F.transform("steps", lambda s: F.struct(s["hash"].alias("hash"), s["words"].alias("words"))).alias("steps")
    )


def rebuilt(paths: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """Conversation c with the first crc32(c) % `most` turns of conversation c - c % `every`."""
    own = paths.select(
        "conv_id",
        "steps",
        (F.col("conv_id") - F.col("conv_id") % every).alias("template"),
        (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int").alias("h"),
    )
    heads = paths.where(F.col("conv_id") % every == 0).select(
        F.col("conv_id").alias("template"), F.slice("steps", 1, most).alias("head")
    )
    none = F.slice("steps", 1, 0)
    joined = own.join(heads, "template", "left")
    first = F.slice(F.coalesce("head", none), F.lit(1), F.col("h"))
    rest = F.slice("steps", F.col("h") + 1, F.greatest(F.size("steps") - F.col("h"), F.lit(0)))
    return joined.select("conv_id", F.concat(first, rest).alias("steps"))


def common_turns(a: bytes, b: bytes) -> int:
    """Turns that two paths have in common at their start."""
    low, high = 0, min(len(a), len(b)) // STEP
    while low < high:
        half = (low + high + 1) // 2
        if a[low * STEP : half * STEP] == b[low * STEP : half * STEP]:
            low = half
        else:
            high = half - 1
    return low


class Skeleton:
    """The trie of the splitter paths, as their sorted list."""

    def __init__(self, splitters: list[bytes]):
        self.paths = sorted(set(splitters))

    def depth(self, path: bytes) -> int:
        """How many turns of `path` the trie holds."""
        at = bisect_left(self.paths, path)
        return max((common_turns(path, p) for p in self.paths[max(0, at - 1) : at + 1]), default=0)


@dataclass(slots=True)
class Node:
    """An open node; for a skeleton node the sums are those of one shard."""

    depth: int
    words: int
    key: bytes | None = None  # of skeleton nodes only
    least: int | None = None
    n_convs: int = 0
    n_children: int = 0  # besides those on the skeleton
    n_leaves: int = 0
    saved: int = 0
    ends: object = None  # a hasher, or the ids of a skeleton node not yet given
    pieces: int = 0
    waiting: list = field(default_factory=list)  # finished children that need this node's least id


class Shard:
    """Walks the sorted paths of one shard; rows of _OUT gather in `rows`."""

    def __init__(self, skeleton: Skeleton, number: int):
        self.skeleton, self.number = skeleton, number
        self.rows: list[tuple] = []
        self.open: list[Node] = [Node(0, 0, bytes(STEP))]
        self.path = b""

    def add(self, conv_id: int, path: bytes, words: list[int]) -> None:
        if path != self.path:
            shared = common_turns(path, self.path)
            while len(self.open) > shared + 1:
                self.close()
            on = self.skeleton.depth(path)
            for depth in range(shared + 1, len(path) // STEP + 1):
                key = None
                if depth <= on:
                    step = path[(depth - 1) * STEP : depth * STEP]
                    key = hashlib.sha256(self.open[-1].key + step).digest()[:STEP]
                self.open.append(Node(depth, words[depth - 1], key))
            self.path = path
        node = self.open[-1]
        node.n_convs += 1
        node.least = conv_id if node.least is None else min(node.least, conv_id)
        if node.key is None:
            if node.ends is None:
                node.ends = hashlib.sha256(str(conv_id).encode())
            else:
                node.ends.update(b",%d" % conv_id)
        else:
            node.ends = node.ends or []
            node.ends.append(conv_id)
            if len(node.ends) * 20 >= PIECE:
                self._give_ids(node)

    def _give_ids(self, node: Node) -> None:
        text = ",".join(map(str, node.ends))
        self.rows.append((2, node.key, *[None] * 9, text, self.number, node.pieces))
        node.ends, node.pieces = [], node.pieces + 1

    def close(self) -> None:
        """The deepest open node is complete in this shard."""
        node = self.open.pop()
        parent = self.open[-1] if self.open else None
        if node.key is not None:
            if node.ends:
                self._give_ids(node)
            saved = node.saved + node.n_convs * node.words
            row = (node.n_convs, node.n_children, node.n_leaves, saved, node.words, None, None, None)
            if node.n_convs:
                up = parent.key if parent else None
                self.rows.append((1, node.key, up, node.least, node.depth, None, *row))
            leaves = node.n_leaves
        else:
            for child in node.waiting:
                self.rows.append((0, None, None, *child[:2], node.least, *child[2:]))
            leaves = node.n_leaves if node.n_children else 1
            saved = node.saved + (node.n_convs - 1) * node.words
            digest = node.ends.hexdigest() if node.ends is not None else _EMPTY
            sums = (node.n_convs, node.n_children, leaves, saved, node.words, digest, None, None)
            if parent.key is not None:
                self.rows.append((0, None, parent.key, node.least, node.depth, None, *sums))
            else:
                parent.waiting.append((node.least, node.depth, *sums))
            parent.n_children += 1
        if parent is not None and node.n_convs:
            parent.n_convs += node.n_convs
            parent.n_leaves += leaves
            parent.saved += saved
            parent.least = node.least if parent.least is None else min(parent.least, node.least)

    def take(self, least: int) -> Iterator[pa.RecordBatch]:
        """Batches of rows, once there are `least`."""
        if len(self.rows) >= max(1, least):
            columns = [pa.array(c, f.type) for c, f in zip(zip(*self.rows), _OUT)]
            self.rows = []
            yield pa.RecordBatch.from_arrays(columns, schema=_OUT)


def sorted_shards(conversations: DataFrame) -> DataFrame:
    """conv_id, path and words, range-partitioned and sorted by path and id."""
    path = F.unhex(F.array_join(F.transform("steps", lambda s: s["hash"]), ""))
    rows = stored(
        conversations.select("conv_id", path.alias("path"), F.transform("steps", lambda s: s["words"]).alias("words"))
    )
    return stored(rows.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id"))


def splitter_paths(shards: DataFrame) -> list[bytes]:
    """What the last path of a shard and the first of the next have in common; one row per shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None
        for batch in batches:
            if len(batch):
                first = batch.column(0)[0] if first is None else first
                last = pa.array([batch.column(0)[len(batch) - 1].as_py()], pa.binary())
        if first is not None:
            number = pa.array([TaskContext.get().partitionId()], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [number, pa.array([first.as_py()], pa.binary()), last], names=["shard", "first", "last"]
            )

    ends = shards.select("path").mapInArrow(run, "shard bigint, first binary, last binary").collect()
    ends.sort(key=lambda r: r["shard"])
    return [
        bytes(b["first"])[: STEP * common_turns(bytes(a["last"]), bytes(b["first"]))]
        for a, b in zip(ends, ends[1:])
    ]


def walk(shards: DataFrame, splitters: list[bytes]) -> DataFrame:
    """Finished nodes, partial skeleton nodes and the ids that end at them, of all shards."""
    sent = shards.sparkSession.sparkContext.broadcast(splitters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = Shard(Skeleton(sent.value), TaskContext.get().partitionId())
        for batch in batches:
            for conv_id, path, words in zip(*(c.to_pylist() for c in batch.columns)):
                shard.add(conv_id, path, words)
                yield from shard.take(ROWS)
        while shard.open:
            shard.close()
        yield from shard.take(1)

    return shards.select("conv_id", "path", "words").mapInArrow(run, _OUT_DDL)


def finish_skeleton(partial: DataFrame) -> DataFrame:
    """Skeleton nodes with their parents' ids; one row per node reaches the driver."""
    sums = ("n_convs", "n_children", "n_leaves", "saved_tokens")
    rows = (
        partial.groupBy("key")
        .agg(
            F.first("parent_key").alias("parent_key"),
            F.first("depth").alias("depth"),
            F.first("words").alias("words"),
            F.min("conv_id").alias("conv_id"),
            *(F.sum(c).alias(c) for c in sums),
        )
        .collect()
    )
    # `on`, `leaves` and `less`: children, leaves and words of the skeleton below; they count once, not per shard.
    nodes = {bytes(r["key"]): r.asDict() | {"on": 0, "leaves": 0, "less": r["words"]} for r in rows}
    for node in sorted(nodes.values(), key=lambda n: -n["depth"]):
        node["n_children"] += node["on"]
        node["leaves"] += node["n_children"] == 0
        node["n_leaves"] += node["leaves"]
        node["saved_tokens"] -= node["less"]
        node["parent_conv_id"] = None
        if node["parent_key"] is not None:
            up = nodes[bytes(node["parent_key"])]
            node["parent_conv_id"] = up["conv_id"]
            up["on"] += 1
            up["leaves"] += node["leaves"]
            up["less"] += node["less"]
    columns = ("key", "conv_id", "depth", "parent_conv_id", *sums)
    return partial.sparkSession.createDataFrame(
        [tuple(n[c] for c in columns) for n in nodes.values()],
        "key binary, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, "
        "n_children bigint, n_leaves bigint, saved_tokens bigint",
    )


def hashed_ids(pieces: DataFrame) -> DataFrame:
    """key and ends_sha256 of the skeleton nodes at which conversations end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None
        for batch in batches:
            for own, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if own == key:
                    digest.update(b"," + text.encode())
                    continue
                if key is not None:
                    yield pa.RecordBatch.from_pydict({"key": [key], "ends_sha256": [digest.hexdigest()]})
                key, digest = own, hashlib.sha256(text.encode())
        if key is not None:
            yield pa.RecordBatch.from_pydict({"key": [key], "ends_sha256": [digest.hexdigest()]})

    ordered = pieces.select("key", "ends", "shard", "piece").repartition("key")
    ordered = ordered.sortWithinPartitions("key", "shard", "piece").select("key", "ends")
    return ordered.mapInArrow(run, "key binary, ends_sha256 string")


def trie_nodes(conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of `conversations` (conv_id, steps); columns as in NODES."""
    shards = sorted_shards(conversations)
    out = stored(walk(shards, splitter_paths(shards)))
    skeleton = stored(finish_skeleton(out.where("kind = 1")))
    ends = hashed_ids(out.where("kind = 2"))
    parents = skeleton.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("of_parent"))
    columns = [part.split()[0] for part in NODES.split(", ")]
    above = skeleton.join(ends, "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_EMPTY)))
    below = (
        out.where("kind = 0")
        .join(small_side(parents), "parent_key", "left")
        .withColumn("parent_conv_id", F.coalesce("parent_conv_id", "of_parent"))
        .withColumnRenamed("ends", "ends_sha256")
    )
    return below.select(*columns).unionByName(above.select(*columns))


def prefix_trie(turns: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """The trie of all conversations, each rebuilt on the first turns of its template."""
    return trie_nodes(rebuilt(conversation_paths(turns), every, most))


def trie_sql(every: int = 20, most: int = 4) -> str:
    """The same rows by grouping all prefixes; the CRC is that of the decimal id, bit by bit."""
    return rf"""
    WITH turns AS (
      SELECT conv_id, turn, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words,
             sha256(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS hash
      FROM conversations WHERE conv_id IS NOT NULL),
    paths AS (
      SELECT conv_id, list({{'hash': hash, 'words': words}} ORDER BY turn NULLS FIRST, hash) AS steps
      FROM turns GROUP BY conv_id),
    drawn AS (
      SELECT conv_id, steps, xor(4294967295, list_reduce(
               list_concat([4294967295::BIGINT], flatten(list_transform(
                 string_split(conv_id::VARCHAR, ''),
                 lambda c: list_transform(range(0, 8), lambda b: (ascii(c)::BIGINT >> b) & 1)))),
               lambda s, b: xor(s >> 1, CASE WHEN xor(s, b) & 1 = 1 THEN 3988292384 ELSE 0 END))) % {most} AS h
      FROM paths),
    rebuilt AS (
      SELECT d.conv_id, list_concat(coalesce(t.steps, d.steps[1:0])[1:h], d.steps[h + 1:]) AS steps
      FROM drawn d LEFT JOIN paths t ON t.conv_id = d.conv_id - d.conv_id % {every}),
    prefixes AS (
      SELECT conv_id, d, len(steps) AS n,
             sha256(array_to_string(list_transform(steps[1:d], lambda s: s.hash), '')) AS k,
             CASE WHEN d > 0 THEN
               sha256(array_to_string(list_transform(steps[1:d - 1], lambda s: s.hash), '')) END AS up,
             CASE WHEN d > 0 THEN steps[d].words ELSE 0 END AS w
      FROM (SELECT conv_id, steps, unnest(range(0, len(steps) + 1)) AS d FROM rebuilt)),
    nodes AS (
      SELECT k, d, any_value(up) AS up, any_value(w) AS w, min(conv_id) AS conv_id, count(*) AS n_convs,
             sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE n = d), ''))
               AS ends_sha256
      FROM prefixes GROUP BY k, d),
    kids AS (SELECT up AS k, count(*) AS n FROM nodes WHERE up IS NOT NULL GROUP BY up),
    below AS (
      SELECT a.k, sum((x.n_convs - 1) * x.w) AS saved, count(*) FILTER (WHERE kids.n IS NULL) AS leaves
      FROM nodes x JOIN prefixes a ON a.conv_id = x.conv_id AND a.d <= x.d LEFT JOIN kids ON kids.k = x.k
      GROUP BY a.k)
    SELECT nodes.conv_id, nodes.d AS depth, p.conv_id AS parent_conv_id, nodes.n_convs,
           coalesce(kids.n, 0) AS n_children, below.leaves AS n_leaves,
           below.saved::BIGINT AS saved_tokens, nodes.ends_sha256
    FROM nodes JOIN below USING (k) LEFT JOIN kids USING (k) LEFT JOIN nodes p ON p.k = nodes.up
    """
