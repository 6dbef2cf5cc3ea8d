"""SimHash near-duplicates by a byte-position inverted index with count filtering.

Two 64-bit fingerprints that differ in at most `d` bits share at least 8 - d of
their 8 positional bytes. The index posts every distinct fingerprint under combinations
of positional bytes chosen so that any two with that many common bytes meet under at least
one (`halves`). Where two meet, the bytes they share by position are tallied; pairs that
reach the guaranteed minimum are verified by counting the bits that differ.

Similarities of 0.8 need a wider radius than any byte count of 64 bits guarantees. For them a
fingerprint of 256 bits is posted under `design` triples of its 32 bytes; a Jaccard
similarity of 0.8 leaves 39 of 256 bits different on average. There the index only
proposes pairs, and every pair is verified by the exact Jaccard similarity of its sets of shingles.
Pairs that the index misses are found by a prefix-filter join (`prefix_pairs`): two sets
similar to 0.8 share a shingle among the first fifth of both, in any order common to all. Frequent
shingles come last in that order. Where a list of sets with a common shingle is long, its pairs are
also held against sketches of the sets (`sketch`), which rule out pairs but no similar one, and of the pairs
left the list proposes those of a spanning forest first; the others only where links of the forest fail.

Equal fingerprints are folded before the index, so copies cost nothing there. A
posting list beyond `LIST` is cut into chunks and every pair of chunks becomes a group of rows of
its own, so a hot list spreads over tasks. A group of rows emits only the links
of a spanning forest: at most one per fingerprint, never all pairs, and the
components are the same.

Defined edge cases: null text counts as empty; a text without words has fingerprint zero and
is linked like any other; a null id takes part but never names a component unless all
its ids are null; repeated rows share a component; an empty table gives an empty
result; other columns are ignored. A very long text is hashed whole, in memory of its task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimgrove.llm.common import lower_ascii, stored, text_or_empty
from claimgrove.llm.components import components
from claimgrove.llm.tokens import as_string, frugal, slices, split_words
from claimgrove.session import small_side

# Rows of one posting list that a task compares at once.
LIST = 1024
# Lists up to this length are compared together, without a loop over lists.
SHORT = 32
# Lanes of 64 bits, posted triples and differing bits for a Jaccard similarity of 0.8: the mean
# number of bits that differ, 256 * acos(2 * 0.8 / 1.8) / pi, and one standard deviation.
WIDE_LANES, WIDE_KEYS, WIDE_BITS = 4, 30, 44
# One set in so many is counted for frequent shingles; how often these occur there, and how many
# are kept. They steer the work of the exact join, not its result.
SAMPLED, OFTEN, FREQUENT = 8, 3, 200_000
# Bits of the sketch of a set, and the length up to which a list of the prefix join goes without: such a list
# has at most (FEW - 1) / 2 pairs per posting.
SKETCH, FEW = 2048, 8
# Tasks over which the postings of a shingle are dealt that the sample shows to be in many sets.
SPREAD = 64

_LANES = np.array([0, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


def _lanes(hashes: np.ndarray, lanes: int) -> np.ndarray:
    """The hashes, and beside them `lanes` - 1 mixed ones."""
    columns = [hashes]
    for salt in _LANES[1:lanes]:
        x = (hashes ^ salt) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xC4CEB9FE1A85EC53)
        columns.append(x ^ (x >> np.uint64(29)))
    return np.stack(columns, axis=1)


def shingle_hashes(words: list[str], width: int) -> np.ndarray:
    """64-bit hashes of the shingles of `words`, repeats included."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        shingles = [" ".join(words)] if words else []
    else:
        shingles = [" ".join(s) for s in zip(*(words[i:] for i in range(width)))]
    return np.array([digest(s, 42) for s in shingles], dtype=np.uint64)


def fingerprint(hashes: np.ndarray, lanes: int = 1) -> bytes:
    """SimHash of hashed shingles, repeats included; the least byte first."""
    if not len(hashes):
        return bytes(8 * lanes)
    ones = np.zeros(64 * lanes, dtype=np.int64)
    for first in range(0, len(hashes), 255 * 64):
        part = _lanes(hashes[first : first + 255 * 64], lanes)
        bits = np.unpackbits(part.view(np.uint8).reshape(len(part), -1), axis=1, bitorder="little")
        for row in range(0, len(bits), 255):  # sums of 255 bits fit a byte
            ones += np.add.reduce(bits[row : row + 255], axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(hashes), bitorder="little").tobytes()


def fingerprints(
    docs: DataFrame, width: int, lanes: int = 1, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, row_no, text_key (xxhash64 of the text) and print (bytes) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, values = as_string(batch.column(3)), []
            for first, last in slices(texts):
                offsets, words = split_words(texts.slice(first, last - first))
                words = words.to_pylist()
                values += [
                    fingerprint(shingle_hashes(words[a:b], width), lanes)
                    for a, b in zip(offsets[:-1], offsets[1:])
                ]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(values, pa.binary())],
                names=["doc_id", "row_no", "text_key", "print"],
            )

    return _read(docs, id_col, text_col).mapInArrow(
        frugal(run), "doc_id bigint, row_no bigint, text_key bigint, print binary"
    )


def _read(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = text_or_empty(docs[text_col])
    return docs.select(
        docs[id_col].cast("bigint").alias("doc_id"),
        F.monotonically_increasing_id().alias("row_no"),
        F.xxhash64(text).alias("text_key"),
        lower_ascii(text).alias("text"),
    )


def shingle_rows(
    docs: DataFrame, width: int, lanes: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """`fingerprints`, with `node`, a hash of the set of shingles, and `sketch` of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, hashes in _hashed(batch.column(3), width):
                sets = [np.unique(h) for h in hashes]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(c.slice(first, last - first) for c in batch.columns[:3]),
                        pa.array([fingerprint(h, lanes) for h in hashes], pa.binary()),
                        pa.array([_node(s.tobytes()) for s in sets], pa.int64()),
                        pa.array([sketch(s) for s in sets], pa.binary()),
                    ],
                    names=["doc_id", "row_no", "text_key", "print", "node", "sketch"],
                )

    schema = "doc_id bigint, row_no bigint, text_key bigint, print binary, node bigint, sketch binary"
    return _read(docs, id_col, text_col).mapInArrow(frugal(run), schema)


def over_sets(
    texts: DataFrame, width: int, emit: Callable[[np.ndarray, list[np.ndarray]], pa.RecordBatch], schema: str
) -> DataFrame:
    """What `emit` makes of the nodes and shingle sets (distinct hashes in order) of texts (column `text`, lower case).

    Sets take more room than their texts, so they are made where they are used and not kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, hashes in _hashed(batch.column(0), width):
                sets = [np.unique(h) for h in hashes]
                yield emit(np.array([_node(s.tobytes()) for s in sets], dtype=np.int64), sets)

    return texts.select("text").mapInArrow(frugal(run), schema)


def shingle_sets(texts: DataFrame, width: int) -> DataFrame:
    """node and shingles (8 bytes each) of lower-cased texts."""

    def whole(nodes: np.ndarray, sets: list[np.ndarray]) -> pa.RecordBatch:
        values = pa.array([s.tobytes() for s in sets], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(nodes), values], names=["node", "shingles"])

    return over_sets(texts, width, whole, "node bigint, shingles binary")


def _hashed(column: pa.Array, width: int) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """Row ranges of a column of texts with the shingle hashes of each row."""
    texts = as_string(column)
    for first, last in slices(texts):
        offsets, words = split_words(texts.slice(first, last - first))
        words = words.to_pylist()
        yield first, last, [shingle_hashes(words[a:b], width) for a, b in zip(offsets[:-1], offsets[1:])]


def _node(shingles: bytes) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(shingles)).view(np.int64))


def sketch(shingles: np.ndarray) -> bytes:
    """Whether an odd number of the shingles falls into each of `SKETCH` classes.

    A shingle that only one of two sets holds changes one bit, so sets differ in at least as many shingles as
    their sketches in bits.
    """
    classes = (shingles & np.uint64(SKETCH - 1)).astype(np.int64)
    return np.packbits((np.bincount(classes, minlength=SKETCH) & 1).astype(np.uint8)).tobytes()


def halves(common: int) -> list[tuple[int, ...]]:
    """Combinations of byte positions of which any `common` of 8 positions contain one.

    The positions fall into two halves; of `common` positions one half holds at least
    ceil(common / 2), so all combinations of that size within a half suffice.
    """
    size = -(-common // 2)
    return [c for half in (range(4), range(4, 8)) for c in combinations(half, size)]


def design(positions: int, keys: int) -> list[tuple[int, ...]]:
    """`keys` triples of positions, no two of which share more than one position.

    So they meet as independently as triples can; they are taken in the order of a fixed shuffle.
    """
    every = list(combinations(range(positions), 3))
    np.random.default_rng(1).shuffle(every)
    chosen: list[tuple[int, ...]] = []
    used: set[tuple[int, int]] = set()
    for triple in map(tuple, every):
        pairs = set(combinations(sorted(map(int, triple)), 2))
        if len(chosen) < keys and not pairs & used:
            chosen.append(triple)
            used |= pairs
    return chosen


def _forest(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, int]]:
    """Links of a spanning forest of the given links."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        p, q = find(x), find(y)
        if p != q:
            root[max(p, q)] = min(p, q)
            yield x, y


def _meet(x: np.ndarray, y: np.ndarray, common: int, bits: int) -> np.ndarray:
    """Mask of pairs that share enough positional bytes and then differ in few bits.

    Fingerprints are rows of bytes, compared along the last axis.
    """
    differ = x ^ y
    kept = (differ == 0).sum(-1) >= common
    kept[kept] = np.bitwise_count(differ[kept]).sum(-1, dtype=np.int64) <= bits
    return kept


def links(nodes: DataFrame, keys: list[tuple[int, ...]], common: int, bits: int) -> DataFrame:
    """a, b: links that join all nodes (columns `node`, `print`) that the index finds within `bits`."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            prints = _bytes(batch.column(1)).astype(np.int64)
            lists = []
            for i, positions in enumerate(keys):
                key = np.zeros(len(prints), dtype=np.int64)
                for p in positions:
                    key = key << 8 | prints[:, p]
                lists.append(key << 8 | i)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(lists)), pa.array(np.tile(batch.column(0).to_numpy(), len(keys)))],
                names=["key", "node"],
            )

    posted = nodes.select("node", "print").mapInArrow(frugal(post), "key bigint, node bigint")
    return _in_lists(
        posted.withColumn("mark", F.lit(0).cast("bigint")),
        lambda listed: listed.join(nodes.select("node", F.col("print").alias("value")), "node"),
        lambda rows, prints, i, j: _meet(prints[i], prints[j], common, bits),
        "task",
    ).select("a", "b").distinct()


def _in_lists(
    posted: DataFrame,
    attach: Callable[[DataFrame], DataFrame],
    meet: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray],
    forest: str,
    apart: str = "node",
    size: int = 0,
) -> DataFrame:
    """key, a, b: nodes that `meet` under a key of `posted` (key, node, mark); `attach` adds their `value`.

    Lists in which all have the same `apart` are left out. Values are padded to `size` bytes. For `forest` "task" a
    spanning forest of what a task compares is given, for "pair" all pairs. For "list" it is a forest
    of each group of over `SHORT` rows, with its key, and all pairs of other groups; elsewhere the key is null.
    """
    lists = (
        posted.groupBy("key")
        .agg(F.count("*").alias("n"), F.min(apart).alias("first"), F.max(apart).alias("last"))
        .where("first < last")
        .select("key", "n")
    )
    # Chunk of the node within its list, and all pairs of chunks that contain this one.
    chunks = F.ceil(F.col("n") / LIST).cast("int")
    listed = posted.join(lists, "key").withColumn("chunks", chunks)
    own = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    paired = (
        listed.withColumn("own", own)
        .select(*posted.columns, "n", "own", every.alias("other"))
    )
    paired = attach(paired).select(
        "key",
        F.least("own", "other").alias("low"),
        F.greatest("own", "other").alias("high"),
        "own",
        "node",
        "mark",
        "value",
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None  # rows of the group that may go on in the next batch
        for batch in batches:
            if not len(batch):
                continue
            rows = np.stack([c.to_numpy().astype(np.int64) for c in batch.columns[:6]], 1)
            values = _bytes(batch.column(6), size)
            if rest is not None:
                rows, values = np.concatenate([rest[0], rows]), np.concatenate([rest[1], values])
            begins = np.flatnonzero((rows[1:, :3] != rows[:-1, :3]).any(1))
            last = begins[-1] + 1 if len(begins) else 0
            rest = rows[last:], values[last:]
            if last:
                yield from _compare(rows[:last], values[:last], meet, forest)
        if rest is not None:
            yield from _compare(*rest, meet, forest)

    # By node too, so that lists with the same nodes give the same forest.
    sorted_rows = paired.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "node")
    return sorted_rows.mapInArrow(frugal(run), "key bigint, a bigint, b bigint")


def _bytes(column: pa.Array, size: int = 0) -> np.ndarray:
    """A row of bytes per value, all of one length; shorter ones than `size` end in zeros."""
    values = column.to_pylist()
    return np.frombuffer(b"".join(v.ljust(size, b"\0") for v in values), dtype=np.uint8).reshape(len(values), -1)


def _compare(rows: np.ndarray, values: np.ndarray, meet, forest: str) -> Iterator[pa.RecordBatch]:
    """Links within whole groups of rows (key, low, high, own, node, mark), sorted by group."""
    begins = np.concatenate(([0], np.flatnonzero((rows[1:, :3] != rows[:-1, :3]).any(1)) + 1))
    sizes = np.diff(np.append(begins, len(rows)))
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def taken(key: int | None, spanning: bool) -> pa.RecordBatch:
        a, b = (rows[np.concatenate([f[side] for f in found] or [np.zeros(0, int)]), 4] for side in (0, 1))
        found.clear()
        if spanning:
            kept = np.array(list(_forest(a, b)), dtype=np.int64).reshape(-1, 2)
        else:
            kept = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
            kept = kept[kept[:, 0] != kept[:, 1]]
        columns = [pa.array([key] * len(kept), pa.int64()), *(pa.array(kept[:, side]) for side in (0, 1))]
        return pa.RecordBatch.from_arrays(columns, names=["key", "a", "b"])

    # Short lists: all rows against the row `lag` places further in the same group.
    group = np.repeat(np.arange(len(begins)), sizes)
    short = np.flatnonzero(sizes[group] <= SHORT)
    for lag in range(1, SHORT):
        first, second = short[:-lag], short[lag:]
        same = group[first] == group[second]
        if not same.any():
            break
        first, second = first[same], second[same]
        met = meet(rows, values, first, second)
        found.append((first[met], second[met]))
    if forest != "task":
        yield taken(None, False)
    for k in np.flatnonzero(sizes > SHORT):
        index = np.arange(begins[k], begins[k] + sizes[k])
        low, high = rows[begins[k], 1:3]
        left, right = index[rows[index, 3] == low], index[rows[index, 3] == high]
        for part in np.array_split(left, 1 + len(left) // 64):
            i, j = np.nonzero(meet(rows, values, part[:, None], right[None, :]))
            kept = part[i] != right[j]
            found.append((part[i][kept], right[j][kept]))
        if forest != "task":
            yield taken(int(rows[begins[k], 0]) if forest == "list" else None, forest == "list")
    if forest == "task":
        yield taken(None, True)


def _grouped(
    rows: DataFrame, keys: list[tuple[int, ...]], common: int, bits: int
) -> DataFrame:
    """`rows` (of `fingerprints`) with component_id, the least id reachable, and a label of the component."""
    nodes = stored(
        rows.groupBy("print").agg(F.min("row_no").alias("node"), F.min("doc_id").alias("least_id"))
    )
    joined = components(links(nodes, keys, common, bits)).withColumnRenamed("node", "member")
    members = nodes.join(joined, F.col("node") == F.col("member"), "left").select(
        "print", "least_id", F.coalesce("label", "node").alias("label")
    )
    named = members.groupBy("label").agg(F.min("least_id").alias("component_id"))
    return rows.join(members.join(named, "label").select("print", "label", "component_id"), "print")


def _reversed(name: str) -> Column:
    """The 8 bytes of a fingerprint, the greatest first."""
    return F.concat(*(F.substring(F.col(name), i, 1) for i in range(8, 0, -1)))


def near_groups(
    docs: DataFrame, width: int = 3, bits: int = 3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (least id reachable) of every row.

    Fingerprints of 64 bits link at `bits` or fewer differing bits; the index finds all links.
    """
    common = 8 - bits
    if common < 2:
        raise ValueError("too few common bytes for an index")
    rows = stored(fingerprints(docs, width, 1, id_col, text_col))
    return _grouped(rows, halves(common), common, bits).select(
        "doc_id", F.lower(F.hex(_reversed("print"))).alias("fingerprint"), "component_id"
    )


def similar(texts: DataFrame, width: int, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The rows of `pairs` (a, b) whose sets of shingles have a Jaccard similarity of 0.8 or more.

    `nodes` (node, text_key) name a text of each set, `texts` (text_key, text) hold it. The sets of the
    paired nodes alone are made anew; each is moved once by its node, and with its pairs.
    """
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = stored(nodes.join(wanted, "node", "left_semi").select("node", "text_key"))
    keys = small_side(wanted.select("text_key").distinct(), max_rows=1_000_000)
    chosen = texts.join(keys, "text_key", "left_semi").dropDuplicates(["text_key"])
    needed = shingle_sets(chosen, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
                common = len(np.intersect1d(x, y, assume_unique=True))
                kept.append(9 * common >= 4 * (len(x) + len(y)))
            yield batch.select([0, 1]).filter(pa.array(kept, pa.bool_()))

    left = needed.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    right = needed.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    # Where the pairs are few they go to the sets, and only what is paired moves.
    found = left.join(small_side(pairs, max_rows=1_000_000), "a").join(right, "b").select("a", "b", "x", "y")
    return found.mapInArrow(frugal(run), "a bigint, b bigint").distinct()


def frequent_shingles(texts: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of shingles that a sample of the texts holds often, the rarest first, and their counts.

    They only make the order of `prefix_pairs` a better one; any choice gives the same pairs. Of the
    counts the driver sees a histogram, and then only the shingles above the count that leaves
    at most `FREQUENT`.
    """

    def spell(nodes: np.ndarray, sets: list[np.ndarray]) -> pa.RecordBatch:
        keys = np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(keys)], names=["key"])

    sample = texts.where(F.pmod("text_key", F.lit(SAMPLED)) == 0)
    counted = over_sets(sample, width, spell, "key bigint").groupBy("key").agg(F.count("*").alias("n"))
    often = stored(counted.where(F.col("n") >= OFTEN))
    least, held = None, 0
    for row in sorted(often.groupBy("n").agg(F.count("*").alias("keys")).collect(), key=lambda r: -r["n"]):
        held += row["keys"]
        if held > FREQUENT:
            break
        least = row["n"]
    if least is None:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    kept = often.where(F.col("n") >= least).toPandas().sort_values(["n", "key"])
    return kept["key"].to_numpy(dtype=np.int64).view(np.uint64), kept["n"].to_numpy(dtype=np.int64)


def prefix(shingles: np.ndarray, frequent: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The shingles of which two sets similar to 0.8 share one, in the common order.

    `shingles` are sorted; `frequent` too, with `ranks` as their place in the order's end.
    """
    size = len(shingles) - -(-4 * len(shingles) // 5) + 1 if len(shingles) else 0
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, shingles), len(frequent) - 1)
        often = frequent[at] == shingles
        rare = shingles[~often]
        if len(rare) < size:
            return np.concatenate([rare, shingles[often][np.argsort(ranks[at[often]])]])[:size]
        return rare[:size]
    return shingles[:size]


def _meet_prefix(rows: np.ndarray, values: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Mask of pairs in different components whose sizes, places and sketches leave room for 0.8.

    `mark` of a row is the size of its set and the place of the key in its order. Where the key is
    the first that both have, no more than the shorter rest can be common besides. A value is the
    label of the component (8 bytes) and the sketch; sets similar to 0.8 differ in a ninth of both sizes at most.
    """
    parts = values.view(np.uint64)
    size, place = rows[:, 5] >> 32, rows[:, 5] & 0xFFFFFFFF
    rest, label = size - place, parts[:, 0]
    kept = (label[i] != label[j]) & (9 * np.minimum(rest[i], rest[j]) >= 4 * (size[i] + size[j]))
    at = np.nonzero(kept)
    i, j = (np.broadcast_to(x, kept.shape)[at] for x in (i, j))
    near = np.zeros(len(i), dtype=bool)
    for first in range(0, len(i), 1 << 13):
        x, y = i[first : first + (1 << 13)], j[first : first + (1 << 13)]
        differ = np.bitwise_count(parts[x, 1:] ^ parts[y, 1:]).sum(1, dtype=np.int64)
        near[first : first + len(x)] = 9 * differ <= size[x] + size[y]
    kept[at] = near
    return kept


def prefix_postings(texts: DataFrame, width: int) -> DataFrame:
    """key, node, mark: what the prefixes of all sets post, save keys that only one set holds.

    Postings are exchanged once by their shingle; what only one set holds proposes nothing and goes no
    further. Shingles that the sample shows to be in many sets are dealt over `SPREAD` tasks and all kept.
    """
    order, counts = frequent_shingles(texts, width)
    ranks = np.argsort(order)  # place in the order, by hash
    hot = np.sort(order[counts * SAMPLED >= LIST])
    sent = texts.sparkSession.sparkContext.broadcast((order[ranks], ranks, hot))

    def post(nodes: np.ndarray, sets: list[np.ndarray]) -> pa.RecordBatch:
        frequent, places, everywhere = sent.value
        keys = [prefix(own, frequent, places) for own in sets]
        sizes = [len(k) for k in keys]
        marks = [(len(own) << 32) + np.arange(n) for own, n in zip(sets, sizes)]
        key = np.concatenate([np.zeros(0, np.uint64), *keys])
        node = np.repeat(nodes, sizes)
        deal = np.where(np.isin(key, everywhere), 1 + node % SPREAD, 0).astype(np.int16)
        mark = np.concatenate([np.zeros(0, np.int64), *marks])
        return pa.RecordBatch.from_arrays(
            [pa.array(c) for c in (key.view(np.int64), node, mark, deal)], names=["key", "node", "mark", "deal"]
        )

    posted = over_sets(texts, width, post, "key bigint, node bigint, mark bigint, deal smallint")
    return stored(_met_twice(posted))


def prefix_pairs(postings: DataFrame, nodes: DataFrame, joined: DataFrame, forest: str) -> DataFrame:
    """key, a, b: pairs of sets that can be similar to 0.8, save those in one component of `joined` (node, label).

    `nodes` (node, sketch) hold the sketches; those of lists up to `FEW` do not travel. `forest` as in `_in_lists`: with
    "pair" these are all pairs that the postings propose.
    """
    labelled = postings.join(joined.select("node", "label"), "node", "left").select(
        "key", "node", "mark", F.coalesce("label", "node").alias("label")
    )
    label = F.unhex(F.lpad(F.hex("label"), 16, "0"))
    value = F.when(F.col("n") > FEW, F.concat(label, F.col("sketch"))).otherwise(label)
    found = _in_lists(
        labelled,
        lambda listed: listed.join(nodes.select("node", "sketch"), "node").withColumn("value", value),
        _meet_prefix,
        forest,
        "label",
        8 + SKETCH // 8,
    )
    return found.distinct()


def _met_twice(posted: DataFrame) -> DataFrame:
    """Distinct postings (key, node, mark) of keys that two nodes have, or that are dealt over tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, before = np.zeros((0, 4), dtype=np.int64), None  # the row held back, the key given last
        for batch in chain(batches, [None]):
            rows = rest
            if batch is not None:
                rows = np.concatenate([rest, np.stack([c.to_numpy().astype(np.int64) for c in batch.columns], 1)])
            if not len(rows):
                continue
            rows = rows[np.append(True, (rows[1:, :2] != rows[:-1, :2]).any(1))]
            key = rows[:, 0]
            same = np.concatenate(([before is not None and key[0] == before], key[1:] == key[:-1], [False]))
            # The last row waits for the next batch.
            last = len(rows) if batch is None else len(rows) - 1
            kept = rows[:last][(same[:-1] | same[1:] | (rows[:, 3] > 0))[:last]]
            rest, before = rows[last:], key[last - 1] if last else before
            yield pa.RecordBatch.from_arrays([pa.array(kept[:, i]) for i in range(3)], names=["key", "node", "mark"])

    dealt = posted.repartition("key", "deal").sortWithinPartitions("key", "node")
    return dealt.select("key", "node", "mark", F.col("deal").cast("bigint")).mapInArrow(
        frugal(run), "key bigint, node bigint, mark bigint"
    )


def similar_components(texts: DataFrame, width: int, rows: DataFrame) -> DataFrame:
    """node, label of the nodes of `rows` (of `shingle_rows`) that links of 0.8 or more join to others.

    First by the links that the fingerprints propose; then all others join their components. `texts`
    (text_key, text) are read again for the sets of shingles. A pair that a forest of `prefix_pairs` leaves out is
    joined by links of that forest. Only where two ends of such a link stay apart all pairs of the list are tried.
    """
    nodes = stored(
        rows.groupBy("node").agg(*(F.min(c).alias(c) for c in ("print", "text_key", "sketch")))
    )
    proposed = stored(links(nodes, design(8 * WIDE_LANES, WIDE_KEYS), 3, WIDE_BITS))
    near = components(similar(texts, width, nodes, proposed))
    postings = prefix_postings(texts, width)
    found = stored(prefix_pairs(postings, nodes, near, "list"))
    near = _widened(near, similar(texts, width, nodes, stored(found.select("a", "b").distinct())))
    of = [near.select(F.col("node").alias(n), F.col("label").alias("of_" + n)) for n in "ab"]
    ends = found.where("key IS NOT NULL").join(of[0], "a", "left").join(of[1], "b", "left")
    failed = stored(ends.where("coalesce(of_a, a) <> coalesce(of_b, b)").select("key").distinct())
    if failed.isEmpty():
        return near
    rest = prefix_pairs(postings.join(failed, "key", "left_semi"), nodes, near, "pair")
    return _widened(near, similar(texts, width, nodes, stored(rest.select("a", "b"))))


def _widened(near: DataFrame, pairs: DataFrame) -> DataFrame:
    """`near` (node, label) with its components joined by the links of `pairs` (a, b)."""
    rest = stored(pairs)
    ends = rest.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    every = near.unionAll(
        ends.join(near, "node", "left_anti").select("node", F.col("node").alias("label"))
    )
    of = [every.select(F.col("node").alias(n), F.col("label").alias("of_" + n)) for n in "ab"]
    between = rest.join(of[0], "a").join(of[1], "b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))
    wider = components(between).select(F.col("node").alias("label"), F.col("label").alias("least"))
    return stored(every.join(wider, "label", "left").select("node", F.coalesce("least", "label").alias("label")))


def drop_near(
    docs: DataFrame, width: int = 5, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """`docs` with one row of each group of texts whose shingles are similar to 0.8 or more.

    The row with the least id stays; of equal ids the first that was read. Null texts count as empty; texts
    without words are alike; a very long text is hashed whole, in memory of its task.
    """
    rows = stored(shingle_rows(docs, width, WIDE_LANES, id_col, text_col))
    texts = _read(docs, id_col, text_col).select("text_key", "text")
    joined = similar_components(texts, width, rows).withColumnRenamed("node", "member")
    members = rows.join(joined, F.col("node") == F.col("member"), "left").withColumn(
        "label", F.coalesce("label", "node")
    )
    named = members.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    grouped = stored(
        members.join(named, "label").select("doc_id", "row_no", "text_key", "label", "component_id")
    )
    first = (
        grouped.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
        .groupBy("label")
        .agg(F.min("row_no").alias("row_no"))
    )
    gone = grouped.join(first, ["label", "row_no"], "left_anti")
    return drop_rows(docs, gone, id_col, text_col)


def drop_rows(docs: DataFrame, gone: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """`docs` without the rows that `gone` names by doc_id and text_key, as often as it names them.

    A row that repeats another in id and text is the same document twice: of such rows as
    many go as are named.
    """
    named = gone.groupBy(F.col("doc_id").alias("id"), F.col("text_key").alias("key")).agg(
        F.count("*").alias("gone")
    )
    # The row travels as one struct, so that its columns may have any names.
    keyed = docs.select(
        F.struct(*docs.columns).alias("row"),
        docs[id_col].cast("bigint").alias("own_id"),
        F.xxhash64(text_or_empty(docs[text_col])).alias("own_key"),
    )
    same = F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_key") == F.col("key"))
    marked = keyed.join(small_side(stored(named)), same, "left")
    kept = marked.where("gone IS NULL").select("row")
    again = Window.partitionBy("own_id", "own_key").orderBy("gone")
    rest = marked.where("gone IS NOT NULL").withColumn("nth", F.row_number().over(again))
    return kept.unionByName(rest.where("nth > gone").select("row")).select("row.*")
