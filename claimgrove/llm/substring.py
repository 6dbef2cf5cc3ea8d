"""Removal of passages that occur more than once, by sharded FM-indexes.

Every window of `window` words has an anchor: its run of `ANCHOR` words with the least hash
(leftmost on ties). Windows of a document that share the anchor's place form a segment, whose
windows all have that anchor and belong to no other segment; equal windows have equal
anchors wherever they occur. So segments are dealt to shards by anchor, and a shard can tell
all repeats of its windows alone.

1. Anchors that occur once in the corpus are dropped by a counting aggregation over 8-byte
   hashes, equal segments are folded into one with a weight.
2. The texts of the folded segments go to the shards. A shard builds a compressed
   FM-index (Burrows-Wheeler transform in a wavelet matrix) over a bounded number of segments and streams
   each through it by backward search; stretches of at least `window` words with a weight
   above one are reported.
3. The stretches return to all documents that hold the segment, and their words are removed.

An anchor with more than `CHUNK` different segments is dealt in pairs of chunks, each with an
index of its own, so no task grows with a hot passage; nothing is dropped.

Words are runs of anything but ASCII white space, unchanged. Windows are judged on the
input. Null text has no words; rows equal in id and text count as two documents and repeat each
other; a null id is an ordinary value; an empty table gives an empty result. Segments are
folded by 128 bits of hash. A very long text is cut into segments where it is read and
put together again whole by one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimgrove.llm.common import stored, text_or_empty
from claimgrove.llm.fm_index import FmIndex
from claimgrove.llm.tokens import as_string, frugal, slices, split_words

# Length of the runs of words that serve as anchors.
ANCHOR = 8
# Different segments of one anchor that one index holds at most, and words of an index.
CHUNK = 2048
INDEX_WORDS = 1 << 18

_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _mix(x: np.ndarray) -> np.ndarray:
    for factor in _MIX:
        x = (x ^ (x >> np.uint64(33))) * factor
    return x ^ (x >> np.uint64(33))


def _powers(base: int, n: int) -> np.ndarray:
    factors = np.full(n, base, dtype=np.uint64)
    factors[:1] = 1
    return np.cumprod(factors)


def word_hashes(words: pa.Array) -> np.ndarray:
    import xxhash

    coded = words.dictionary_encode()
    table = [xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()]
    return np.array(table, dtype=np.uint64)[coded.indices.to_numpy(zero_copy_only=False)]


def _least_places(values: np.ndarray, span: int) -> np.ndarray:
    """Place of the leftmost least value in every run of `span` values, by doubling runs."""
    least, place, size = values, np.arange(len(values)), 1
    while size < span:
        step = min(size, span - size)
        right = least[step:] < least[:-step]
        least = np.where(right, least[step:], least[:-step])
        place = np.where(right, place[step:], place[:-step])
        size += step
    return place


def segments(hashes: np.ndarray, offsets: np.ndarray, window: int) -> list[np.ndarray]:
    """Document, start, number of windows, anchor and digest of every segment."""
    n, span = len(hashes), window - ANCHOR + 1
    lengths = np.diff(offsets)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    valid = np.flatnonzero(owner[: max(0, n - window + 1)] == owner[window - 1 :])
    if not len(valid):
        return [np.zeros(0, dtype=np.int64)] * 5
    grams = np.zeros(n - ANCHOR + 1, dtype=np.uint64)
    for j, power in enumerate(_powers(_BASE, ANCHOR)):
        grams += hashes[j : n - ANCHOR + 1 + j] * power
    grams = _mix(grams)
    anchor = _least_places(grams, span)[valid]
    changed = (anchor[1:] != anchor[:-1]) | (owner[valid[1:]] != owner[valid[:-1]])
    begin = np.flatnonzero(np.concatenate(([True], changed)))
    count = np.diff(np.append(begin, len(valid)))
    start = valid[begin]
    stop = start + count + window - 1
    prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * _powers(_BASE, n))))
    digest = _mix((prefix[stop] - prefix[start]) * _powers(_INVERSE, n)[start])
    doc = owner[start]
    return [doc, start - offsets[doc], count, grams[anchor[begin]].view(np.int64), digest.view(np.int64)]


def _joined(bounds: np.ndarray, words: pa.Array) -> pa.Array:
    """Words between successive bounds, joined by one space."""
    lists = pa.ListArray.from_arrays(bounds.astype(np.int32), words)
    return pc.binary_join(lists, pa.scalar(" ", words.type)).cast(pa.string())


def _segment_rows(rows: DataFrame, window: int, fold: bool) -> DataFrame:
    """id, key, place (start * 64 + windows), anchor, digest of every segment.

    With `fold`, equal segments of a batch become one row of their first holder and a
    column `weight` counts them, so that no hot segment is shuffled row by row.
    """
    names = ["id", "key", "place", "anchor", "digest", *["weight"] * fold]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, found = as_string(batch.column(2)), []
            for first, last in slices(texts):
                offsets, words = split_words(texts.slice(first, last - first))
                doc, start, count, anchor, digest = segments(word_hashes(words), offsets, window)
                found.append((first + doc, start * 64 + count, anchor, digest))
            doc, place, anchor, digest = (np.concatenate(c) for c in zip(*found)) if found else [()] * 4
            weight = []
            if fold and len(doc):
                order = np.lexsort((digest, anchor))
                new = (np.diff(anchor[order]) != 0) | (np.diff(digest[order]) != 0)
                begin = np.flatnonzero(np.concatenate(([True], new)))
                weight = [np.diff(np.append(begin, len(order)))]
                doc, place, anchor, digest = (c[order[begin]] for c in (doc, place, anchor, digest))
            if len(doc):
                holder = pa.array(doc)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(holder),
                        batch.column(1).take(holder),
                        *(pa.array(c, pa.int64()) for c in (place, anchor, digest, *weight)),
                    ],
                    names=names,
                )

    return rows.select("id", "key", "text").mapInArrow(
        frugal(run), ", ".join(f"{name} bigint" for name in names)
    )


def _segment_texts(places: DataFrame, window: int) -> DataFrame:
    """anchor, digest, weight, chunks and words of the segments in `wanted` of each text."""
    names = ["anchor", "digest", "weight", "chunks"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, wanted = as_string(batch.column(0)), batch.column(1)
            for first, last in slices(texts):
                offsets, words = split_words(texts.slice(first, last - first))
                part = wanted.slice(first, last - first)
                fields = part.flatten().flatten()
                place = fields[0].to_numpy(zero_copy_only=False)
                owner = np.repeat(np.arange(len(part)), part.value_lengths().to_numpy(zero_copy_only=False))
                begin = offsets[owner] + place // 64
                length = place % 64 + window - 1
                ends = np.cumsum(length)
                at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - length), length)
                yield pa.RecordBatch.from_arrays(
                    [*fields[1:], _joined(np.append(0, ends), words.take(pa.array(at)))],
                    names=[*names, "words"],
                )

    return places.mapInArrow(
        frugal(run), ", ".join(f"{name} bigint" for name in names) + ", words string"
    )


def _repeated(dealt: DataFrame, window: int) -> DataFrame:
    """anchor, digest, low, high of the stretches found; rows come sorted by anchor and chunk pair."""

    def search(rows: list[tuple]) -> pa.RecordBatch:
        words = pa.array([r[5] for r in rows], pa.large_string())
        offsets, flat = split_words(words)
        codes = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64) + 1
        index = FmIndex(codes, np.diff(offsets), np.array([r[4] for r in rows]))
        found = index.repeats(window)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([rows[i][0] for i, _, _ in found], pa.int64()),
                pa.array([rows[i][3] for i, _, _ in found], pa.int64()),
                pa.array([low for _, low, _ in found], pa.int64()),
                pa.array([high for _, _, high in found], pa.int64()),
            ],
            names=["anchor", "digest", "low", "high"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # An index holds whole groups (anchor, chunk pair), and of one anchor one group only.
        block: list[tuple] = []
        group: list[tuple] = []
        held = 0

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal block, held
            if group and block and (block[-1][0] == group[0][0] or held + _words(group) > INDEX_WORDS):
                yield search(block)
                block, held = [], 0
            block += group
            held += _words(group)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if group and row[:3] != group[0][:3]:
                    yield from close()
                    group = []
                group.append(row)
        yield from close()
        if block:
            yield search(block)

    return dealt.mapInArrow(frugal(run), "anchor bigint, digest bigint, low bigint, high bigint")


def _words(group: list[tuple]) -> int:
    return sum(row[5].count(" ") + 1 for row in group)


def _kept(columns: list[str], spans_at: int, text_at: int, changed_only: bool):
    """Task that removes the spans; the last two columns out count words and removed words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_string(batch.column(text_at))
            for first, last in slices(texts):
                own = texts.slice(first, last - first)
                offsets, words = split_words(own)
                spans = batch.column(spans_at).slice(first, last - first)
                cover = np.zeros(len(words) + 1, dtype=np.int64)
                pairs = spans.flatten().flatten()
                owner = np.repeat(
                    np.arange(len(spans)), pc.fill_null(spans.value_lengths(), 0).to_numpy(False)
                )
                np.add.at(cover, offsets[owner] + pairs[0].to_numpy(False), 1)
                np.add.at(cover, offsets[owner] + pairs[1].to_numpy(False), -1)
                keep = np.cumsum(cover)[:-1] == 0
                before = np.concatenate(([0], np.cumsum(keep)))
                bounds = before[offsets]
                joined = _joined(bounds, words.filter(pa.array(keep)))
                total = np.diff(offsets)
                removed = total - np.diff(bounds)
                if changed_only:
                    as_read = batch.column(text_at).slice(first, last - first)
                    joined = pc.if_else(pa.array(removed == 0), as_read, joined)
                arrays = [c.slice(first, last - first) for c in batch.columns]
                arrays[text_at] = joined
                del arrays[spans_at]
                yield pa.RecordBatch.from_arrays(
                    [*arrays, pa.array(total), pa.array(removed)], names=columns
                )

    return run


def remove_repeats(
    docs: DataFrame,
    window: int = 35,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep_spacing: bool = True,
) -> DataFrame:
    """`docs` without the words of repeated windows, and two columns more: n_words, n_removed.

    Kept words are joined by one space; with `keep_spacing` a text that loses nothing stays
    as it is. Existing columns named n_words or n_removed are replaced.
    """
    if not ANCHOR < window <= 64 + ANCHOR - 2:
        raise ValueError("window must be above the anchor and within 70 words")
    others = [c for c in docs.columns if c not in (text_col, "n_words", "n_removed")]
    rows = docs.select(
        docs[id_col].cast("bigint").alias("id"),
        F.xxhash64(text_or_empty(docs[text_col])).alias("key"),
        docs[text_col].cast("string").alias("text"),
        *(docs[c].alias(f"other{i}") for i, c in enumerate(others)),
    )
    # One exchange by anchor serves the folding and the count of the anchor's segments.
    partial = _segment_rows(rows, window, fold=True).repartition("anchor")
    anchored = Window.partitionBy("anchor")
    folded = (
        partial.groupBy("anchor", "digest")
        .agg(
            F.sum("weight").alias("weight"),
            # Taken from one row together; any holder of the segment has the same words.
            F.first("id").alias("id"),
            F.first("key").alias("key"),
            F.first("place").alias("place"),
        )
        .withColumn("all", F.sum("weight").over(anchored))
        .withColumn("chunks", F.ceil(F.count("*").over(anchored) / CHUNK))
        .where("all > 1")
        .drop("all")
    )
    folded = stored(folded)

    wanted = folded.groupBy("id", "key").agg(
        F.collect_list(F.struct("place", "anchor", "digest", "weight", "chunks")).alias("wanted")
    )
    # Both joins read the same columns of the texts, so one exchange of them serves both.
    passed = [F.col(f"t.{c}") for c in rows.columns if c.startswith("other")]
    same = F.col("t.id").eqNullSafe(F.col("w.id")) & (F.col("t.key") == F.col("w.key"))
    holders = rows.alias("t").join(wanted.alias("w"), same).select("t.text", "w.wanted", *passed)
    texts = _segment_texts(holders, window)
    own = F.pmod(F.col("digest"), F.col("chunks"))
    dealt = (
        texts.withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)))
        .select(
            "anchor",
            F.least("own", "other").alias("x"),
            F.greatest("own", "other").alias("y"),
            "digest",
            "weight",
            "words",
        )
        .repartition("anchor", "x", "y")
        .sortWithinPartitions("anchor", "x", "y", "digest")
    )
    found = _repeated(dealt, window).distinct()
    start = F.shiftright("place", 6)
    spans = (
        _segment_rows(rows, window, fold=False)
        .join(found, ["anchor", "digest"])
        .groupBy("id", "key")
        .agg(
            F.collect_list(
                F.struct((start + F.col("low")).alias("a"), (start + F.col("high")).alias("b"))
            ).alias("spans")
        )
    )
    match = F.col("d.id").eqNullSafe(F.col("s.id")) & (F.col("d.key") == F.col("s.key"))
    joined = rows.alias("d").join(spans.alias("s"), match, "left").select(
        "d.text", "s.spans", *(F.col(f"d.other{i}") for i in range(len(others)))
    )
    names = ["text", *(f"other{i}" for i in range(len(others))), "n_words", "n_removed"]
    schema = T.StructType(
        [f for f in joined.schema.fields if f.name != "spans"]
        + [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())]
    )
    made = joined.mapInArrow(frugal(_kept(names, 1, 0, keep_spacing)), schema)
    back = {c: f"other{i}" for i, c in enumerate(others)} | {text_col: "text"}
    order = [c for c in docs.columns if c not in ("n_words", "n_removed")]
    return made.select(*(F.col(back[c]).alias(c) for c in order), "n_words", "n_removed")
