"""Vector bin packing of examples into training sequences.

Every example demands tokens, segments and loss-bearing tokens; a sequence limits
all three at once. The dot-product heuristic fills one sequence at a time: among
the examples that still fit, it takes the one whose demand has the largest dot
product with the capacity that is left (both in shares of the limits), so an
example that uses what is plentiful goes first.

Examples are packed in blocks of `BLOCK` inside the task that reads them, so
nothing is shuffled, a hot source changes nothing, and memory holds one block.
When examples may be cut, full sequences are cut off first, a gap is closed by
the head of the example that ranks next, and what is left at the end of a block
goes to sequences whose lengths are powers of two.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from claimgrove.llm.tokens import WordTokenizer, frugal

BLOCK = 4096
# Gaps below this are padded rather than filled with a sliver of another text.
LEAST_CUT = 16


def dot_product_bins(
    demand: np.ndarray, capacity: np.ndarray, cut: bool = False, least_cut: int = LEAST_CUT
) -> list[list[tuple[int, int, int]]]:
    """Bins of (item, start, length) over the first dimension, the tokens.

    `demand` has a row (tokens, segments, loss tokens) per item, each within
    `capacity`. With `cut`, items may be split; a cut takes loss tokens in proportion to
    its tokens and one segment more. Without it every item stays whole. Items without
    tokens are placed like any other. Ties go to the item that comes first.
    """
    capacity = np.asarray(capacity, dtype=np.float64)
    left = np.asarray(demand, dtype=np.float64).copy()
    if (left > capacity).any():
        raise ValueError("an example demands more than one sequence holds")
    if len(left) and (left[:, 1] == left[0, 1]).all() and (left[:, 2] == left[:, 0]).all():
        return _by_size(left[:, 0].astype(np.int64), left[0, 1], capacity, cut, least_cut)
    start = np.zeros(len(left), dtype=np.int64)
    # Largest first: the first fitting index then often is the best one, and the
    # arrays shrink from the front.
    alive = np.argsort(-(left / capacity).sum(1), kind="stable")
    bins: list[list[tuple[int, int, int]]] = []
    while len(alive):
        room, content = capacity.copy(), []
        need = left[alive]
        share = need / capacity
        free = np.ones(len(alive), dtype=bool)
        while True:
            score = np.where(free & (need <= room).all(1), share @ (room / capacity), -1.0)
            best = int(score.argmax()) if len(score) else 0
            if not len(score) or score[best] < 0:
                break
            item = alive[best]
            content.append((int(item), int(start[item]), int(left[item, 0])))
            room -= need[best]
            free[best] = False
        gap = int(room[0])
        if cut and gap >= least_cut and room[1] >= 1:
            rate = np.divide(need[:, 2], need[:, 0], out=np.zeros(len(need)), where=need[:, 0] > 0)
            fits = free & (need[:, 0] > gap) & (np.ceil(rate * gap) <= room[2])
            if fits.any():
                best = int(np.where(fits, share @ (room / capacity), -1.0).argmax())
                item = alive[best]
                content.append((int(item), int(start[item]), gap))
                start[item] += gap
                left[item, 2] -= min(left[item, 2], np.ceil(rate[best] * gap))
                left[item, 0] -= gap
        alive = alive[free]
        bins.append(content)
    return bins


def _by_size(
    sizes: np.ndarray, segments: float, capacity: np.ndarray, cut: bool, least_cut: int
) -> list[list[tuple[int, int, int]]]:
    """`dot_product_bins` where every token bears loss and all items have as many segments.

    The dot product then grows with the tokens, so the best item is the largest that fits; it
    is found by bisection over the sizes that are left. The bins are the same.
    """
    limit = int(min(capacity[0], capacity[2]))
    most = int(capacity[1] // segments) if segments else len(sizes)
    queues: dict[int, list[tuple[int, int]]] = {}
    for item in range(len(sizes) - 1, -1, -1):
        queues.setdefault(int(sizes[item]), []).append((item, 0))
    order = sorted(queues)
    bins: list[list[tuple[int, int, int]]] = []

    def take(size: int) -> tuple[int, int]:
        queue = queues[size]
        item = queue.pop()
        if not queue:
            del queues[size], order[bisect_left(order, size)]
        return item

    while order:
        room, content = limit, []
        while len(content) < most and (at := bisect_right(order, room)):
            size = order[at - 1]
            content.append((*take(size), size))
            room -= size
        gap = int(capacity[0]) - sum(size for _, _, size in content)
        if cut and least_cut <= gap <= room and order and order[-1] > gap and capacity[1] - segments * len(content) >= 1:
            size = order[-1]
            item, start = take(size)
            content.append((item, start, gap))
            rest = size - gap
            if rest not in queues:
                insort(order, rest)
            queues.setdefault(rest, []).append((item, start + gap))
        bins.append(content)
    return bins


def power_runs(content: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """The same pieces over sequences whose lengths are powers of two, largest first."""
    total = sum(length for _, _, length in content)
    runs, queue = [], list(reversed(content))
    for bit in reversed(range(total.bit_length())):
        want, run = total & (1 << bit), []
        while want:
            item, start, length = queue.pop()
            take = min(length, want)
            run.append((item, start, take))
            want -= take
            if take < length:
                queue.append((item, start + take, length - take))
        if run:
            runs.append(run)
    return runs


def pack_block(ids: list[np.ndarray], limit: int, segments: int, loss: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length) for one block of tokenised documents.

    Every token bears loss here. Full sequences are cut from the front of long
    documents; remainders go through `dot_product_bins`.
    """
    full, rest, base = [], [], []
    for doc, tokens in enumerate(ids):
        whole = len(tokens) // limit
        full += [[(doc, k * limit, limit)] for k in range(whole)]
        if len(tokens) % limit:
            rest.append((len(tokens) % limit, 1, len(tokens) % limit))
            base.append((doc, whole * limit))
    if not rest:
        return full
    bins = dot_product_bins(np.array(rest), np.array([limit, segments, loss]), cut=True)
    done = []
    for content in bins:
        placed = [(base[i][0], base[i][1] + start, length) for i, start, length in content]
        gap = limit - sum(length for _, _, length in placed)
        done += [placed] if gap < LEAST_CUT else power_runs(placed)
    return full + done


PIECES = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids_crc32", pa.int64()),
        ("doc_tokens", pa.int64()),
        ("sequence_id", pa.int64()),
        ("offset", pa.int64()),
    ]
)
PIECES_DDL = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
    "sequence_id bigint, offset bigint"
)


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    limit: int = 2048,
    segments: int = 256,
    loss: int | None = None,
    end_id: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
    block: int = BLOCK,
) -> DataFrame:
    """One row per piece; a document's ids are those of its text, then `end_id`.

    Each id lies in exactly one piece. A sequence holds at most `limit` tokens and `segments`
    pieces; lengths are `limit`, at most `LEAST_CUT` - 1 less, or a power of two.
    Sequence ids are unique: the input partition, then a count inside it, so a
    retried task gives the same ones. A null text is empty and gives one token;
    null and repeated ids are ordinary rows; an empty table gives no rows; other columns are
    ignored; a very long text fills full sequences first and is held whole by one task.
    """
    loss = limit if loss is None else loss

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = WordTokenizer.load(tokenizer_path)
        first = TaskContext.get().partitionId() << 40
        made, names, ids, held = 0, [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal made
            rows = []
            for content in pack_block(ids, limit, segments, loss):
                at = 0
                for doc, start, length in content:
                    piece = ids[doc][start : start + length]
                    crc = zlib.crc32(piece.tobytes())
                    rows.append((names[doc], start, length, crc, len(ids[doc]), first + made, at))
                    at += length
                made += 1
            columns = list(zip(*rows)) or [()] * len(PIECES)
            return pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, PIECES)], schema=PIECES
            )

        for batch in batches:
            for name, tokens in zip(batch.column(0).to_pylist(), tokenizer.encode(batch.column(1))):
                names.append(name)
                ids.append(np.append(tokens, np.uint32(end_id)).astype("<u4"))
                held += len(ids[-1])
                if len(ids) == block or held >= block * limit:
                    yield flush()
                    names, ids, held = [], [], 0
        if ids:
            yield flush()

    chosen = docs.select(docs[id_col].cast("bigint"), docs[text_col].cast("string"))
    return chosen.mapInArrow(frugal(run, tokenizes=True), PIECES_DDL)


def pack_examples(
    examples: DataFrame,
    limits: tuple[int, int, int],
    id_col: str = "example_id",
    tokens_col: str = "tokens",
    segments_col: str = "segments",
    loss_col: str = "loss_tokens",
    block: int = BLOCK,
) -> DataFrame:
    """Whole examples into sequences under limits on tokens, segments and loss tokens.

    Returns example_id, sequence_id and offset. Examples above a limit get a null sequence, so
    no row is lost; null demands count as zero.
    """
    from pyspark.sql import functions as F

    schema = pa.schema([("example_id", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
    capacity = np.array(limits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 40
        made, held = 0, []

        def flush() -> pa.RecordBatch:
            nonlocal made
            demand = np.array([row[1:] for row in held])
            fits = (demand <= capacity).all(1)
            index = np.flatnonzero(fits)
            rows = [(held[i][0], None, None) for i in np.flatnonzero(~fits)]
            for content in dot_product_bins(demand[index], capacity):
                at = 0
                for item, _, length in content:
                    rows.append((held[index[item]][0], first + made, at))
                    at += length
                made += 1
            return pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema
            )

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                held.append(row)
                if len(held) == block:
                    yield flush()
                    held = []
        if held:
            yield flush()

    chosen = examples.select(
        examples[id_col].cast("bigint"),
        *(
            F.coalesce(examples[c].cast("bigint"), F.lit(0)).alias(f"d{i}")
            for i, c in enumerate((tokens_col, segments_col, loss_col))
        ),
    )
    return chosen.mapInArrow(frugal(run), "example_id bigint, sequence_id bigint, offset bigint")
