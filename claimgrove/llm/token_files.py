"""Token ids in Arrow files of equal-length sequences, written and read by Spark.

`SequenceFiles` is a Spark data source (`arrow_sequences`). The ids of all documents, in ascending
id order, form one stream. Every task writes its stretch of the stream as an Arrow file whose
batches hold two fixed-size lists per row: `length` ids (the narrowest unsigned type that
holds the vocabulary) and as many mask bits (true for an id, false for padding, which only the last
row of a file has). Rows have one width, so row k of a memory-mapped file is found by
arithmetic and read without a copy (`SequenceFile`). A second small Arrow file lists the
task's documents and their lengths.

File names carry a random part, and only the manifest, written when all tasks have
succeeded, makes files count. A task that is lost and run again, or run twice, so leaves
at most a file that nobody reads. The manifest has one entry per file with the
number of ids in the files before it.

The folder must lie on a file system that driver and executors share and Arrow knows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    InputPartition,
    WriterCommitMessage,
)

from claimgrove.llm.tokens import TOKEN_SLICE_BYTES, WordTokenizer, as_string, slices

MANIFEST = "_manifest.json"
# Ids of one record batch; memory of a task follows from it.
BATCH_IDS = 1 << 19
INDEX = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64())])
DOCUMENTS = "doc_id bigint, start bigint, n_tokens bigint, ids binary"
SEQUENCES = "start bigint, ids array<bigint>, mask array<boolean>"


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder and the folder's path in it."""
    if folder.startswith("file:"):
        folder = "/" + folder.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(folder)


def id_type(size: int) -> pa.DataType:
    """The narrowest unsigned type for ids below `size`."""
    return pa.uint8() if size <= 1 << 8 else pa.uint16() if size <= 1 << 16 else pa.uint32()


def sequence_schema(length: int, kind: pa.DataType) -> pa.Schema:
    return pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])


def flat_ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a binary column (little-endian, 32 bits each) and their number per row."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    sizes = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    if not sizes.sum():
        return np.zeros(0, dtype="<u4"), sizes // 4
    first = column.offset
    bounds = np.frombuffer(column.buffers()[1], dtype=np.int64)[first : first + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[bounds[0] : bounds[-1]]
    return data.view("<u4"), sizes // 4


@dataclass
class Part(WriterCommitMessage):
    """What one task wrote."""

    partition: int
    ids: str
    docs: str
    n_docs: int
    n_tokens: int


def tokenised(column: pa.Array, tokenizer_path: str, end_id: int) -> Iterator[pa.Array]:
    """The ids of texts with the end id (little-endian, 32 bits each), a slice of the rows at a time."""
    tokenizer = WordTokenizer.load(tokenizer_path)
    texts = as_string(column)
    for first, last in slices(texts, TOKEN_SLICE_BYTES):
        rows = tokenizer.encode(texts.slice(first, last - first))
        yield pa.array((np.append(ids, end_id).astype("<u4").tobytes() for ids in rows), pa.large_binary())


class SequenceWriter(DataSourceArrowWriter):
    """Each task appends its documents (doc_id, ids or text) to two files of its own."""

    def __init__(self, folder: str, length: int, bits: int, tokenizer: str | None, end_id: int, overwrite: bool):
        self.folder, self.length, self.bits = folder, length, bits
        self.tokenizer, self.end_id = tokenizer, end_id
        where, path = opened(folder)
        where.create_dir(path, recursive=True)
        if not overwrite and where.get_file_info(f"{path}/{MANIFEST}").type != fs.FileType.NotFound:
            raise FileExistsError(f"{folder} holds sequences already")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        kind = {8: pa.uint8(), 16: pa.uint16(), 32: pa.uint32()}[self.bits]
        schema, length = sequence_schema(self.length, kind), self.length
        rows = max(1, BATCH_IDS // length)
        where, path = opened(self.folder)
        number, mark = TaskContext.get().partitionId(), uuid.uuid4().hex
        names = [f"{what}-{number:06d}-{mark}.arrow" for what in ("ids", "docs")]
        waiting: list[np.ndarray] = []
        held = n_docs = n_tokens = 0

        def put(values: np.ndarray) -> None:
            """Whole sequences; the last one may be shorter and is padded."""
            full = -(-len(values) // length) * length
            ids, mask = np.zeros(full, dtype=kind.to_pandas_dtype()), np.zeros(full, dtype=bool)
            ids[: len(values)], mask[: len(values)] = values, True
            columns = [pa.FixedSizeListArray.from_arrays(pa.array(v), length) for v in (ids, mask)]
            sequences.write_batch(pa.RecordBatch.from_arrays(columns, schema=schema))

        with (
            where.open_output_stream(f"{path}/{names[0]}") as out,
            where.open_output_stream(f"{path}/{names[1]}") as listed,
            pa.ipc.new_file(out, schema) as sequences,
            pa.ipc.new_file(listed, INDEX) as index,
        ):
            for names_of, column in self._columns(iterator):
                values, counts = flat_ids(column)
                index.write_batch(pa.RecordBatch.from_arrays([names_of, pa.array(counts)], schema=INDEX))
                n_docs += len(counts)
                n_tokens += len(values)
                waiting.append(values.astype(kind.to_pandas_dtype()))
                held += len(values)
                if held >= rows * length:
                    flat = np.concatenate(waiting)
                    whole = held // (rows * length) * rows * length
                    for k in range(0, whole, rows * length):
                        put(flat[k : k + rows * length])
                    waiting, held = [flat[whole:].copy()], held - whole
            if held:
                put(np.concatenate(waiting))
        return Part(number, *names, n_docs, n_tokens)

    def _columns(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
        """Document ids and their token ids; texts are tokenised here, in the process that writes."""
        for batch in batches:
            doc_ids, at = batch.column(0).cast(pa.int64()), 0
            if self.tokenizer is None:
                yield doc_ids, batch.column(1)
                continue
            for ids in tokenised(batch.column(1), self.tokenizer, self.end_id):
                yield doc_ids.slice(at, len(ids)), ids
                at += len(ids)

    def commit(self, messages: list[Part | None]) -> None:
        parts, start = [], 0
        for part in sorted((m for m in messages if m is not None), key=lambda m: m.partition):
            if part.n_docs:
                entry = {"ids": part.ids, "docs": part.docs, "start": start, "n_tokens": part.n_tokens}
                parts.append(entry | {"n_docs": part.n_docs})
                start += part.n_tokens
        where, path = opened(self.folder)
        with where.open_output_stream(f"{path}/{MANIFEST}") as out:
            manifest = {"length": self.length, "bits": self.bits, "n_tokens": start, "parts": parts}
            out.write(json.dumps(manifest).encode())

    def abort(self, messages: list[Part | None]) -> None:
        where, path = opened(self.folder)
        for part in messages:
            for name in (part.ids, part.docs) if part is not None else ():
                where.delete_file(f"{path}/{name}")


@dataclass
class PartFile(InputPartition):
    """One entry of the manifest."""

    ids: str
    docs: str
    start: int


class SequenceReader(DataSourceReader):
    """One task per file; documents or sequences, batch by batch."""

    def __init__(self, folder: str, rows: str):
        self.folder, self.rows = folder, rows

    def partitions(self) -> list[PartFile]:
        parts = read_manifest(self.folder)["parts"]
        return [PartFile(p["ids"], p["docs"], p["start"]) for p in parts]

    def read(self, partition: PartFile | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # a manifest without files
            return
        where, path = opened(self.folder)
        with where.open_input_file(f"{path}/{partition.ids}") as source:
            file = pa.ipc.open_file(source)
            if self.rows == "sequences":
                at = partition.start
                for k in range(file.num_record_batches):
                    batch = file.get_batch(k)
                    starts = at + np.arange(len(batch)) * file.schema.field("ids").type.list_size
                    at = starts[-1] + file.schema.field("ids").type.list_size
                    lists = [
                        pc.cast(batch.column(i), pa.list_(t)) for i, t in enumerate((pa.int64(), pa.bool_()))
                    ]
                    yield pa.RecordBatch.from_arrays([pa.array(starts), *lists], ["start", "ids", "mask"])
                return
            with where.open_input_file(f"{path}/{partition.docs}") as listed:
                index = pa.ipc.open_file(listed).read_all().combine_chunks()
            yield from _documents(file, index, partition.start)


def _documents(file: pa.ipc.RecordBatchFileReader, index: pa.Table, start: int) -> Iterator[pa.RecordBatch]:
    """Rows of DOCUMENTS, with a batch of sequences and one unfinished document in memory."""
    counts = index["n_tokens"].to_numpy()
    ends = np.cumsum(counts)
    doc = begin = 0  # the next document, and the place in the file of the first id in memory
    parts: list[np.ndarray] = []
    have = 0
    for k in range(max(1, file.num_record_batches)):
        if file.num_record_batches:
            parts.append(file.get_batch(k).column(0).flatten().to_numpy())
            have += len(parts[-1])
        last = int(np.searchsorted(ends, have, side="right"))
        if k + 1 >= file.num_record_batches:
            last = len(ends)
        if last == doc:
            continue
        flat = np.concatenate(parts) if parts else np.zeros(0, np.uint8)
        size = int(ends[last - 1]) - begin
        bounds = np.concatenate(([begin], ends[doc:last])) - begin
        ids = pa.Array.from_buffers(
            pa.large_binary(),
            last - doc,
            [None, pa.py_buffer(bounds * 4), pa.py_buffer(flat[:size].astype("<u4"))],
        )
        ids = ids.cast(pa.binary()) if size < 1 << 28 else ids
        columns = [
            index["doc_id"].slice(doc, last - doc).combine_chunks(),
            pa.array(start + begin + bounds[:-1]),
            pa.array(counts[doc:last]),
            ids,
        ]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids"])
        doc, begin, parts = last, begin + size, [flat[size:].copy()]


class SequenceFiles(DataSource):
    """`arrow_sequences`: writes (doc_id, ids binary) or, with option `tokenizer`, (doc_id, text).

    Reads documents or, by option `rows`, sequences.
    """

    @classmethod
    def name(cls) -> str:
        return "arrow_sequences"

    def schema(self) -> str:
        return SEQUENCES if self.options.get("rows") == "sequences" else DOCUMENTS

    def writer(self, schema, overwrite: bool) -> SequenceWriter:
        length, bits = int(self.options.get("length", 2048)), int(self.options.get("bits", 32))
        tokenizer, end_id = self.options.get("tokenizer"), int(self.options.get("end_id", 2))
        return SequenceWriter(self.options["path"], length, bits, tokenizer, end_id, overwrite)

    def reader(self, schema) -> SequenceReader:
        return SequenceReader(self.options["path"], self.options.get("rows", "documents"))


def read_manifest(folder: str) -> dict:
    where, path = opened(folder)
    with where.open_input_stream(f"{path}/{MANIFEST}") as source:
        return json.loads(source.read())


class SequenceFile:
    """Random access to the sequences of one file: row k as NumPy views of the memory map."""

    def __init__(self, path: str):
        self.file = pa.ipc.open_file(pa.memory_map(path))
        self.length = self.file.schema.field("ids").type.list_size
        batches = self.file.num_record_batches
        self.rows = self.file.get_batch(0).num_rows if batches else 0
        self.count = (batches - 1) * self.rows + self.file.get_batch(batches - 1).num_rows if batches else 0

    def __len__(self) -> int:
        return self.count

    def ids(self, k: int) -> np.ndarray:
        """A view; nothing is copied."""
        return self._cell(k, 0).to_numpy()

    def mask(self, k: int) -> np.ndarray:
        """Bits have to be spread to bytes, so this one is a copy of `length` bytes."""
        return self._cell(k, 1).to_numpy(zero_copy_only=False)

    def _cell(self, k: int, column: int) -> pa.Array:
        if not 0 <= k < self.count:
            raise IndexError(k)
        batch, row = divmod(k, self.rows)
        return self.file.get_batch(batch).column(column)[row].values


def in_id_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and text, range-partitioned and sorted by id; null ids first.

    Rows with one id keep the order in which they are read. Their row number is part of the
    key, so an id with a third of all rows still spreads over partitions.
    """
    rows = docs.select(
        docs[id_col].cast("bigint").alias("doc_id"),
        docs[text_col].cast("string").alias("text"),
        F.monotonically_increasing_id().alias("row_no"),
    )
    return rows.repartitionByRange("doc_id", "row_no").sortWithinPartitions("doc_id", "row_no")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SequenceFiles)


def write_sequences(
    docs: DataFrame,
    folder: str,
    tokenizer_path: str,
    length: int = 2048,
    end_id: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> None:
    """Tokenise `docs` and write them to a new `folder` in ascending id order.

    A null text is empty and gives the end id alone; null ids come first; repeated ids and
    rows are documents of their own; an empty table gives a manifest without files; a very long text
    spans as many sequences as it needs and is held whole by one task; other columns are ignored.
    """
    register(docs.sparkSession)
    bits = id_type(max(WordTokenizer.load(tokenizer_path).size, end_id + 1)).bit_width
    ordered = in_id_order(docs, id_col, text_col).select("doc_id", "text")
    options = {"length": length, "bits": bits, "tokenizer": tokenizer_path, "end_id": end_id}
    ordered.write.format("arrow_sequences").options(**options).mode("append").save(folder)


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (little-endian, 32 bits each)."""
    register(spark)
    return spark.read.format("arrow_sequences").load(folder)


def read_sequences(spark: SparkSession, folder: str) -> DataFrame:
    """start (ids in the stream before it), ids and mask of every sequence, all of one length."""
    register(spark)
    return spark.read.format("arrow_sequences").option("rows", "sequences").load(folder)
