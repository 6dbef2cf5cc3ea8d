"""Token files: round trips against the tokenizers library, random access, lost tasks."""

import json
import os
import uuid
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from claimgrove.llm import token_files
from claimgrove.session import shared_folder
from tests.llm.conftest import SCHEMA, rows

WORDS = public_tokenizers.path("word_bpe_49k.json")


def fresh(spark):
    return f"{shared_folder(spark)}/test-{uuid.uuid4().hex}"


LIBRARY = Tokenizer.from_file(WORDS)


def library_ids(text):
    ids = LIBRARY.encode(text or "", add_special_tokens=False).ids + [2]
    return np.array(ids, dtype="<u4")


def expected(cases):
    at, want = 0, []
    for i, text in sorted(cases, key=lambda c: (c[0] is not None, c[0] or 0)):
        ids = library_ids(text)
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return want, at


def read_rows(spark, folder):
    got = token_files.read_documents(spark, folder).withColumn("crc", F.crc32("ids"))
    return sorted(
        (tuple(r) for r in got.select("doc_id", "start", "n_tokens", "crc").collect()), key=lambda r: r[1]
    )


@pytest.mark.parametrize("length", [7, 2048])
def test_round_trip(spark, docs, clashing, length):
    want, total = expected([(r[0], r[1]) for r in rows()])
    for df in (docs, clashing.repartition(5)):
        folder = fresh(spark)
        token_files.write_sequences(df, folder, WORDS, length=length)
        got = read_rows(spark, folder)
        assert [r[1:3] for r in got] == [r[1:3] for r in want] and got == want
        mask = token_files.read_sequences(spark, folder).select("start", "ids", "mask").collect()
        assert all(len(r["ids"]) == len(r["mask"]) == length for r in mask)
        assert sum(map(sum, (r["mask"] for r in mask))) == total


def test_empty_table_and_second_write(spark, none, docs):
    folder = fresh(spark)
    token_files.write_sequences(none, folder, WORDS)
    assert token_files.read_documents(spark, folder).count() == 0
    assert token_files.read_sequences(spark, folder).count() == 0
    with pytest.raises(Exception, match="holds sequences already"):
        token_files.write_sequences(docs, folder, WORDS)


def test_very_long_text_and_hot_id(spark):
    text = "lorem ipsum dolor " * 200_000
    cases = [(5, text)] + [(3, f"row {k}") for k in range(500)]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in cases], SCHEMA).repartition(4)
    folder = fresh(spark)
    token_files.write_sequences(df, folder, WORDS)
    got = read_rows(spark, folder)
    assert [r[0] for r in got] == [3] * 500 + [5]
    ids = library_ids(text)
    assert got[-1][2:] == (len(ids), zlib.crc32(ids.tobytes()))
    assert sorted(r[3] for r in got[:-1]) == sorted(zlib.crc32(library_ids(t).tobytes()) for _, t in cases[1:])
    assert [r[1] for r in got] == np.concatenate(([0], np.cumsum([r[2] for r in got])))[:-1].tolist()


def test_random_access_copies_nothing_and_unknown_files_do_not_count(spark, docs):
    folder = fresh(spark)
    token_files.write_sequences(docs, folder, WORDS, length=64)
    manifest = json.load(open(f"{folder}/{token_files.MANIFEST}"))
    assert manifest["bits"] == 16
    flat = []
    for part in manifest["parts"]:
        file = token_files.SequenceFile(f"{folder}/{part['ids']}")
        before = pa.total_allocated_bytes()
        views = [file.ids(k) for k in range(len(file))]
        assert pa.total_allocated_bytes() == before and not any(v.flags.owndata for v in views)
        flat += [int(x) for k, v in enumerate(views) for x in v[file.mask(k)]]
        with pytest.raises(IndexError):
            file.ids(len(file))
    want = [i for _, t in sorted(((r[0] or 0), r[1]) for r in rows() if r[0] == 5) for i in library_ids(t)]
    text = ",".join(map(str, flat))
    assert ",".join(map(str, want)) in text and len(flat) == manifest["n_tokens"]
    # What a lost task left behind is not read.
    with open(f"{folder}/ids-000000-{uuid.uuid4().hex}.arrow", "wb") as left:
        left.write(b"half a file")
    assert os.path.exists(f"{folder}/{token_files.MANIFEST}")
    assert len(read_rows(spark, folder)) == len(rows())
