"""The pipeline over a small corpus: what each stage must take and must leave."""

import collections
import random

import corpus_pipeline
from tests.llm.test_dedup import repeats_by_hand


def test_pipeline(spark, tmp_path):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice(["ka", "lo", "mi", "ter", "su", "na"]) for _ in range(4))
    toxic = ["grumbolt", "snarfle", "wretchik"]
    shared = [word() for _ in range(60)]
    source, marks = [], []
    for i in range(400):
        w = [word() for _ in range(150)]
        if i % 4 == 0:
            for _ in range(3):
                w.insert(rng.randrange(100), rng.choice(toxic))
        elif i % 20 == 1:
            w = w[:50] + shared + w[50:]
        source.append((i, " ".join(w)))
        marks.append((i, 1, int(i % 4 == 0)))
    copies = [(1000 + i, source[i][1].upper()) for i in range(2, 40, 4)]
    near = [(2000 + i, source[i][1].replace(source[i][1].split()[70], "changed")) for i in range(3, 40, 4)]
    everything = source + copies + near
    df = spark.createDataFrame(
        [(i, t, "en", "s", len(t)) for i, t in everything],
        "doc_id bigint, text string, lang string, source string, n_chars bigint",
    )
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    docs, seen = df, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = docs.collect()
        if name != "packing":
            assert docs.columns == df.columns
    ids = {name: {r["doc_id"] for r in found} for name, found in seen.items()}
    clean = {i for i, _ in everything if i % 4 or i >= 1000}
    assert ids["toxicity"] == clean
    assert ids["exact_dedup"] == clean - {i - 1000 for i, _ in copies}
    assert ids["simhash_dedup"] == ids["exact_dedup"] - {i for i, _ in near}
    left = [(r["doc_id"], r["text"]) for r in seen["simhash_dedup"]]
    want = collections.Counter((i, t) for i, _, _, t in repeats_by_hand(left, 35))
    assert collections.Counter((r["doc_id"], r["text"]) for r in seen["substring_dedup"]) == want
    assert all(r["n_chars"] == len(r["text"]) for r in seen["substring_dedup"])
    assert ids["packing"] == ids["substring_dedup"]
    key = lambda r: (r["doc_id"], r["start"], r["length"], r["ids_crc32"])
    again = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in again} == ids["packing"]
    assert sum(r["length"] for r in again) == sum(r["length"] for r in seen["packing"]) and key(again[0])
