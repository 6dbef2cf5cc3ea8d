"""Toxicity scores: a learned lexicon, misspellings, and the context of every hit.

From a bounded labelled sample come the words that mark toxic documents. They form a
trie; the Levenshtein automaton of each distinct word of a text is intersected with
it, so an entry is found exactly or misspelt by one letter. Word forms that clean documents
use are never taken for misspellings. Every hit is scored in its window of words: whether
quotation marks enclose it, and how many other hits stand near. A logistic regression on these
window scores tells quotation from abuse.

Labels of held-out rows (crc32 of the id, modulo 5, is 0) are never read; labels, language,
source and id are never inputs. Whole texts are scored in the tasks that read them, without a
shuffle. Null text counts as empty and has no hits. Without labels of both classes
there is no lexicon, and every score is the smoothed share of class 1. Rows labelled more
than once count once, with the greatest label. An empty table gives an empty result; other columns are ignored.
Runs of letters are looked up also within words joined by other signs. Very long texts are scored whole,
a text at a time.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimgrove.llm.common import held_out, stored, text_or_empty
from claimgrove.llm.lexicon import Trie, edits
from claimgrove.llm.logistic import ridge, sigmoid
from claimgrove.llm.tokens import as_string, frugal, slices, split_words

# Labelled rows that lexicon and weights are fitted on at most, chosen by the hash of their id.
SAMPLE = 20_000
# An entry marks at least so many toxic documents, so many times more often than clean ones.
SUPPORT, LIFT = 3, 20.0
# Entries from this length on may be misspelt by one letter.
FUZZY_LETTERS = 5
WINDOW = 8
KEPT_WORDS = 300_000
# Entries wanted per toxic document of the sample, and entries at most. Texts come in copies, so every rare word
# of a copied text would mark toxic documents; the words that mark most documents are taken until each has so many.
COVER, ENTRIES = 4, 4096
LETTERS = re.compile(r"[^\W\d_]{3,}")
QUOTES = "\"“”„«»‹›"
SIGNALS = ("bare", "quoted", "misspelt", "misspelt_quoted", "dense", "share")


def plain(word: str) -> str:
    """Lower case, without what is not a letter at both ends."""
    low = word.lower()
    if low.isalpha():
        return low
    first, last = 0, len(low)
    while first < last and not low[first].isalpha():
        first += 1
    while last > first and not low[last - 1].isalpha():
        last -= 1
    return low[first:last]


class Spotter:
    """Hits of a lexicon in texts: 0 none, 1 exact, 2 misspelt, once per distinct word."""

    def __init__(self, words: list[str], clean: list[str]):
        self.trie = Trie(words)
        self.clean = frozenset(clean)
        # One edit leaves the first or the second half of an entry as it is, and its length within one.
        self.halves = frozenset(
            (head, size, half)
            for e in words
            if len(e) >= FUZZY_LETTERS
            for head, half in ((True, e[: len(e) // 2]), (False, e[len(e) // 2 :]))
            for size in (len(e) - 1, len(e), len(e) + 1)
        )
        self.cuts = sorted({len(e) // 2 for e in words} | {len(e) - len(e) // 2 for e in words})
        self.known: dict[str, int] = {}

    def kind(self, word: str) -> int:
        """That of its runs of letters, as entries are learned from; an exact one goes before a misspelt one."""
        low = word.lower()
        kinds = [self._kind(low)] if low.isalpha() else [self._kind(run) for run in LETTERS.findall(low)]
        return min((k for k in kinds if k), default=0)

    def _kind(self, word: str) -> int:
        if word in self.clean:
            return 0
        if self.trie.accepts(word):
            return 1
        if not self._near(word):
            return 0
        return 2 if edits(word, self.trie, 1) is not None else 0

    def _near(self, word: str) -> bool:
        size = len(word)
        return any(
            (True, size, word[:n]) in self.halves or (False, size, word[-n:]) in self.halves
            for n in self.cuts
        )

    def kinds(self, words: list[str]) -> np.ndarray:
        if len(self.known) > KEPT_WORDS:
            self.known = {}
        known = self.known
        for word in words:
            if word not in known:
                known[word] = self.kind(word)
        return np.array([known[w] for w in words], dtype=np.int8)

    def signals(self, texts: pa.Array) -> np.ndarray:
        """A row of `SIGNALS` per text."""
        result = np.zeros((len(texts), len(SIGNALS)))
        for first, last in slices(texts):
            offsets, words = split_words(texts.slice(first, last - first))
            coded = words.dictionary_encode()
            forms = coded.dictionary.to_pylist()
            index = coded.indices.to_numpy(zero_copy_only=False)
            kind = self.kinds(forms)[index] if len(index) else np.zeros(0, dtype=np.int8)
            marks = np.array([sum(w.count(q) for q in QUOTES) for w in forms] or [0])
            hits = np.flatnonzero(kind)
            docs = np.searchsorted(offsets, hits, side="right") - 1
            for doc in np.unique(docs):
                a, b = offsets[doc], offsets[doc + 1]
                own = hits[docs == doc]
                result[first + doc] = self._score(own - a, kind[own], marks[index[a:b]], forms, index[a:b])
        return result

    @staticmethod
    def _score(at, kind, marks, forms, index) -> np.ndarray:
        """Window scores of one text; `at` are the places of its hits."""
        opened = np.concatenate(([0], np.cumsum(marks)))
        quoted = np.zeros(len(at), dtype=bool)
        for k, place in enumerate(at):
            left = max(0, place - WINDOW)
            right = min(len(index), place + WINDOW + 1)
            word = forms[index[place]]
            before = sum(word.split(plain(word) or word)[0].count(q) for q in QUOTES)
            in_front = opened[place] - opened[left] + before
            behind = opened[right] - opened[place] - before
            quoted[k] = in_front % 2 == 1 and behind > 0
        near = np.searchsorted(at, at + WINDOW, side="right") - np.searchsorted(at, at - WINDOW)
        exact = kind == 1
        return np.array(
            [
                np.log1p((exact & ~quoted).sum()),
                np.log1p((exact & quoted).sum()),
                np.log1p((~exact & ~quoted).sum()),
                np.log1p((~exact & quoted).sum()),
                np.log1p(near.max() - 1),
                len(at) / len(index),
            ]
        )


def choose_entries(toxic: list[list[str]]) -> list[str]:
    """Words that together mark every toxic document `COVER` times where they can.

    `toxic` has the marking words of each document. The entry that marks most
    documents still short of hits goes first; ties go to the shorter, then the first in order.
    """
    marks: dict[str, list[int]] = {}
    for doc, own in enumerate(toxic):
        for word in own:
            marks.setdefault(word, []).append(doc)
    short = np.full(len(toxic), COVER)
    chosen: list[str] = []
    # Gains only shrink, so an entry is counted anew only when it comes to the front.
    queue = [(-len(docs), len(word), word) for word, docs in marks.items() if len(docs) >= SUPPORT]
    heapq.heapify(queue)
    while queue and len(chosen) < ENTRIES:
        held, size, word = heapq.heappop(queue)
        docs = np.array(marks[word])
        gain = int((short[docs] > 0).sum())
        if gain == -held:
            short[docs] -= 1
            chosen.append(word)
        elif gain >= SUPPORT:
            heapq.heappush(queue, (-gain, size, word))
    return chosen


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE):
    """The spotter's entries and the weights of its signals, from at most `sample` rows."""
    known = (
        labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("label"))
        .where(~held_out("doc_id"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )
    rows = stored(docs.join(F.broadcast(known), "doc_id").select("doc_id", "text", "label"))
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = counts.get(1, 0), counts.get(0, 0)
    if not n_toxic or not n_clean:
        return [], [], np.append(np.zeros(len(SIGNALS)), np.log((n_toxic + 1) / (n_clean + 1)))
    fold = F.when(F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(2)) == 0, 0).otherwise(1)
    rows = rows.withColumn("fold", fold)
    letters = F.lower(text_or_empty("text"))
    distinct = F.array_distinct(F.regexp_extract_all(letters, F.lit(r"(\p{L}{3,})"), F.lit(1)))
    terms = stored(
        rows.select("label", "fold", F.explode(distinct).alias("word"))
        .groupBy("word", "fold")
        .agg(
            F.sum("label").cast("bigint").alias("bad"),
            F.sum(1 - F.col("label")).cast("bigint").alias("good"),
        )
    )
    # Each half is measured by the lexicon of the other, so the weights know how a lexicon does
    # on documents it was not made from; the lexicon that is used comes from both.
    parts = [_spotter(rows.where(f"fold = {f}"), terms.where(f"fold = {f}"), distinct) for f in (0, 1)]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spotters = [Spotter(*part) for part in parts]
        for batch in batches:
            texts, fold = as_string(batch.column(0)), batch.column(2).to_numpy()
            signals = np.where(
                (fold == 0)[:, None], spotters[1].signals(texts), spotters[0].signals(texts)
            )
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c) for c in signals.T), batch.column(1)], names=[*SIGNALS, "label"]
            )

    schema = ", ".join(f"{s} double" for s in SIGNALS) + ", label int"
    fitted = rows.select("text", "label", "fold").mapInArrow(frugal(measure), schema).toPandas()
    x, y = fitted[list(SIGNALS)].to_numpy(), fitted["label"].to_numpy(dtype=np.float64)
    order = np.lexsort((*x.T, y))
    return *_spotter(rows, terms, distinct), ridge(x[order], y[order])


def _spotter(rows: DataFrame, terms: DataFrame, distinct: Column) -> tuple[list[str], list[str]]:
    """Entries and clean forms from labelled rows and the document counts of their terms.

    Words are counted and filtered by Spark; of the toxic documents only the words that mark some reach the driver.
    """
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = counts.get(1, 0), counts.get(0, 0)
    if not n_toxic:
        return [], []
    terms = terms.groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    share = (F.col("bad") + 0.5) / n_toxic >= LIFT * (F.col("good") + 0.5) / max(n_clean, 1)
    marks = (F.col("bad") >= SUPPORT) & share
    marking = stored(terms.where(marks).select("word"))
    held = rows.where("label = 1").select("doc_id", F.explode(distinct).alias("word")).join(marking, "word")
    toxic = held.groupBy("doc_id").agg(F.collect_list("word").alias("words")).orderBy("doc_id").collect()
    words = choose_entries([sorted(r["words"]) for r in toxic])
    probe, own = Spotter(words, []), frozenset(words)

    def reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(probe.kinds(batch.column(0).to_pylist()) > 0))

    # Forms of clean documents that would be taken for an entry but don't mark toxic ones.
    found = terms.where((F.col("good") > 0) & ~marks).select("word").mapInArrow(frugal(reached), "word string")
    return words, sorted(r["word"] for r in found.collect() if r["word"] not in own)


def toxicity_scores(
    docs: DataFrame,
    labels: DataFrame,
    threshold: float = 0.5,
    sample: int = SAMPLE,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    rows = docs.select(
        docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].cast("string").alias("text")
    )
    words, clean, weights = learn(rows, labels, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spotter = Spotter(words, clean)
        for batch in batches:
            signals = spotter.signals(as_string(batch.column(1)))
            score = sigmoid(signals @ weights[:-1] + weights[-1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], names=["doc_id", "score"])

    return rows.mapInArrow(frugal(run), "doc_id bigint, score double").select(
        "doc_id",
        held_out("doc_id").alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def drop_toxic(
    docs: DataFrame,
    learned_from: DataFrame,
    labels: DataFrame,
    threshold: float = 0.5,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """`docs` without the rows that score `threshold` or more; all columns stay.

    The model is learned from `learned_from`, and rows are dropped where they are read.
    """
    source = learned_from.select(
        learned_from[id_col].cast("bigint").alias("doc_id"),
        learned_from[text_col].cast("string").alias("text"),
    )
    words, clean, weights = learn(source, labels)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spotter = Spotter(words, clean)
        for batch in batches:
            signals = spotter.signals(as_string(batch.column(at)))
            yield batch.filter(pa.array(sigmoid(signals @ weights[:-1] + weights[-1]) < threshold))

    return docs.mapInArrow(frugal(run), docs.schema)
