"""Byte-level BPE as recursive SQL over token positions.

Every task holds the merge table in an in-memory DuckDB. The distinct words of a
batch become token-position rows, one per byte; each round of a recursive query joins
neighbouring tokens with the merge table and contracts, per word, the leftmost
pair of least rank, until no word has a pair left. Decoding joins ids with the
vocabulary and concatenates the bytes by an ordered aggregation.

Where no pair with the merged token has a lower rank ("settled" merges, nearly
all), contracting one occurrence cannot create a better pair, so all
occurrences of the least pair are contracted in the same round, left to right;
that is the same result in logarithmic rounds for a run of equal bytes.

Null text counts as empty: no ids, no bytes. Ids, sources or repeated rows play no
part; an empty table gives an empty result; other columns are ignored. A very long text is encoded whole in its
task; a very long word is contracted in windows, so its time and memory in the engine grow in proportion.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from claimgrove.llm.tokens import as_string, slices

# Byte total of the distinct words that one recursive query contracts.
ROUND_BYTES = 1 << 20
# A longer word is contracted in windows of so many bytes that overlap by so many.
WINDOW, OVERLAP = 512, 128
# Words whose ids a worker keeps between batches; beyond it the memory starts anew.
KEPT_WORDS = 800_000
# Tokens that one decoding query aggregates.
DECODE_TOKENS = 1 << 19

ENCODE = """
WITH RECURSIVE piece(word, pos, id) USING KEY (word, pos) AS (
  SELECT word, pos, id FROM start
  UNION ALL
  (WITH paired AS (
     SELECT word, pos, id, lead(id) OVER w AS next_id, lead(pos) OVER w AS next_pos
     FROM piece WHERE id IS NOT NULL WINDOW w AS (PARTITION BY word ORDER BY pos)),
   hits AS (  -- the pairs of least rank of each word
     SELECT p.word, p.pos, p.next_pos, m.merged, m.settled
     FROM paired p JOIN merges m ON m.pair = p.id * 1048576 + p.next_id
     QUALIFY m.merged = min(m.merged) OVER (PARTITION BY p.word)),
   linked AS (  -- pairs that share a token form a run
     SELECT *, row_number() OVER o AS nth,
            coalesce(lag(next_pos) OVER o = pos, false) AS shares
     FROM hits WINDOW o AS (PARTITION BY word ORDER BY pos)),
   runs AS (
     SELECT *, nth - max(CASE WHEN NOT shares THEN nth END)
                     OVER (PARTITION BY word ORDER BY pos) AS in_run
     FROM linked),
   chosen AS (
     SELECT word, pos, next_pos, merged FROM runs
     WHERE CASE WHEN settled THEN in_run % 2 = 0 ELSE nth = 1 END),
   live AS (SELECT DISTINCT word FROM chosen)
   SELECT p.word, p.pos,  -- the right token of a contracted pair becomes null
          CASE WHEN gone.pos IS NULL THEN coalesce(c.merged, p.id) END
   FROM piece p SEMI JOIN live ON live.word = p.word
   LEFT JOIN chosen c ON c.word = p.word AND c.pos = p.pos
   LEFT JOIN chosen gone ON gone.word = p.word AND gone.next_pos = p.pos
   WHERE p.id IS NOT NULL))
SELECT word, id FROM piece WHERE id IS NOT NULL ORDER BY word, pos
"""

DECODE = """
SELECT doc, string_agg(hex, '' ORDER BY pos) AS hex
FROM ids JOIN vocabulary USING (id) GROUP BY doc
"""


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a rank file: base64 of the token's bytes, then its id."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


def _joined(
    ids: np.ndarray, places: np.ndarray, new: np.ndarray, at: np.ndarray
) -> tuple[np.ndarray, np.ndarray] | None:
    """Tokens of two overlapping windows joined at two neighbouring tokens that both have, or None."""
    _, i, j = np.intersect1d(places, at, assume_unique=True, return_indices=True)
    inside = (i + 1 < len(ids)) & (j + 1 < len(new))
    i, j = i[inside], j[inside]
    both = (ids[i] == new[j]) & (ids[i + 1] == new[j + 1])
    if not both.any():
        return None
    k = np.flatnonzero(both)[both.sum() // 2]
    return (
        np.concatenate([ids[: i[k] + 1], new[j[k] + 1 :]]),
        np.concatenate([places[: i[k] + 1], at[j[k] + 1 :]]),
    )


class ByteBpe:
    _loaded: dict[tuple[str, str], ByteBpe] = {}

    def __init__(self, path: str, pattern: str):
        import duckdb
        import regex

        self.ranks = read_ranks(path)
        self.split = regex.compile(pattern).findall
        self.sizes = np.zeros(max(self.ranks.values()) + 1, dtype=np.int64)
        self.sizes[list(self.ranks.values())] = [len(token) for token in self.ranks]
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        self.known: dict[str, bytes] = {}  # ids as little-endian unsigned 32-bit integers
        # In memory only: a task must not depend on a local disk.
        self.db = duckdb.connect(
            ":memory:", config={"threads": 1, "memory_limit": "700MB", "temp_directory": ""}
        )
        pairs = [
            (self.ranks[token[:i]] * 1048576 + self.ranks[token[i:]], rank)
            for token, rank in self.ranks.items()
            for i in range(1, len(token))
            if token[:i] in self.ranks and token[i:] in self.ranks
        ]
        keys, merged = (np.array(x, dtype=np.int64) for x in zip(*pairs))
        least = np.full(max(self.ranks.values()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, keys // 1048576, merged)
        np.minimum.at(least, keys % 1048576, merged)
        settled = least[merged] > merged
        self._table("merges", {"pair": keys, "merged": merged, "settled": settled})
        ids = np.array(list(self.ranks.values()), dtype=np.int64)
        self._table("vocabulary", {"id": ids, "hex": [t.hex() for t in self.ranks]})

    def _table(self, name: str, columns: dict) -> None:
        rows = pa.table(columns)  # noqa: F841  read by name
        self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM rows")

    @classmethod
    def load(cls, path: str, pattern: str) -> ByteBpe:
        if (path, pattern) not in cls._loaded:
            cls._loaded[path, pattern] = cls(path, pattern)
        return cls._loaded[path, pattern]

    def _contract(self, words: list[bytes]) -> list[bytes]:
        lengths = np.array([len(w) for w in words])
        ends = np.cumsum(lengths)
        start = pa.table(  # noqa: F841  read by name
            {
                "word": np.repeat(np.arange(len(words)), lengths),
                "pos": np.arange(ends[-1]) - np.repeat(ends - lengths, lengths),
                "id": self.byte_ids[np.frombuffer(b"".join(words), dtype=np.uint8)],
            }
        )
        found = self.db.execute(ENCODE).fetchnumpy()
        bounds = 4 * np.searchsorted(found["word"], np.arange(len(words) + 1))
        ids = np.asarray(found["id"]).astype("<u4").tobytes()
        return [ids[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]

    def _in_windows(self, word: bytes) -> bytes:
        """Ids of a long word: its windows are contracted by themselves and joined where they agree.

        Ids are those of a byte string exactly if every two neighbours are (each pair of tokens encodes
        to itself). Where two windows share two neighbouring tokens, what stands up to the first comes from the
        left window and the rest from the right one, so all pairs of the result are pairs of a window. Where
        windows share none, a wider one takes their place, in the end the whole word.
        """
        starts = range(0, max(1, len(word) - OVERLAP), WINDOW - OVERLAP)
        batch = max(1, ROUND_BYTES // WINDOW)
        ids, places = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        done: list[np.ndarray] = []  # ids that no later window can change
        for first in range(0, len(starts), batch):
            own = starts[first : first + batch]
            coded = self._contract([word[a : a + WINDOW] for a in own])
            for start, raw in zip(own, coded):
                end, wide = min(start + WINDOW, len(word)), WINDOW
                new = np.frombuffer(raw, dtype="<u4").astype(np.int64)
                while True:
                    at = start + np.cumsum(self.sizes[new]) - self.sizes[new]
                    joined = (new, at) if start == 0 else _joined(ids, places, new, at)
                    if joined is not None:
                        break
                    # Back to a token's place well before the window, of what is still held.
                    wide *= 2
                    held = np.concatenate([*done, ids])
                    done, ids = [], held
                    places = np.cumsum(self.sizes[ids]) - self.sizes[ids]
                    start = int(places[max(0, np.searchsorted(places, end - wide, side="right") - 1)])
                    new = np.frombuffer(self._contract([word[start:end]])[0], dtype="<u4").astype(np.int64)
                ids, places = joined
                settled = int(np.searchsorted(places, end - WINDOW))
                done.append(ids[:settled])
                ids, places = ids[settled:], places[settled:]
        return np.concatenate([*done, ids]).astype("<u4").tobytes()

    def words(self, words: list[str]) -> list[bytes]:
        """Ids of each word, as bytes; a word that is a token itself is that token."""
        if len(self.known) > KEPT_WORDS:
            self.known = {}
        todo, held = [], 0

        def contract() -> None:
            if todo:
                raw = [w.encode() for w in todo]
                short = [w for w in raw if len(w) <= WINDOW]
                coded = iter(self._contract(short) if short else ())
                ids = [next(coded) if len(w) <= WINDOW else self._in_windows(w) for w in raw]
                self.known.update(zip(todo, ids))

        for word in words:
            if word in self.known:
                continue
            raw = word.encode()
            if raw in self.ranks:
                self.known[word] = self.ranks[raw].to_bytes(4, "little")
                continue
            todo.append(word)
            held += len(raw)
            if held >= ROUND_BYTES:
                contract()
                todo, held = [], 0
        contract()
        return [self.known[w] for w in words]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids per text, each match of the pattern by itself."""
        parts = [self.split(t) for t in texts]
        counts = [len(p) for p in parts]
        coded = pa.array([w for p in parts for w in p], pa.large_string()).dictionary_encode()
        del parts
        each = self.words(coded.dictionary.to_pylist())
        index = coded.indices.to_numpy(zero_copy_only=False)
        lengths = np.array([len(x) // 4 for x in each], dtype=np.int64)
        flat = np.frombuffer(b"".join(each), dtype="<u4")
        starts = np.cumsum(lengths) - lengths
        result, at = [], 0
        for count in counts:
            own = index[at : at + count]
            at += count
            n = lengths[own]
            ends = np.cumsum(n)
            total = int(ends[-1]) if count else 0
            result.append(flat[np.arange(total) + np.repeat(starts[own] - (ends - n), n)])
        return result

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        """Bytes of each array of ids."""
        result, first = [], 0
        while first < len(ids):
            last, held = first, 0
            while last < len(ids) and (last == first or held + len(ids[last]) <= DECODE_TOKENS):
                held += len(ids[last])
                last += 1
            result += self._join(ids[first:last])
            first = last
        return result

    def _join(self, ids: list[np.ndarray]) -> list[bytes]:
        lengths = [len(x) for x in ids]
        rows = pa.table(  # noqa: F841  read by name
            {
                "doc": np.repeat(np.arange(len(ids)), lengths),
                "pos": np.arange(sum(lengths)),
                "id": np.concatenate([*ids, np.zeros(0, dtype=np.uint32)]).astype(np.int64),
            }
        )
        found = self.db.execute(DECODE.replace("ids JOIN", "rows JOIN")).fetchall()
        joined = dict(found)
        return [bytes.fromhex(joined.get(i, "")) for i in range(len(ids))]


def bpe_round_trip(
    docs: DataFrame,
    path: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    slice_bytes: int = 1 << 22,
) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text."""
    schema = pa.schema(
        [
            ("doc_id", pa.int64()),
            ("n_tokens", pa.int64()),
            ("ids_sha256", pa.string()),
            ("decoded_sha256", pa.string()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = ByteBpe.load(path, pattern)
        for batch in batches:
            names, texts = batch.column(0), as_string(batch.column(1))
            for first, last in slices(texts, slice_bytes):
                ids = codec.encode(texts.slice(first, last - first).to_pylist())
                raw = codec.decode(ids)
                yield pa.RecordBatch.from_arrays(
                    [
                        names.slice(first, last - first),
                        pa.array([len(x) for x in ids], pa.int64()),
                        pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in ids]),
                        pa.array([hashlib.sha256(x).hexdigest() for x in raw]),
                    ],
                    schema=schema,
                )

    chosen = docs.select(docs[id_col].cast("bigint"), docs[text_col].cast("string"))
    return chosen.mapInArrow(
        run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    )
