"""Word-wise tokenising with a public vocabulary file, once per distinct word."""

from __future__ import annotations

import ctypes
import os
import string
import unicodedata
from collections.abc import Callable, Iterator
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Units whose ids a worker keeps between slices; beyond it the later half is forgotten (frequent units
# turn up early).
KEPT_WORDS = 400_000
PUNCTUATION = string.punctuation
# Bytes of text that are split into words at once; memory per task follows from it.
SLICE_BYTES = 1 << 20
# The same for whole words looked up in arrays, which take less room than lists of strings.
TOKEN_SLICE_BYTES = 1 << 21


def as_string(column: pa.Array) -> pa.Array:
    """Strings with null as empty, with offsets wide enough for any batch."""
    return pc.fill_null(column.cast(pa.large_string()), "")


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges that hold at most `limit` bytes each, or one longer text alone.

    After each, Arrow's pool gives back what it keeps of freed buffers.
    """
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < len(texts):
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield first, last
        first = last
        pa.default_memory_pool().release_unused()


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], tokenizes: bool = False):
    """`run` for `mapInArrow`, after which neither Arrow's pool nor the C library keeps freed memory.

    An executor's workers live on between tasks; what one keeps is missing in the next stage. So
    tokenizers that earlier tasks loaded go too, unless this one `tokenizes`.
    """

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not tokenizes:
            WordTokenizer._loaded.clear()
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it; others give back by themselves
        if trim is not None:
            trim(0)

    return wrapped


def split_words(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Offsets per row and all words of non-null strings, split at ASCII white space."""
    parts = pc.ascii_split_whitespace(column)
    words = parts.flatten()
    counts = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    empty = pc.equal(words, "")
    if pc.any(empty).as_py():  # leading and trailing white space leave empty words
        owner = np.repeat(np.arange(len(counts)), counts)
        keep = ~empty.to_numpy(zero_copy_only=False)
        words = words.filter(pa.array(keep))
        counts = np.bincount(owner[keep], minlength=len(counts))
    return np.concatenate(([0], np.cumsum(counts))), words


def _letters(text: str) -> bool:
    """Letters only, also in lower case and composed (where one letter may add a mark)."""
    if text.isascii():
        return text.isalpha()
    return text.isalpha() and text.lower().isalpha() and unicodedata.is_normalized("NFC", text)


def _cut_marks(words: pa.Array) -> tuple[pa.Array, pa.Array]:
    """A run of letters and the ASCII punctuation after it; other words whole, and nothing after."""
    core = pc.ascii_rtrim(words, PUNCTUATION)
    inner = pc.ascii_is_alpha(core).to_numpy(zero_copy_only=False).copy()
    wide = ~pc.string_is_ascii(core).to_numpy(zero_copy_only=False)
    inner[wide] = [_letters(c) for c in core.filter(pa.array(wide)).to_pylist()]
    core = pc.if_else(pa.array(inner), core, words)
    size = pc.subtract(pc.binary_length(words), pc.binary_length(core)).to_numpy(zero_copy_only=False)
    marks = pa.array([""] * len(words), pa.large_string())
    for n in np.unique(size[size > 0]):
        marks = pc.if_else(pa.array(size == n), pc.utf8_slice_codeunits(words, start=-int(n)), marks)
    return core, marks


class WordTokenizer:
    """Ids of a `tokenizers` file that never joins across white space or around letters.

    The file's splitter takes runs of letters and runs of other signs apart, so the ids of a
    text are those of its units in order: white-space separated words, and where a
    word is letters and then ASCII punctuation, these two. Each distinct unit is encoded once.
    Runs of letters go to the library many at a time: each is one word there, whose
    last id carries the end-of-word mark; where the marks don't count up, one by one.
    The library finds the file's special tokens in a text before it lower-cases; words that
    may hold one ('<|') are handed over as they are.
    """

    _loaded: dict[str, WordTokenizer] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task on every core
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.size = max(vocabulary.values()) + 1
        self.ends = np.zeros(self.size, dtype=bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        # Unit 0 is empty.
        self.units: dict[str, int] = {"": 0}
        self.flat = np.zeros(0, dtype=np.uint32)
        self.lengths = np.zeros(1, dtype=np.int64)

    @classmethod
    def load(cls, path: str) -> WordTokenizer:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def _forget(self, kept: int) -> None:
        """Keep the first `kept` units."""
        self.units = dict(islice(self.units.items(), kept))
        self.lengths = self.lengths[:kept].copy()
        self.flat = self.flat[: self.lengths.sum()].copy()

    def _learn(self, units: list[str]) -> None:
        """Give every new unit a number and keep its ids."""
        flat, lengths = [self.flat], [self.lengths]
        alone: list[str] = []
        letters: list[str] = []
        for unit in units:
            (letters if _letters(unit) else alone).append(unit)
        for k in range(0, len(letters), 500):
            own = letters[k : k + 500]
            (coded,) = self.tokenizer.encode_batch_fast([" ".join(own)], add_special_tokens=False)
            ids = np.array(coded.ids, dtype=np.uint32)
            marks = np.flatnonzero(self.ends[ids]) + 1
            if len(marks) == len(own) and marks[-1] == len(ids):
                self.units.update(zip(own, range(len(self.units), len(self.units) + len(own))))
                flat.append(ids)
                lengths.append(np.diff(marks, prepend=0))
            else:
                alone += own
        for k in range(0, len(alone), 10_000):
            own = alone[k : k + 10_000]
            parts = [e.ids for e in self.tokenizer.encode_batch_fast(own, add_special_tokens=False)]
            self.units.update(zip(own, range(len(self.units), len(self.units) + len(own))))
            flat.append(np.array([i for part in parts for i in part], dtype=np.uint32))
            lengths.append(np.array([len(part) for part in parts], dtype=np.int64))
        self.flat, self.lengths = np.concatenate(flat), np.concatenate(lengths)

    def _numbers(self, units: pa.Array) -> np.ndarray:
        """The number of every unit."""
        coded = units.dictionary_encode()
        names = coded.dictionary.to_pylist()
        numbers = np.fromiter(map(self.units.get, names, repeat(-1)), np.int64, len(names))
        fresh = np.flatnonzero(numbers < 0)
        if len(fresh):
            names = [names[i] for i in fresh]
            self._learn(names)
            numbers[fresh] = np.fromiter(map(self.units.__getitem__, names), np.int64, len(names))
        return numbers[coded.indices.to_numpy(zero_copy_only=False)]

    def _pairs(self, words: pa.Array) -> np.ndarray:
        """Two unit numbers per word."""
        if len(self.units) > KEPT_WORDS:
            self._forget(KEPT_WORDS // 2)
        small = pc.and_(pc.string_is_ascii(words), pc.invert(pc.match_substring(words, "<|")))
        core, marks = _cut_marks(pc.if_else(small, pc.ascii_lower(words), words))
        return np.stack([self._numbers(core), self._numbers(marks)], axis=1)

    def encode(self, column: pa.Array) -> Iterator[np.ndarray]:
        """Yields an array of ids per row."""
        texts = as_string(column)
        for first, last in slices(texts, TOKEN_SLICE_BYTES):
            offsets, words = split_words(texts.slice(first, last - first))
            coded = words.dictionary_encode()
            pairs = self._pairs(coded.dictionary)
            units = pairs[coded.indices.to_numpy(zero_copy_only=False)].reshape(-1)
            n = self.lengths[units]
            ends = np.concatenate(([0], np.cumsum(n)))
            starts = np.cumsum(self.lengths) - self.lengths
            ids = self.flat[np.arange(ends[-1]) + np.repeat(starts[units] - ends[:-1], n)]
            bounds = ends[2 * offsets]
            for a, b in zip(bounds[:-1], bounds[1:]):
                yield ids[a:b]
