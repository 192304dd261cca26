"""Byte-pair encoding of whole texts by a public tokenizer's ranks.

Texts are cut into words by array operations over all characters of a batch, each distinct word of a batch is
encoded once (a bounded cache keeps words from batch to batch), and the ids are gathered by position. A word is
encoded by a priority queue of merge ranks over a doubly linked list of its symbols; entries whose symbols have
changed since are skipped. Null and empty texts have the empty list of ids; strings of special tokens are
ordinary text. Texts of any length are encoded whole.
"""

from __future__ import annotations

import base64
import heapq
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CACHE_WORDS = 300_000
#: Characters of a batch that are cut at once.
CHARS = 2_000_000
LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3


def default_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


@lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """The class of each code point: letter, number, white space or other."""
    table = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for i in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(i))[0]
        if kind == "L":
            table[i] = LETTER
        elif kind == "N":
            table[i] = NUMBER
    # The characters with the property White_Space.
    white = [*range(9, 14), 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]
    table[white] = SPACE
    return table


def word_starts(cp: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether a word of the byte-level pattern starts at each code point.

    cp: code points of texts one after the other; first: whether a text starts there. A word is a contraction,
    or a run of letters, numbers or other characters with at most one blank before it, or white space (all of a
    run but its last character if a word follows).
    """
    n = len(cp)
    kind = _classes()[cp]
    start = np.ones(n, bool)
    start[1:] = (kind[1:] != kind[:-1]) | first[1:]
    change = start.copy()
    # Contractions count only where the apostrophe starts a word of its own.
    before = np.r_[np.int64(-1), cp[:-1].astype(np.int64)]
    blank_before = (before == 32) & ~first
    quote = (cp == 39) & change & ~blank_before
    at = np.flatnonzero(quote)
    if len(at):
        pad = np.r_[cp, np.zeros(2, cp.dtype)]
        over = np.r_[first, True, True]
        one, two = pad[at + 1], pad[at + 2]
        inside1 = ~over[at + 1]
        inside2 = inside1 & ~over[np.minimum(at + 2, n + 1)]
        short = inside1 & np.isin(one, [ord(c) for c in "stmd"])
        pairs = [(ord(a), ord(b)) for a, b in ("re", "ve", "ll")]
        long = inside2 & np.logical_or.reduce([(one == a) & (two == b) for a, b in pairs])
        for hit, size in ((short, 2), (long & ~short, 3)):
            start[at[hit] + 1] = False
            if size == 3:
                start[at[hit] + 2] = False
            end = at[hit] + size
            start[end[end < n]] = True
    # White space: its last character is a word's blank, or else a word of its own, if a word follows.
    space = kind == SPACE
    last = space.copy()
    last[:-1] &= (kind[1:] != SPACE) & ~first[1:]
    last[-1:] = False
    where = np.flatnonzero(last)
    start[where] = True
    joined = where[cp[where] == 32]
    start[joined + 1] = False
    return start | first


class WordEncoder:
    """Encodes single words, keeping those it has met up to a bound."""

    def __init__(self, ranks: dict[bytes, int], cache: int = CACHE_WORDS):
        self.ranks, self.limit, self.cache = ranks, cache, {}

    def __call__(self, word: bytes) -> list[int]:
        ids = self.cache.get(word)
        if ids is None:
            ids = self.encode(word)
            if len(self.cache) >= self.limit:
                self.cache.clear()
            self.cache[word] = ids
        return ids

    def encode(self, word: bytes) -> list[int]:
        ranks = self.ranks
        whole = ranks.get(word)
        if whole is not None:
            return [whole]
        n = len(word)
        end = list(range(1, n + 1))  # the symbol at i covers word[i:end[i]]; 0 marks one merged away
        before = list(range(-1, n - 1))
        queue = []
        for i in range(n - 1):
            rank = ranks.get(word[i : i + 2])
            if rank is not None:
                queue.append((rank, i, i + 2))
        heapq.heapify(queue)
        while queue:
            rank, i, stop = heapq.heappop(queue)
            middle = end[i]
            # Stale: one of the two symbols was merged away or has grown since.
            if not middle or middle >= stop or end[middle] != stop:
                continue
            end[i], end[middle] = stop, 0
            if stop < n:
                before[stop] = i
                rank = ranks.get(word[i : end[stop]])
                if rank is not None:
                    heapq.heappush(queue, (rank, i, end[stop]))
            j = before[i]
            if j >= 0:
                rank = ranks.get(word[j:stop])
                if rank is not None:
                    heapq.heappush(queue, (rank, j, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[word[i : end[i]]])
            i = end[i]
        return out


def _cut(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Row ranges of about CHARS bytes each."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        base = total[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(total, base + CHARS, "right")))
        yield at, stop
        at = stop


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts in a row as binary, and the number of words of each text."""
    texts = pc.fill_null(texts, "")
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    data = b"".join(texts.cast(pa.binary()).to_pylist())
    if not data:
        return pa.array([], pa.binary()), np.zeros(len(sizes), np.int64)
    raw = np.frombuffer(data, np.uint8)
    lead = np.flatnonzero((raw & 0xC0) != 0x80)
    cp = np.frombuffer(data.decode("utf-8").encode("utf-32-le"), np.uint32)
    starts = np.r_[0, np.cumsum(sizes)[:-1]]
    first_bytes = np.zeros(len(raw) + 1, bool)
    first_bytes[starts[sizes > 0]] = True
    first = first_bytes[lead]
    begin = lead[word_starts(cp, first)]
    offsets = np.r_[begin, len(raw)].astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)])
    upto = np.searchsorted(begin, np.r_[starts, len(raw)])
    return words, np.diff(upto)


def encode_batch(texts: pa.Array, encoder: WordEncoder) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in a row, and the number of ids of each text."""
    words, per_text = words_of(texts)
    if not len(words):
        return np.empty(0, np.int32), np.zeros(len(texts), np.int64)
    coded = words.dictionary_encode()
    known = [encoder(w) for w in coded.dictionary.to_pylist()]
    size = np.fromiter(map(len, known), np.int64, len(known))
    flat = np.fromiter((i for ids in known for i in ids), np.int32, int(size.sum()))
    base = np.r_[0, np.cumsum(size)[:-1]]
    index = coded.indices.to_numpy(zero_copy_only=False)
    n = size[index]
    total = np.r_[0, np.cumsum(n)]
    ids = flat[np.repeat(base[index] - total[:-1], n) + np.arange(total[-1])]
    ends = np.r_[0, np.cumsum(per_text)]
    return ids, total[ends[1:]] - total[ends[:-1]]


def _string(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name)).cast(pa.string())


def encode(docs: DataFrame, text: str = "text", ident: str = "doc_id", path: str | None = None) -> DataFrame:
    """(doc_id, ids): the ids of every text; repeated rows keep a row each."""
    path = path or default_path()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(load_ranks(path))
        for batch in batches:
            texts, keys = _string(batch, "text"), batch.column(0)
            for a, b in _cut(texts):
                ids, n = encode_batch(texts.slice(a, b - a), encoder)
                offsets = pa.array(np.r_[0, np.cumsum(n)].astype(np.int32))
                yield pa.RecordBatch.from_arrays([keys.slice(a, b - a), pa.ListArray.from_arrays(offsets, pa.array(ids))], [ident, "ids"])

    kind = docs.schema[ident].dataType.simpleString()
    return docs.select(ident, F.col(text).cast("string").alias("text")).mapInArrow(work, f"`{ident}` {kind}, ids array<int>")


def count_tokens(docs: DataFrame, keep: list[str], text: str = "text", path: str | None = None) -> DataFrame:
    """The columns keep and tokens, the number of ids of each text."""
    path = path or default_path()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(load_ranks(path))
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).cast(pa.string())
            for a, b in _cut(texts):
                words, per_text = words_of(texts.slice(a, b - a))
                coded = words.dictionary_encode()
                size = np.fromiter((len(encoder(w)) for w in coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
                total = np.r_[0, np.cumsum(size[coded.indices.to_numpy(zero_copy_only=False)])] if len(words) else np.zeros(1, np.int64)
                ends = np.r_[0, np.cumsum(per_text)]
                kept = [c.slice(a, b - a) for c in batch.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(total[ends[1:]] - total[ends[:-1]])], [*keep, "tokens"])

    source = docs.select(*keep, F.col(text).cast("string").alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return source.mapInArrow(work, f"{schema}{', ' if keep else ''}tokens long")


def decode(ids: list[int], path: str | None = None) -> str:
    """The text of ids, by the concatenation of their vocabulary strings."""
    strings = _strings(path or default_path())
    return b"".join(strings[i] for i in ids).decode("utf-8", errors="replace")


@lru_cache(maxsize=4)
def _strings(path: str) -> dict[int, bytes]:
    return {i: b for b, i in load_ranks(path).items()}


def decode_ids(encoded: DataFrame, ident: str = "doc_id", path: str | None = None) -> DataFrame:
    """(doc_id, text) of (doc_id, ids)."""
    path = path or default_path()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if x is None else decode(x, path) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [ident, "text"])

    kind = encoded.schema[ident].dataType.simpleString()
    return encoded.select(ident, "ids").mapInArrow(work, f"`{ident}` {kind}, text string")
