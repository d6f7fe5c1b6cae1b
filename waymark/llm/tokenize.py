"""Problem 8: encoding a whole corpus with a public byte-level BPE, by forced boundaries.

A byte pair that occurs inside no token of the vocabulary can never be merged over,
so the text may be cut between those two bytes and both sides encoded apart. Which
pairs those are is read off the vocabulary once. Almost every word start is such a
cut, so a batch of texts falls into few different fragments many times over: Arrow
finds the different ones, each is encoded once, and the ids are laid out again with
array arithmetic. A very long text is cut the same way, so no step is worse than
linear in its length.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

#: Folder of the public tokenizers' files and the vocabulary used by default.
TOKENIZERS = "/opt/tokenizers"
BYTE_BPE_50K = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
#: How this family of tokenizers splits text before merging (a fixed value of the vocabulary).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Bytes of text that one round of array arithmetic takes, where cuts allow.
WINDOW = 2 << 20
#: Fragments up to so many bytes are remembered, up to so many of them.
REMEMBER_BYTES, REMEMBER = 48, 400_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def forced_cuts(tokens: Iterable[bytes]) -> np.ndarray:
    """A table by (left byte * 256 + right byte): True where a text may be cut for certain.

    No token may hold the pair, and the split before merging must fall the same on
    both sides of the cut: the left byte is a visible ASCII character, so that no run
    of white space ends there, and the right one begins a character other than an
    apostrophe, at which a contraction could begin anew.
    """
    inside = np.zeros(1 << 16, dtype=bool)
    for t in tokens:
        b = np.frombuffer(t, np.uint8).astype(np.int32)
        inside[(b[:-1] << 8) | b[1:]] = True
    left, right = np.divmod(np.arange(1 << 16), 256)
    return ~inside & (left > 0x20) & (left < 0x7F) & ((right < 0x80) | (right >= 0xC0)) & (right != 0x27)


class Encoder:
    """One vocabulary with its cuts and the fragments met so far."""

    def __init__(self, path: str, pattern: str = PATTERN):
        import tiktoken

        ranks = read_ranks(path)
        self._encode = tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.cuts = forced_cuts(ranks)
        self._known: dict[bytes, list[int]] = {}

    def fragment(self, b: bytes) -> list[int]:
        ids = self._known.get(b)
        if ids is None:
            ids = self._encode(b.decode("utf-8", "replace"))
            if len(b) <= REMEMBER_BYTES:
                if len(self._known) >= REMEMBER:
                    self._known.clear()
                self._known[b] = ids
        return ids

    def _window(self, data: np.ndarray, bounds: np.ndarray, want_ids: bool) -> tuple[np.ndarray, np.ndarray]:
        """Of the fragments between ``bounds``: the number of ids of each, and all ids."""
        offsets = pa.py_buffer((bounds - bounds[0]).astype(np.int32))
        pieces = pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, offsets, pa.py_buffer(data[bounds[0] : bounds[-1]])])
        coded = pieces.dictionary_encode()
        lists = [self.fragment(b) for b in coded.dictionary.to_pylist()]
        lens = np.fromiter(map(len, lists), np.int64, len(lists))
        code = coded.indices.to_numpy()
        n = lens[code]
        if not want_ids:
            return n, np.empty(0, np.int32)
        flat = np.fromiter((i for x in lists for i in x), np.int32, int(lens.sum()))
        first = np.cumsum(lens) - lens
        at = np.cumsum(n) - n
        return n, flat[np.arange(int(n.sum())) + np.repeat(first[code] - at, n)]

    def batch(self, texts: pa.Array, want_ids: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of ids by text, and the ids of all texts one after another; null counts as empty."""
        texts = texts.cast(pa.large_binary()).fill_null(b"")
        _, offs, buf = texts.buffers()
        doc = np.frombuffer(offs, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(buf, np.uint8) if buf is not None and doc[-1] > doc[0] else np.empty(0, np.uint8)
        per_doc, ids = np.zeros(len(texts), np.int64), []
        lo, end = int(doc[0]), int(doc[-1])
        while lo < end:
            hi, size = end, WINDOW
            while lo + size < end:  # the window ends at a text or a cut; widen it where there is none
                last = int(doc[np.searchsorted(doc, lo + size, "right") - 1])
                part = data[lo : lo + size + 1]
                if last <= lo:
                    near = np.flatnonzero(self.cuts[(part[:-1].astype(np.int32) << 8) | part[1:]])
                    last = lo + int(near[-1]) + 1 if len(near) else lo
                if last > lo:
                    hi = last
                    break
                size *= 2
            part = data[lo:hi]
            cut = np.flatnonzero(self.cuts[(part[:-1].astype(np.int32) << 8) | part[1:]]) + (lo + 1)
            a, b = np.searchsorted(doc, [lo, hi], "left")
            bounds = np.unique(np.concatenate([cut, doc[a:b], [lo, hi]]))
            n, some = self._window(data, bounds, want_ids)
            owner = np.searchsorted(doc, bounds[:-1], "right") - 1
            per_doc += np.bincount(owner, weights=n, minlength=len(texts)).astype(np.int64)
            if want_ids:
                ids.append(some)
            lo = hi
        return per_doc, np.concatenate(ids) if ids else np.empty(0, np.int32)


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str = PATTERN) -> Encoder:
    return Encoder(path, pattern)


def _slices(batch: pa.RecordBatch, column: str, most: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in row ranges of about ``most`` bytes of text; a longer text is a range of its own."""
    size = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + most, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def encode(df: DataFrame, keys: Sequence[str], text: str = "text", out: str = "ids", vocabulary: str = BYTE_BPE_50K, pattern: str = PATTERN) -> DataFrame:
    """``keys`` and the token ids of each text, without special tokens, one row per row of ``df``.

    Null and empty texts give an empty list. Repeated rows stay repeated. Other
    columns, whatever their names, aren't read; ``out`` must not be one of ``keys``.
    """
    picked = df.select(*keys, F.col(text).alias("_text"))
    schema = StructType([*picked.drop("_text").schema, StructField(out, ArrayType(IntegerType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(vocabulary, pattern)
        for whole in batches:
            for b in _slices(whole, "_text"):
                n, ids = e.batch(b.column("_text"))
                offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), lists], [*keys, out])

    return picked.mapInArrow(run, schema)


def count_tokens(df: DataFrame, keys: Sequence[str], text: str = "text", out: str = "n_tokens", vocabulary: str = BYTE_BPE_50K, pattern: str = PATTERN) -> DataFrame:
    """``keys`` and the number of token ids of each text; null and empty texts have none."""
    picked = df.select(*keys, F.col(text).alias("_text"))
    schema = StructType([*picked.drop("_text").schema, StructField(out, LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(vocabulary, pattern)
        for whole in batches:
            for b in _slices(whole, "_text"):
                n, _ = e.batch(b.column("_text"), want_ids=False)
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), pa.array(n)], [*keys, out])

    return picked.mapInArrow(run, schema)
