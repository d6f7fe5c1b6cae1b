"""Problem 3: cutting oversized chunks at topic boundaries, with overlap.

Sentences and lines give the places where a cut is natural. At each of them the words
of the sentences before and after are compared; where the likeness dips below that of
its surroundings lies a topic boundary, the deeper the dip the clearer. Each piece ends
at the deepest dip that the size limit leaves in reach and the next one repeats a little
of it. Where a window holds no natural place a word boundary serves, at worst a character's.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import sqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of a piece at most, bytes repeated, and the share of the limit that a piece has at least if it can.
LIMIT, OVERLAP, LEAST = 1_500, 100, 0.4
#: Sentences on either side that are compared.
BLOCK = 3

_END = re.compile(rb"\n[\s]*|[.!?][\"')\]]*[ \t]+|\xe3\x80\x82|\xef\xbc[\x81\x9f]|</(?:p|li|h[1-6]|div|tr|table|ul|ol)>")
_WORD = re.compile(r"[぀-ヿ㐀-鿿]{2}|[^\W\d_]{4,}")


def natural_ends(b: bytes) -> list[int]:
    """Offsets just after sentences, lines and block elements, in order."""
    return [m.end() for m in _END.finditer(b) if m.end() < len(b)]


def cohesion(b: bytes, ends: list[int]) -> list[float]:
    """Cosine likeness of the word counts before and after each end, BLOCK sentences on either side."""
    edges = [0, *ends, len(b)]
    bags = [Counter(_WORD.findall(b[x:y].decode("utf-8", "ignore").lower())) for x, y in zip(edges, edges[1:], strict=False)]
    out = []
    for i in range(1, len(bags)):
        left, right = Counter(), Counter()
        for x in bags[max(0, i - BLOCK) : i]:
            left.update(x)
        for x in bags[i : i + BLOCK]:
            right.update(x)
        dot = sum(n * right[w] for w, n in left.items() if w in right)
        out.append(dot / sqrt(sum(n * n for n in left.values()) * sum(n * n for n in right.values())) if dot else 0.0)
    return out


def depths(likeness: list[float]) -> list[float]:
    """How far each value lies below the peaks that the curve climbs to on both sides."""
    n = len(likeness)
    left, right = list(likeness), list(likeness)
    for i in range(1, n):
        left[i] = max(likeness[i], left[i - 1]) if likeness[i - 1] >= likeness[i] else likeness[i]
    for i in range(n - 2, -1, -1):
        right[i] = max(likeness[i], right[i + 1]) if likeness[i + 1] >= likeness[i] else likeness[i]
    return [a + c - 2 * x for a, c, x in zip(left, right, likeness, strict=True)]


def _whole_character(b: bytes, at: int, least: int) -> int:
    """The last start of a character in (least, at], or ``at`` where there is none."""
    for i in range(at, max(least, at - 4), -1):
        if i == len(b) or b[i] & 0xC0 != 0x80:
            return i
    return at


def _word_start(b: bytes, lo: int, hi: int) -> int:
    """The last offset in (lo, hi] that follows white space, or -1."""
    return max(b.rfind(c, lo, hi) for c in (b" ", b"\n", b"\t")) + 1 or -1


def split(b: bytes, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, str]]:
    """Pieces as (start, end, what the end is at) with end - start <= limit, in order, covering ``b``.

    A piece ends at the deepest valley between LEAST of the limit and the limit, else at
    the last natural end before, else between words or characters. Each piece but the first
    starts about ``overlap`` bytes before the end of the one before. Empty input has no piece. Ends are "topic", "word", "character" or "end".
    """
    if limit < 8 or not 0 <= overlap <= limit // 3:
        raise ValueError("the overlap must be at most a third of the limit, and the limit 8 or more")
    if not b:
        return []
    if len(b) <= limit:
        return [(0, len(b), "end")]
    ends = natural_ends(b)
    dips = depths(cohesion(b, ends))
    out, start, k = [], 0, 0
    while len(b) - start > limit:
        lo, hi = start + max(2 * overlap, int(limit * LEAST)), start + limit
        while k < len(ends) and ends[k] < lo:
            k += 1
        j, best = k, -1
        while j < len(ends) and ends[j] <= hi:
            if best < 0 or dips[j] >= dips[best]:
                best = j
            j += 1
        if best >= 0:
            end, kind = ends[best], "topic"
        elif k and ends[k - 1] > start + 2 * overlap:  # none where a piece should end: the last before
            end, kind = ends[k - 1], "topic"
        elif (w := _word_start(b, lo, hi)) > lo:
            end, kind = w, "word"
        else:
            end, kind = _whole_character(b, hi, lo), "character"
        out.append((start, end, kind))
        near = _word_start(b, end - overlap * 3 // 2, end - overlap // 2) if overlap else end
        start = near if near > 0 else _whole_character(b, end - overlap, end - overlap * 2)
    return [*out, (start, len(b), "end")]


def oversized(chunks: DataFrame, documents: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Chunks whose part within the text is larger than ``limit``, with that part's bytes as _part.

    chunk_id, doc_id, label, depth, _from (offset of the part in the text), _part.
    Repeated chunk rows count once. Chunks of missing documents or null texts have no
    part; a null byte_end reaches to the end of the text, a null byte_start is 0.
    """
    start = F.greatest(F.coalesce("byte_start", F.lit(0)), F.lit(0)).cast("long")
    some = chunks.select("chunk_id", "doc_id", "label", "depth", start.alias("_from"), F.col("byte_end").cast("long").alias("_to"))
    some = some.where(F.coalesce("_to", F.lit(2**62)) - F.col("_from") > limit).dropDuplicates()
    texts = documents.where(F.octet_length("text") > limit).select("doc_id", F.col("text").cast("binary").alias("_bytes"))
    both = some.join(texts, "doc_id")
    to = F.least(F.coalesce("_to", F.lit(2**62)), F.octet_length("_bytes").cast("long"))
    both = both.where(to - F.col("_from") > limit)
    return both.select("chunk_id", "doc_id", "label", "depth", "_from", F.substring(F.col("_bytes"), (F.col("_from") + 1).cast("int"), (to - F.col("_from")).cast("int")).alias("_part"))


def split_chunks(chunks: DataFrame, documents: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """The pieces of every oversized chunk, one row each, in bytes of the document's text.

    chunk_id, doc_id, piece (from 0), n_pieces, byte_start, byte_end, boundary (what the
    piece ends at), label, depth. Chunks within the limit have no rows: they stay as they are.
    """
    whole = pa.schema([("piece", pa.int32()), ("n_pieces", pa.int32()), ("byte_start", pa.int64()), ("byte_end", pa.int64()), ("boundary", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, owner = [], []
            for r, (at, part) in enumerate(zip(b.column("_from").to_pylist(), b.column("_part").to_pylist(), strict=True)):
                pieces = split(part, limit, overlap)
                owner += [r] * len(pieces)
                rows += [{"piece": i, "n_pieces": len(pieces), "byte_start": at + x, "byte_end": at + y, "boundary": kind} for i, (x, y, kind) in enumerate(pieces)]
            made = pa.RecordBatch.from_pylist(rows, whole)
            own = pa.array(owner, pa.int64())
            keys = ["chunk_id", "doc_id", "label", "depth"]
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(own) for k in keys), *made.columns], [*keys, *whole.names])

    parts = oversized(chunks, documents, limit)
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in parts.select("chunk_id", "doc_id", "label", "depth").schema)
    return parts.mapInArrow(run, f"{types}, piece int, n_pieces int, byte_start long, byte_end long, boundary string")
