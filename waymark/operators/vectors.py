"""Vectors: exact and approximate nearest neighbours, upserts, reranking and the staged query.

Scoring runs on Arrow batches as matrix products. A block of queries of bounded size is
shared with all tasks; each task keeps its best k per query, so what is shuffled is
k rows per query and task, whatever the number of vectors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.operators.incremental import newest_per_key

#: Queries in a block, sample rows and least cells of the approximate index, the recall its probes are chosen for.
BLOCK, SAMPLE, CELLS, RECALL = 2_048, 20_000, 64, 0.97


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays over their common length, 0 if either has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: F.coalesce(p.cast("double") * q.cast("double"), F.lit(0.0))), F.lit(0.0), lambda s, v: s + v)
    n = F.least(F.size(a), F.size(b))
    x, y = F.slice(a, 1, n), F.slice(b, 1, n)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(x, y) / norm).otherwise(0.0)


def _matrix(vectors: Sequence) -> np.ndarray:
    """Rows of equal length (shorter ones filled with zeros), scaled to length 1 where they have any."""
    width = max((len(v) for v in vectors), default=0)
    m = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        m[i, : len(v)] = v
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each row of scores the columns of its k best, ties to smaller ids."""
    for q, row in enumerate(scores):
        live = np.flatnonzero(~np.isnan(row))
        if len(live) > 4 * k:
            floor = np.partition(row[live], len(live) - k)[len(live) - k]
            live = live[row[live] >= floor]
        yield q, live[np.lexsort((ids[live], -row[live]))[:k]]


class _Held:
    """The best k of every query of a block among the vectors that a task has seen so far."""

    def __init__(self, qids: np.ndarray, k: int):
        self.qids, self.k = qids, k
        self.best: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0))] * len(qids)

    def add(self, which: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """scores: a row for each query in ``which``, a column for each id; nan is no candidate."""
        for row, best in _best(scores, ids, self.k):
            i, s = self.best[which[row]]
            i, s = np.concatenate([i, ids[best]]), np.concatenate([s, scores[row, best]])
            top = np.lexsort((i, -s))[: self.k]
            self.best[which[row]] = (i[top], s[top])

    def rows(self) -> pd.DataFrame:
        n = [len(i) for i, _ in self.best]
        return pd.DataFrame({"query_id": np.repeat(self.qids, n).astype("int64"), "id": np.concatenate([i for i, _ in self.best]).astype("int64"), "score": np.concatenate([s for _, s in self.best]).astype("float64")})


def _scores(queries: np.ndarray, m: np.ndarray) -> np.ndarray:
    w = max(m.shape[1], queries.shape[1])
    return np.pad(queries, ((0, 0), (0, w - queries.shape[1]))) @ np.pad(m, ((0, 0), (0, w - m.shape[1]))).T


def _score_block(qids: np.ndarray, queries: np.ndarray, k: int, skip_self: bool, near: np.ndarray | None = None):
    """Score batches of vectors against a block of queries; with ``near``, the cells of each query, only against those that look into a vector's cell."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = _Held(qids, k)
        for pdf in batches:
            for cell, part in [(None, pdf)] if near is None else pdf.groupby("cell"):
                which = np.arange(len(qids)) if near is None else np.flatnonzero((near == cell).any(1))
                if not len(which) or not len(part):
                    continue
                ids = part.id.to_numpy()
                scores = _scores(queries[which], _matrix(part.embedding.tolist()))
                if skip_self:
                    scores[qids[which][:, None] == ids[None, :]] = np.nan
                held.add(which, ids, scores)
        if len(qids):
            yield held.rows()

    return run


def _top(scored: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def nearest(vectors: DataFrame, query: Sequence[float], k: int = 10, candidates: DataFrame | None = None) -> DataFrame:
    """id, score of the k vectors (id, embedding) nearest to one query, highest first, ties by id.

    ``candidates`` (id) filters before anything is scored. Null embeddings aren't candidates.
    """
    v = vectors.where("id IS NOT NULL AND embedding IS NOT NULL")
    if candidates is not None:
        v = v.join(candidates.select("id").distinct(), "id", "left_semi")
    scored = v.select("id", "embedding").mapInPandas(_score_block(np.array([0]), _matrix([list(query)]), k, False), "query_id long, id long, score double")
    return scored.orderBy(F.desc("score"), "id").limit(k).select("id", "score")


def _blocks(queries: DataFrame, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The queries (id, embedding) on the driver, block after block; never more than one block at once."""
    block: list = []
    for r in queries.select("id", "embedding").where("id IS NOT NULL AND embedding IS NOT NULL").toLocalIterator():
        block.append(r)
        if len(block) == size:
            yield np.array([x[0] for x in block]), _matrix([x[1] for x in block])
            block = []
    if block:
        yield np.array([x[0] for x in block]), _matrix([x[1] for x in block])


def nearest_for_all(vectors: DataFrame, queries: DataFrame, k: int = 10, skip_self: bool = True, block: int = BLOCK, candidates: DataFrame | None = None) -> DataFrame:
    """query_id, id, score, rank of the k nearest vectors of every query, exactly, in blocks of queries.

    ``candidates`` (id) filters before anything is scored.
    """
    out, v = None, vectors.where("id IS NOT NULL AND embedding IS NOT NULL").select("id", "embedding")
    if candidates is not None:
        v = v.join(candidates.select("id").distinct(), "id", "left_semi")
    for qids, q in _blocks(queries, block):
        scored = v.mapInPandas(_score_block(qids, q, k, skip_self), "query_id long, id long, score double")
        out = scored if out is None else out.unionByName(scored)
    if out is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, id long, score double, rank int")
    return _top(out, k)


class CellIndex:
    """An inverted-file index: vectors by their nearest centre; a query looks into its nearest cells.

    There are as many cells as the square root of the vectors, CELLS at least and an eighth
    of the sample at most, so that a cell grows no faster than their number. The centres are
    fitted by k-means on at most SAMPLE rows; every vector is assigned.
    How many cells a query looks into is measured on the sample: as few as reach RECALL
    against the exact neighbours there.
    """

    def __init__(self, vectors: DataFrame, cells: int | None = None, sample: int = SAMPLE, seed: int = 0, rounds: int = 12):
        some = vectors.where("id IS NOT NULL AND embedding IS NOT NULL").orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(sample).select("embedding").toPandas()
        m = _matrix(some.embedding.tolist())
        cells = cells or max(CELLS, min(int(vectors.count() ** 0.5), sample // 8))
        rng = np.random.RandomState(seed)
        self.centres = m[rng.permutation(len(m))[: min(cells, len(m))]]
        for _ in range(rounds):
            own = (m @ self.centres.T).argmax(1)
            sums = np.zeros_like(self.centres)
            np.add.at(sums, own, m)
            norm = np.linalg.norm(sums, axis=1, keepdims=True)
            self.centres = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), self.centres)
        self.sample, self.probes = m, self._probes(m)
        centres = self.centres

        def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield pdf.assign(cell=(_matrix(pdf.embedding.tolist()) @ centres.T).argmax(1).astype("int32") if len(pdf) else pd.Series(dtype="int32"))

        self.rows = vectors.where("id IS NOT NULL AND embedding IS NOT NULL").select("id", "embedding").mapInPandas(assign, "id long, embedding array<float>, cell int")

    def _probes(self, m: np.ndarray, k: int = 10, queries: int = 256) -> int:
        """The least number of cells that hold RECALL of the sample rows' k nearest rows."""
        own, q = (m @ self.centres.T).argmax(1), m[:queries]
        scores = q @ m.T
        np.fill_diagonal(scores, -2)
        near = np.argsort(-scores, 1)[:, :k]
        place = np.argsort(np.argsort(-(q @ self.centres.T), 1), 1)
        ranks = np.sort(np.take_along_axis(place, own[near], 1).ravel())
        return int(ranks[min(len(ranks) - 1, int(np.ceil(RECALL * len(ranks))))]) + 1 if len(ranks) else 1

    def search(self, queries: DataFrame, k: int = 10, probes: int | None = None, skip_self: bool = True, candidates: DataFrame | None = None) -> DataFrame:
        """query_id, id, score, rank; only vectors in the query's ``probes`` nearest cells, and only ``candidates`` (id) if given, are scored.

        Among candidates the nearest lie farther off, so cells are chosen as for as many
        neighbours more as there are vectors to a candidate.
        """
        rows, wider = self.rows, 1.0
        if candidates is not None:
            own = candidates.select("id").distinct()
            rows, wider = rows.join(own, "id", "left_semi"), self.rows.count() / max(1, own.count())
        if probes is None:
            probes = self._probes(self.sample, int(np.ceil(max(k, 10) * wider)))
        out = None
        for qids, q in _blocks(queries, BLOCK):
            near = np.argsort(-(q @ self.centres.T), 1)[:, :probes]
            found = rows.where(F.col("cell").isin([int(c) for c in np.unique(near)])).mapInPandas(_score_block(qids, q, k, skip_self, near), "query_id long, id long, score double")
            out = found if out is None else out.unionByName(found)
        return _top(out, k) if out is not None else self.rows.sparkSession.createDataFrame([], "query_id long, id long, score double, rank int")


def upsert(vectors: DataFrame, new: DataFrame) -> DataFrame:
    """Vectors with those of ``new`` in place of or beside the old; of several new ones of an id the greatest array."""
    last = newest_per_key(new, ["id"], [F.col("embedding")], ["embedding"])
    return vectors.join(last.select("id"), "id", "left_anti").unionByName(last.select(*vectors.columns))


def delete(vectors: DataFrame, ids: DataFrame) -> DataFrame:
    return vectors.join(ids.select("id").distinct(), "id", "left_anti")


def hashing_embedder(dimension: int = 64) -> Callable[[list[str]], np.ndarray]:
    """A deterministic embedder without a model: signed hashes of words, scaled to length 1."""
    import xxhash

    def embed(texts: list[str]) -> np.ndarray:
        m = np.zeros((len(texts), dimension))
        for i, t in enumerate(texts):
            for w in (t or "").lower().split():
                h = xxhash.xxh64_intdigest(w.encode())
                m[i, h % dimension] += 1 if h >> 63 else -1
        norm = np.linalg.norm(m, axis=1, keepdims=True)
        return np.divide(m, norm, out=m, where=norm > 0)

    return embed


def embed_texts(texts: DataFrame, embedder: Callable[[list[str]], np.ndarray], text: str = "text") -> DataFrame:
    """id, embedding of every non-null text; the embedder gets lists of texts and gives a matrix."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "embedding": [list(map(float, v)) for v in embedder(list(pdf[text]))] if len(pdf) else []})

    return texts.where(F.col(text).isNotNull()).select("id", text).mapInPandas(run, "id long, embedding array<float>")


def rerank(scored: DataFrame, texts: DataFrame, query: str, scorer: Callable[[str, list[str]], Sequence[float]]) -> DataFrame:
    """``scored`` (id, score) with scores of ``scorer`` in place of its own; ids without a text drop out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[["id"]].assign(score=np.asarray(scorer(query, list(pdf.text)), dtype=float) if len(pdf) else pd.Series(dtype=float))

    return scored.select("id").join(texts.where("text IS NOT NULL").select("id", "text"), "id").mapInPandas(run, "id long, score double").orderBy(F.desc("score"), "id")
