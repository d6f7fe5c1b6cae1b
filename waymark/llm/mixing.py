"""Problem 9: mixing sources to target weights, in equal-token blocks.

The total is cut into blocks of equal token counts and the blocks go to the sources
by highest quotients (Sainte-Laguë: weight / (2 * blocks so far + 1)). A source's
blocks go to its shards the same way, weighted by their tokens. Within a shard the
documents stand in a seeded order, as often over as passes are needed, and fill the
shard's blocks from the front.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm.tokenize import BYTE_BPE_50K, count_tokens
from waymark.runtime import cut

#: Sources in a mixture at most: their totals are held by the driver.
MAX_SOURCES = 10_000
BLOCK_TOKENS = 1_024
#: Documents in a shard, about.
SHARD_DOCS = 50_000


def sainte_lague(weights: Sequence[float], seats: int, most: Sequence[float] | None = None) -> list[int]:
    """Seats by highest quotients weight / (2 s + 1), none beyond ``most``; equal quotients go to the first.

    A divisor found by halving gives all seats but a few, however many there are; the
    last go one by one. If every limit is reached, fewer seats than asked are given.
    """
    cap = [math.inf] * len(weights) if most is None else list(most)
    w = [max(0.0, x) if x == x else 0.0 for x in weights]
    seats = int(min(seats, sum(c for c, x in zip(cap, w, strict=True) if x > 0)))
    if seats <= 0:
        return [0] * len(w)

    def at(d: float) -> list[int]:  # the seats whose quotient is above 1 / (2 d)
        return [int(min(c, max(0, math.floor(x / d + 0.5 - 1e-9)))) if x else 0 for x, c in zip(w, cap, strict=True)]

    lo, hi = 0.0, 4 * sum(w)
    for _ in range(200):
        mid = (lo + hi) / 2
        if mid <= 0 or mid in (lo, hi):
            break
        if sum(at(mid)) > seats:
            lo = mid
        else:
            hi = mid
    got = at(hi)
    queue = [(-x / (2 * g + 1), i) for i, (x, g) in enumerate(zip(w, got, strict=True)) if x > 0 and g < cap[i]]
    heapq.heapify(queue)
    for _ in range(seats - sum(got)):
        _, i = heapq.heappop(queue)
        got[i] += 1
        if got[i] < cap[i]:
            heapq.heappush(queue, (-w[i] / (2 * got[i] + 1), i))
    return got


@dataclass(frozen=True)
class SourceQuota:
    source: str
    target_weight: float
    target_share: float
    max_repeats: int | None
    n_available: int
    quota_blocks: int


def read_targets(mix_targets: DataFrame) -> dict[str, tuple[float, int | None]]:
    """source -> (weight, repeats allowed or None for any number), checked for size.

    Repeated rows count once; of differing rows for one source the largest weight and
    the smallest limit hold. Null, negative and NaN weights are 0; rows without a source
    are left out; a null limit is no limit, one below 1 excludes the source.
    """
    rows = mix_targets.select("source", F.col("target_weight").cast("double"), F.col("max_repeats").cast("long")).distinct().limit(2 * MAX_SOURCES + 1).collect()
    if len(rows) > 2 * MAX_SOURCES:
        raise ValueError(f"a mixture may have at most {MAX_SOURCES} sources")
    out: dict[str, tuple[float, int | None]] = {}
    for s, w, r in rows:
        if s is not None:
            w = w if w is not None and 0 < w < math.inf else 0.0
            w0, r0 = out.get(s, (0.0, None))
            out[s] = (max(w, w0), r if r0 is None else r0 if r is None else min(r, r0))
    return out


def quotas(targets: dict[str, tuple[float, int | None]], available: dict[str, int], total_tokens: int | None, block_tokens: int) -> list[SourceQuota]:
    """The blocks of every source. Without ``total_tokens``: as many as the limits allow at exact shares.

    Only sources with tokens and a positive weight take part; the shares are theirs.
    With a given total that the limits forbid, the blocks that a limited source can't
    take go on to the others by their quotients, and the shares reached differ.
    """
    room = {s: math.inf if r is None else r * available.get(s, 0) for s, (_, r) in targets.items()}
    part = {s: w if available.get(s, 0) > 0 and room[s] > 0 else 0.0 for s, (w, _) in targets.items()}
    whole = sum(part.values())
    share = {s: p / whole if whole else 0.0 for s, p in part.items()}
    if total_tokens is None:
        bound = [room[s] / share[s] for s in share if share[s] > 0 and room[s] < math.inf]
        total_tokens = int(min(bound)) if bound else sum(available[s] for s in share if share[s] > 0)
    names = sorted(targets)
    blocks = sainte_lague([share[s] for s in names], total_tokens // block_tokens, [room[s] if room[s] == math.inf else room[s] // block_tokens for s in names])
    return [SourceQuota(s, targets[s][0], share[s], targets[s][1], available.get(s, 0), b) for s, b in zip(names, blocks, strict=True)]


def _shard_quota(pdf: pd.DataFrame) -> pd.DataFrame:
    """One source's blocks over its shards; a shard gets no more than its tokens times the passes allowed."""
    pdf = pdf.sort_values("shard")
    most = [math.inf if pd.isna(r) else r * n // b for r, n, b in zip(pdf.max_repeats, pdf.shard_tokens, pdf.block_tokens, strict=True)]
    return pdf[["source", "shard", "shard_tokens"]].assign(shard_blocks=sainte_lague(list(pdf.shard_tokens.astype(float)), int(pdf.quota_blocks.iloc[0]), most))


class Mixture:
    """``rows``: doc_id, source, n_tokens, copies of every chosen document; ``shares``: one row per target source.

    Documents without a source or tokens take no part. Ties in the seeded order are
    settled by doc_id. Repeated document rows count as documents of their own.
    """

    def __init__(self, documents: DataFrame, mix_targets: DataFrame, total_tokens: int | None = None, block_tokens: int = BLOCK_TOKENS, seed: int = 0, vocabulary: str = BYTE_BPE_50K):
        spark = documents.sparkSession
        targets = read_targets(mix_targets)
        wanted = [s for s, (w, _) in targets.items() if w > 0]
        counted = count_tokens(documents.where(F.col("source").isin(wanted)), ["doc_id", "source"], vocabulary=vocabulary)
        self.counted = counted = cut(counted.where("n_tokens > 0"))
        sums = {r[0]: (r[1], r[2]) for r in counted.groupBy("source").agg(F.sum("n_tokens"), F.count("*")).collect()}  # a row per target source
        self.plan = quotas(targets, {s: n for s, (n, _) in sums.items()}, total_tokens, block_tokens)
        self.block_tokens = block_tokens
        plan = [(q.source, max(1, math.ceil(sums.get(q.source, (0, 0))[1] / SHARD_DOCS)), q.quota_blocks, q.max_repeats) for q in self.plan]
        by_source = F.broadcast(spark.createDataFrame(plan, "source string, n_shards long, quota_blocks long, max_repeats long"))  # MAX_SOURCES rows at most
        placed = counted.join(by_source, "source").where("quota_blocks > 0")
        placed = placed.withColumn("_order", F.xxhash64("doc_id", F.lit(seed))).withColumn("shard", F.pmod(F.xxhash64("_order"), F.col("n_shards")))
        shards = placed.groupBy("source", "shard").agg(F.sum("n_tokens").alias("shard_tokens"), F.first("quota_blocks").alias("quota_blocks"), F.first("max_repeats").cast("double").alias("max_repeats"))
        shards = shards.withColumn("block_tokens", F.lit(block_tokens).cast("long"))
        quota = shards.groupBy("source").applyInPandas(_shard_quota, "source string, shard long, shard_tokens long, shard_blocks long")
        before = F.sum("n_tokens").over(Window.partitionBy("source", "shard").orderBy("_order", "doc_id").rowsBetween(Window.unboundedPreceding, -1))
        docs = placed.withColumn("_before", F.coalesce(before, F.lit(0))).join(quota, ["source", "shard"])
        fill = F.col("shard_blocks") * block_tokens
        passes = F.floor(fill / F.col("shard_tokens"))
        copies = (passes + F.when(F.col("_before") < fill - passes * F.col("shard_tokens"), 1).otherwise(0)).cast("int")
        limited = F.least(copies, F.coalesce(F.col("max_repeats"), F.lit(2**31 - 1)).cast("int"))
        self.rows = docs.select("doc_id", "source", "n_tokens", limited.alias("copies")).where("copies > 0")

    def shares(self) -> DataFrame:
        """Per target source: its target share, quota and what was reached, in tokens, share and repeats."""
        spark = self.counted.sparkSession
        plan = spark.createDataFrame([(q.source, q.target_weight, q.target_share, q.max_repeats, q.n_available, q.quota_blocks) for q in self.plan], "source string, target_weight double, target_share double, max_repeats long, n_available long, quota_blocks long")
        taken = self.rows.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("n_taken"), F.max("copies").alias("most_copies"))
        out = plan.join(taken, "source", "left").fillna(0, ["n_taken", "most_copies"])
        total = F.sum("n_taken").over(Window.partitionBy(F.lit(0)))  # over one row per target source
        return out.withColumn("actual_share", F.when(total > 0, F.col("n_taken") / total).otherwise(0.0)).withColumn("repeats", F.when(F.col("n_available") > 0, F.col("n_taken") / F.col("n_available")).otherwise(0.0))

    def copied(self) -> DataFrame:
        """``rows`` with every copy as a row of its own: doc_id, source, n_tokens, copy (from 1)."""
        return self.rows.select("doc_id", "source", "n_tokens", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
