"""Recall lanes, fusion and evidence windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papyra.functions.vectors import cosine

RRF_K = 60


def vector_lane(vectors: DataFrame, query: list[float], k: int) -> DataFrame:
    """(vec_id, score) of the k vectors nearest to a query vector; narrow until the top is known."""
    q = F.array(*(F.lit(float(x)) for x in query))
    return vectors.select("vec_id", F.round(cosine(F.col("embedding"), q), 6).alias("score")).orderBy(F.desc("score"), "vec_id").limit(k)


def ranked(lane: DataFrame, *ids: str) -> DataFrame:
    """A lane's few best rows with their ranks from 1."""
    return lane.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), *ids)))


def rrf(lanes: list[tuple[DataFrame, float]], id_: str) -> DataFrame:
    """(id, score): sum of weight / (60 + rank) over lanes that are (id, rank)."""
    parts = [lane.select(id_, (F.lit(w) / (RRF_K + F.col("rank"))).alias("s")) for lane, w in lanes]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(id_).agg(F.round(F.sum("s"), 9).alias("score"))


def neighbours(hits: DataFrame, chunks: DataFrame, radius: int = 1) -> DataFrame:
    """Chunks at most ``radius`` places from a hit in its document: the range is exploded, so the join is on equal keys."""
    at = hits.select("doc_id", F.col("idx").alias("hit_idx"), F.explode(F.sequence(F.col("idx") - radius, F.col("idx") + radius)).alias("idx"))
    return chunks.join(at, ["doc_id", "idx"])


def mmr(rows: list[tuple[int, float, list[float]]], k: int, weight: float = 0.75, floor: float = 0.6) -> list[int]:
    """Greedy maximal marginal relevance over the small candidate pool: ids in order, those too far below the best last."""
    import numpy as np

    if not rows:
        return []
    best = max(r for _, r, _ in rows)
    fit = [i for i, (_, r, _) in enumerate(rows) if r >= floor * best]
    v = np.array([x / (np.linalg.norm(x) or 1) for x in (np.array(e, float) for _, _, e in rows)])
    chosen: list[int] = []
    while fit and len(chosen) < k:
        near = lambda i: max((float(v[i] @ v[j]) for j in chosen), default=0.0)
        pick = max(fit, key=lambda i: (weight * rows[i][1] - (1 - weight) * near(i), -rows[i][0]))
        chosen.append(pick)
        fit.remove(pick)
    rest = [i for i in range(len(rows)) if i not in chosen]
    return [rows[i][0] for i in (chosen + rest)[:k]]


def without_overlap(before: str, after: str, least: int = 24) -> str:
    """``after`` without the beginning that repeats the end of ``before``, if ``least`` characters or more do.

    The longest such stretch is the border of ``after + before``, found by prefix lengths in time linear in the texts.
    """
    joined = [*after, None, *before[-len(after) :]] if after else []
    border = [0] * len(joined)
    for i in range(1, len(joined)):
        k = border[i - 1]
        while k and joined[i] != joined[k]:
            k = border[k - 1]
        border[i] = k + (joined[i] == joined[k])
    n = border[-1] if border else 0
    return after[n:] if n >= least else after
