"""Many questions ranked at once: lanes, fusion and diversity as table operations, without a round of the driver for each question."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papyra.operators import lexical as Lex
from papyra.operators import retrieval as R
from papyra.sources.store import written

#: Bytes of questions' vectors that go to all tasks at a time.
SENT = 8 << 20


def nearest(vectors: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """(question, doc_id, idx, score, rank): the ``k`` nearest of (doc_id, idx, embedding) for each (question, vector), by the inner product between 0 and 1, rounded to six places.

    Questions go to all rows in chunks of ``SENT`` bytes; a task keeps ``k`` a question. A vector of another width than a
    question's is none of its; null vectors on either side take no part.
    """
    q = written(questions.filter("vector is not null").select("question", F.col("vector").cast("array<double>").alias("vector")), "questions")
    chunks = max(1, -(-(q.agg(F.sum(8 * F.size("vector"))).first()[0] or 0) // SENT))
    kind = {c: vectors.schema[c].dataType.simpleString() for c in ("doc_id", "idx")}
    schema = f"question {q.schema['question'].dataType.simpleString()}, doc_id {kind['doc_id']}, idx {kind['idx']}, score double"
    rows, out = vectors.filter("embedding is not null").select("doc_id", "idx", "embedding"), None
    for c in range(chunks):
        own = q.filter(F.pmod(F.xxhash64("question"), F.lit(chunks)) == c).collect()  # about SENT bytes
        by = {}
        for r in own:
            by.setdefault(len(r["vector"]), ([], []))[0].append(r["question"])
            by[len(r["vector"])][1].append(r["vector"])
        asked = {n: (ids, np.array(v, np.float64)) for n, (ids, v) in by.items()}

        def f(batches, asked=asked):
            for b in batches:
                size = b["embedding"].map(len).to_numpy()
                for n, (ids, a) in asked.items():
                    part = b[size == n]
                    if not len(part):
                        continue
                    # the same order of addition whatever stands beside a row
                    s = np.round(np.clip(np.einsum("qd,rd->qr", a, np.stack(part["embedding"].to_numpy()).astype(np.float64)), 0, 1), 6)
                    doc, idx = part["doc_id"].to_numpy(), part["idx"].to_numpy()
                    for one, score in zip(ids, s, strict=True):
                        top = np.lexsort((idx, doc, -score))[:k]
                        yield pd.DataFrame({"question": one, "doc_id": doc[top], "idx": idx[top], "score": score[top]})

        part = written(rows.mapInPandas(f, schema), "nearest")
        out = part if out is None else out.unionByName(part)
    w = Window.partitionBy("question").orderBy(F.desc("score"), "doc_id", "idx")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def rank(index: Lex.Index, vectors: DataFrame | None, questions: DataFrame, k: int = 4, pool: int = 12, weights: tuple[float, float] = (1.0, 1.0), diverse: bool = False) -> DataFrame:
    """(question, rank, doc_id, idx, score, lexical_rank, vector_rank) for all of (question, text, vector): the ``k`` best by weighted reciprocal ranks of ``pool`` from each lane.

    With ``diverse`` the choice among a question's pool is greedy, by fused score (by the best) and distance from what
    was chosen; a pool is twice ``pool`` rows at most, so each question's is one small group. Null vectors and vectors
    that are None leave the words alone.
    """
    lanes = [Lex.bm25_many(index, questions.select("question", "text"), pool).select("question", "doc_id", "idx", F.col("rank").alias("lexical_rank"), F.lit(None).cast("int").alias("vector_rank"))]
    if vectors is not None:
        lanes.append(nearest(vectors, questions, pool).select("question", "doc_id", "idx", F.lit(None).cast("int").alias("lexical_rank"), F.col("rank").alias("vector_rank")))
    both = lanes[0] if len(lanes) == 1 else lanes[0].unionByName(lanes[1])
    one = both.groupBy("question", "doc_id", "idx").agg(F.min("lexical_rank").alias("lexical_rank"), F.min("vector_rank").alias("vector_rank"))
    part = lambda c, w: F.coalesce(F.lit(w) / (R.RRF_K + F.col(c)), F.lit(0.0))
    fused = one.withColumn("score", F.round(part("lexical_rank", weights[0]) + part("vector_rank", weights[1]), 9))
    order = Window.partitionBy("question").orderBy(F.desc("score"), "doc_id", "idx")
    names = ["question", "rank", "doc_id", "idx", "score", "lexical_rank", "vector_rank"]
    if not diverse or vectors is None:
        return fused.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(names)
    ranked = fused.withColumn("rank", F.row_number().over(order)).join(vectors.select("doc_id", "idx", "embedding"), ["doc_id", "idx"], "left")

    def choose(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("rank").reset_index(drop=True)
        wide = max((len(e) for e in g["embedding"] if e is not None), default=1)
        best = g["score"].max()
        rows = [(i, s / best, list(e) if e is not None else [0.0] * wide) for i, (s, e) in enumerate(zip(g["score"], g["embedding"], strict=True))]
        out = g.iloc[R.mmr(rows, k)].drop(columns=["embedding"])
        out["rank"] = np.arange(1, len(out) + 1)
        return out[names]

    kinds = {f.name: f.dataType.simpleString() for f in ranked.schema}
    return ranked.groupBy("question").applyInPandas(choose, ", ".join(f"{c} {kinds[c]}" for c in names))
