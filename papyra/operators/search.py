"""Search as one operator: scope and filters, recall lanes, fusion, thresholds, guards, diversity, evidence."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyra.functions import questions as Q
from papyra.functions.vectors import cosine
from papyra.operators import evidence as E
from papyra.operators import lexical as Lex
from papyra.operators import retrieval as R
from papyra.operators import trigrams as T

#: The cosine a hit needs without a lexical match, and what a reranker reads of a text and of the question.
FLOOR, RERANK_TEXT, RERANK_QUERY = 0.35, 352, 128
#: Most documents a scope may name; more is an error, as a cut list would hide documents.
SCOPE = 500


@dataclass
class Library:
    """``documents``: doc_id, title, source, updated (may be null), created, status, quality. ``chunks``: doc_id, idx, heading, text. ``vectors``: doc_id, idx, model, embedding, or none.

    Words are searched on ``index``, or parts of words on ``grams`` where there are any. ``anchors``: doc_id, idx, pages,
    slides, sheets, types of the nodes that a chunk comes from; a search by structure needs them.
    """

    documents: DataFrame
    chunks: DataFrame
    index: Lex.Index | None
    vectors: DataFrame | None = None
    grams: T.Index | None = None
    anchors: DataFrame | None = None


@dataclass
class Filters:
    """What documents must be to be found; all that is given must hold."""

    title: str | None = None
    sources: list[str] | None = None
    updated_from: object = None
    updated_to: object = None
    ids: list | None = None


def in_scope(id_: Column, ids: list | None) -> Column:
    """Whether an id is among those given: None is no bound, an empty list holds none, more than ``SCOPE`` are an error."""
    if ids is None:
        return F.lit(True)
    if len(ids) > SCOPE:
        raise ValueError(f"a scope of {len(ids)} ids is over {SCOPE}")
    return id_.isin(list(ids)) if ids else F.lit(False)


def escaped(text: str) -> str:
    """A text as a LIKE pattern that means itself."""
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def allowed(documents: DataFrame, filters: Filters) -> DataFrame:
    """(doc_id) of documents that meet the filters; a document never updated counts by its creation."""
    when = F.coalesce("updated", "created")
    d = documents.filter(in_scope(F.col("doc_id"), filters.ids))
    if filters.title:
        d = d.filter(F.lower("title").like(f"%{escaped(filters.title.lower())}%"))
    if filters.sources is not None:
        d = d.filter(F.col("source").isin(filters.sources) if filters.sources else F.lit(False))
    if filters.updated_from is not None:
        d = d.filter(when >= F.lit(filters.updated_from))
    if filters.updated_to is not None:
        d = d.filter(when <= F.lit(filters.updated_to))
    return d.select("doc_id")


def structure_matches(pages: Column, sheets: Column, types: Column, want_pages: list[int] | None = None, want_sheets: list[str] | None = None, want_types: list[str] | None = None, slides: Column | None = None, want_slides: list[int] | None = None) -> Column:
    """Whether a chunk's nodes lie on one of the pages, slides, sheets and types asked for; names without regard to case."""
    low = lambda xs: F.array(*(F.lit(x.strip().lower()) for x in xs))
    names = lambda c: F.transform(c, lambda x: F.lower(F.trim(x)))
    out = F.lit(True)
    if want_pages:
        out &= F.arrays_overlap(pages, F.array(*map(F.lit, want_pages)))
    if want_slides and slides is not None:
        out &= F.arrays_overlap(slides, F.array(*map(F.lit, want_slides)))
    if want_sheets:
        out &= F.arrays_overlap(names(sheets), low(want_sheets))
    if want_types:
        out &= F.arrays_overlap(names(types), low(want_types))
    return F.coalesce(out, F.lit(False))


@dataclass
class Structure:
    """Pages, slides, sheets and types of nodes, one of each of which a hit must come from; an empty list asks for nothing."""

    pages: list[int] = field(default_factory=list)
    slides: list[int] = field(default_factory=list)
    sheets: list[str] = field(default_factory=list)
    types: list[str] = field(default_factory=list)


def structured(hits: DataFrame, anchors: DataFrame | None, want: Structure) -> DataFrame:
    """Hits whose nodes lie where ``want`` says; a chunk without nodes does nowhere."""
    if anchors is None:
        raise ValueError("this library has no anchors to filter by")
    hit = structure_matches(F.col("pages"), F.col("sheets"), F.col("types"), want.pages, want.sheets, want.types, F.col("slides"), want.slides)
    return hits.join(anchors.filter(hit).select("doc_id", "idx"), ["doc_id", "idx"], "left_semi")


def visible(hits: DataFrame, documents: DataFrame) -> DataFrame:
    """Hits whose document is still there and not being deleted when the search ends."""
    return hits.join(documents.filter(F.col("status") != "deleting").select("doc_id"), "doc_id", "left_semi")


def guarded(hits: DataFrame, documents: DataFrame) -> DataFrame:
    """Hits without those of incompletely extracted documents; ``low`` marks those of poor ones, which come last."""
    q = hits.join(documents.select("doc_id", F.coalesce("quality", F.lit("UNKNOWN")).alias("quality")), "doc_id")
    return q.filter("quality <> 'INCOMPLETE'").withColumn("low", F.col("quality") == "LOW_QUALITY").drop("quality")


def vector_hits(vectors: DataFrame, query: list[float], k: int, scope: DataFrame | None = None, model: str | None = None) -> DataFrame:
    """(doc_id, idx, score) of the k nearest chunks of a model's vectors."""
    v = vectors if model is None else vectors.filter(F.col("model") == model)
    v = v if scope is None else v.join(scope, "doc_id", "left_semi")
    q = F.array(*(F.lit(float(x)) for x in query))
    return v.select("doc_id", "idx", F.round(cosine(F.col("embedding"), q), 6).alias("score")).orderBy(F.desc("score"), "doc_id", "idx").limit(k)


def _ranked(lane: DataFrame, name: str) -> DataFrame:
    """A lane of a pool's size with ranks from 1; one small task."""
    r = F.row_number().over(Window.orderBy(F.desc("score"), "doc_id", "idx"))
    return lane.select("doc_id", "idx", F.col("score").alias(f"{name}_score"), r.alias(f"{name}_rank"))


@dataclass
class Options:
    top_k: int | None = None
    mode: str | None = None
    filters: Filters = field(default_factory=Filters)
    extras: list[str] = field(default_factory=list)
    weights: tuple[float, float] = (1.0, 1.0)
    threshold: float | None = None
    diverse: bool = False
    rerank: Callable[[str, list[str]], list[float]] | None = None
    radius: int = 1
    budget: int = E.BUDGET
    model: str | None = None
    structure: Structure | None = None


def recalled(lib: Library, texts: list[str], vector: list[float] | None, mode: str, o: Options, pool: int) -> DataFrame:
    """Candidates of all lanes and query variants: doc_id, idx, fused, lexical_rank, lexical_score, vector_rank, vector_score.

    Ranks are fused by weighted reciprocal ranks within a variant, then over the variants; a chunk keeps its best rank
    and score of each lane.
    """
    ids = allowed(lib.documents, o.filters)
    fused, told = [], None
    for text in texts:
        lanes = []
        if mode != "vector":
            words = T.lane(lib.grams, text, pool, ids) if lib.grams else Lex.lexical_lane(lib.index, lib.chunks, text, pool, ids)
            lanes.append((_ranked(words, "lexical"), o.weights[0], "lexical"))
        if mode != "lexical":
            lanes.append((_ranked(vector_hits(lib.vectors, vector, pool, ids, o.model), "vector"), o.weights[1], "vector"))
        parts = [lane.select("doc_id", "idx", (F.lit(w) / (R.RRF_K + F.col(f"{n}_rank"))).alias("s")) for lane, w, n in lanes]
        one = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        fused.append(one.groupBy("doc_id", "idx").agg(F.round(F.sum("s"), 9).alias("fused")))
        if len(lanes) == 2:
            seen = lanes[0][0].join(lanes[1][0], ["doc_id", "idx"], "full")
        else:
            other = "vector" if mode == "lexical" else "lexical"
            seen = lanes[0][0].withColumns({f"{other}_score": F.lit(None).cast("double"), f"{other}_rank": F.lit(None).cast("int")})
        seen = seen.select("doc_id", "idx", "lexical_rank", "lexical_score", "vector_rank", "vector_score")
        told = seen if told is None else told.unionByName(seen)
    if len(fused) == 1:
        hits = fused[0]
    else:
        ranks = [f.withColumn("r", F.row_number().over(Window.orderBy(F.desc("fused"), "doc_id", "idx"))).select("doc_id", "idx", (1.0 / (R.RRF_K + F.col("r"))).alias("s")) for f in fused]
        every = ranks[0]
        for r in ranks[1:]:
            every = every.unionByName(r)
        hits = every.groupBy("doc_id", "idx").agg(F.round(F.sum("s"), 9).alias("fused"))
    best = told.groupBy("doc_id", "idx").agg(F.min("lexical_rank").alias("lexical_rank"), F.max("lexical_score").alias("lexical_score"), F.min("vector_rank").alias("vector_rank"), F.max("vector_score").alias("vector_score"))
    return hits.join(best, ["doc_id", "idx"])


def search(lib: Library, question: str, vector: list[float] | None = None, options: Options | None = None) -> DataFrame:
    """Hits, best first: rank, doc_id, idx, score, relevance, and what each stage said: lexical_rank, lexical_score, vector_rank, vector_score, low, rerank_score, mode, degraded.

    Candidates of documents that are there and whose extraction isn't incomplete are ordered by fused ranks, those of
    poor extraction last. A reranker, if given, judges as many as are asked for, and only these stay, in its order.
    ``relevance`` is the reranker's score if it judged, else that of the mode: the cosine, the lexical score, or in a
    hybrid search the fused score by the best candidate's. A threshold holds for the relevance; without one a vector
    search needs ``FLOOR``. In a hybrid search a hit without a lexical match needs a cosine of ``FLOOR`` besides. A
    diverse choice is made among hits of 0.6 of the best relevance or more. ``mode`` is how was searched; where that is
    less than what was asked for, or a reranker failed, ``degraded`` says so. Pools are some dozens of rows whatever the
    library's size, so what follows recall is small.
    """
    o = options or Options()
    k, pool = Q.pool(o.top_k)
    able = lib.vectors is not None and vector is not None
    mode = Q.mode(o.mode, able) if able else "lexical"
    degraded = "no vectors" if not able and o.mode in ("hybrid", "vector") else None
    texts = Q.variants(question, o.extras)
    if mode == "vector" and not vector_hits(lib.vectors, vector, 1, allowed(lib.documents, o.filters), o.model).head(1):
        mode, degraded = "lexical", "no vectors of this model"  # another model's space answers nothing
    hits = recalled(lib, texts, vector, mode, o, pool).withColumn("best", F.max("fused").over(Window.partitionBy(F.lit(1))))
    hits = guarded(visible(hits, lib.documents), lib.documents).withColumn("rerank_score", F.lit(None).cast("double"))
    hits = hits.withColumn("place", F.row_number().over(Window.orderBy("low", F.desc("fused"), "doc_id", "idx")).cast("double"))
    if o.rerank:
        hits, failed = reranked(hits, lib.chunks, question, o.rerank, k)
        degraded = failed or degraded
    of_mode = {"vector": F.coalesce("vector_score", F.lit(0.0)), "lexical": F.coalesce("lexical_score", F.lit(0.0)), "hybrid": F.col("fused") / F.col("best")}[mode]
    hits = hits.withColumn("relevance", F.round(F.coalesce("rerank_score", of_mode), 6))
    least = o.threshold if o.threshold else FLOOR if mode == "vector" else 0.0
    if o.diverse and lib.vectors is not None and vector is not None:
        hits = diverse(hits, lib.vectors, least)
    hits = hits.filter(F.col("relevance") >= least)
    if mode == "hybrid":
        hits = hits.filter((F.coalesce("lexical_score", F.lit(0.0)) > 0) | (F.coalesce("vector_score", F.lit(0.0)) >= FLOOR))
    if o.structure is not None:
        hits = structured(hits, lib.anchors, o.structure)
    score = F.coalesce("rerank_score", F.col("fused") if mode == "hybrid" else of_mode)
    top = hits.withColumn("rank", F.row_number().over(Window.orderBy("place", "doc_id", "idx"))).filter(F.col("rank") <= k)
    return top.select(
        "rank", "doc_id", "idx", score.alias("score"), "relevance", "lexical_rank", "lexical_score", "vector_rank", "vector_score", "low", "rerank_score",
        F.lit(mode).alias("mode"), F.lit(degraded).cast("string").alias("degraded"))


def _again(hits: DataFrame, rows: pd.DataFrame) -> DataFrame:
    """Rows of a pool as a table like the one they come from; whole numbers that had become floats beside nulls are whole again."""
    whole = [f.dataType.typeName() in ("byte", "short", "integer", "long") for f in hits.schema]
    told = [tuple(None if pd.isna(v) else int(v) if w else v for v, w in zip(r, whole, strict=True)) for r in rows[hits.columns].itertuples(index=False)]
    return hits.sparkSession.createDataFrame(told, hits.schema)


def reranked(hits: DataFrame, chunks: DataFrame, question: str, score: Callable[[str, list[str]], list[float]], k: int) -> tuple[DataFrame, str | None]:
    """The first ``k`` hits by ``place`` in the order of a reranker's scores, and what went wrong: if it fails or returns anything but a score from 0 to 1 for each text, the hits stay as they were. One hit alone isn't asked about."""
    rows = hits.orderBy("place").limit(k).join(chunks.select("doc_id", "idx", "text"), ["doc_id", "idx"]).toPandas().sort_values("place")
    if len(rows) < 2:
        return hits, None
    try:
        got = [float(x) for x in score(Q.clipped(question, RERANK_QUERY), [Q.clipped(t, RERANK_TEXT) for t in rows["text"]])]
    except Exception as e:  # a provider may fail in any way; search goes on without it and says so
        return hits, f"reranker failed: {type(e).__name__}: {e}"
    if len(got) != len(rows):
        return hits, f"reranker gave {len(got)} scores for {len(rows)} texts"
    if not all(0 <= s <= 1 for s in got):
        return hits, "reranker gave scores beyond 0 to 1"
    rows["rerank_score"] = got
    rows = rows.sort_values(["rerank_score", "place"], ascending=[False, True])
    rows["place"] = [float(n) for n in range(1, len(rows) + 1)]
    return _again(hits, rows), None


def diverse(hits: DataFrame, vectors: DataFrame, least: float) -> DataFrame:
    """The hits of the pool that are near enough to the best, ``place`` by relevance and distance from those picked before."""
    rows = hits.join(vectors.select("doc_id", "idx", "embedding"), ["doc_id", "idx"], "left").toPandas().sort_values("place")  # a pool
    rows = rows[rows["relevance"] >= max(0.6 * rows["relevance"].max(), least)].reset_index(drop=True) if len(rows) else rows
    known = [e is not None for e in rows["embedding"]]
    wide = max((len(e) for e in rows["embedding"] if e is not None), default=1)
    order = R.mmr([(i, float(r), list(e) if ok else [0.0] * wide) for i, (r, e, ok) in enumerate(zip(rows["relevance"], rows["embedding"], known, strict=True))], len(rows), floor=0.0)
    rows = rows.iloc[order]
    rows["place"] = [float(n) for n in range(1, len(rows) + 1)]
    return _again(hits, rows)


def with_evidence(lib: Library, hits: DataFrame, question: str, radius: int = 1, budget: int = E.BUDGET) -> DataFrame:
    """Hits with their windows and citations."""
    w = E.windows(hits.select("doc_id", "idx"), lib.chunks, radius, budget, question)
    cite = F.concat(F.lit("[source: "), F.coalesce("title", F.col("doc_id").cast("string")), F.lit("#"), F.col("idx").cast("string"), F.lit("]"))
    return hits.join(w, ["doc_id", "idx"], "left").join(lib.documents.select("doc_id", "title"), "doc_id", "left").withColumn("citation", cite)
