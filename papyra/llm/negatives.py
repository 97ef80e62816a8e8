"""Hard negatives: each anchor's scores are sorted whole, and read from below each positive's.

Anchors go to all rows in chunks of ``CHUNK_BYTES``, a job a chunk, so what is sent has a fixed size and rows are
never shuffled. A task sorts the scores of each anchor with the rows it holds (a tile at a time) by score and id; a first
pass keeps the anchor's positives, a second finds each positive's upper limit in the sorted scores by binary search and
reads the next entries of another label down to the lower limit. Of all tasks' entries, at most ``k`` a task, the first
count.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyra.llm._util import numbered, settle

#: Bytes of the anchors' vectors that go to tasks at a time; anchors and rows whose scores are sorted at a time.
CHUNK_BYTES, ANCHOR_TILE, ROW_TILE = 16 << 20, 512, 4096
_END, _NO_ID = np.iinfo(np.int64).max, np.iinfo(np.int64).max


def whole(x: np.ndarray) -> np.ndarray:
    """Components as whole numbers, floor(256 * x), in double precision."""
    return np.floor(256.0 * np.asarray(x, np.float64))


def scores(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products of the rows of two matrices of whole doubles; exact if they fit a long, else held at its ends."""
    with np.errstate(all="ignore"):
        s = a @ x.T
        if not s.size or not a.shape[1] or np.abs(a).max() * np.abs(x).max() * a.shape[1] < 2.0**53:
            return s.astype(np.int64)
        ints = [np.where(np.abs(m) < 2.0**63, m, 0).astype(np.int64) + np.where(m >= 2.0**63, _END, np.where(m <= -(2.0**63), -_END, 0)) for m in (a, x)]
        exact = ints[0] @ ints[1].T  # modulo 2^64, so right where the sum fits
        return np.where(s >= 2.0**63, _END, np.where(s <= -(2.0**63), -_END, exact))


def sorted_scores(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``a`` the order of the rows of ``x`` (which come by id) by score, then id, and the scores in it."""
    s = scores(a, x)
    order = np.argsort(-s, axis=1, kind="stable")
    return order, np.take_along_axis(s, order, 1)


def first(group: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Which entries are among the first ``k`` of their group by score, then id; in that order."""
    order = np.lexsort((ids, -score, group))
    g = group[order]
    start = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
    rank = np.arange(len(g)) - np.repeat(start, np.diff(np.append(start, len(g))))
    return order[rank < k]


class _Anchors:
    """A chunk of anchors by label and number of components."""

    def __init__(self, rows: list[dict]):
        self.rows, by = rows, {}
        for i, r in enumerate(rows):
            by.setdefault((r["label"], len(r["v"])), []).append(i)
        self.tiles = []
        for (label, dims), of in sorted(by.items()):
            for at in range(0, len(of), ANCHOR_TILE):
                part = np.array(of[at : at + ANCHOR_TILE])
                self.tiles.append((label, dims, part, whole([rows[i]["v"] for i in part]).reshape(len(part), dims)))
        self.place = {(r["file"], r["at"]): i for i, r in enumerate(rows)}


def _tiles(batches):
    """Rows of (file, at, vec_id, label, v) by number of components, ROW_TILE at a time, by id; a null id comes last."""
    held: list[pa.RecordBatch] = []

    def cut():
        t = pa.Table.from_batches(held).combine_chunks()
        v = t.column("v").combine_chunks()
        sizes = np.diff(v.offsets.to_numpy())
        flat, ends = v.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(sizes)])
        ids = t.column("vec_id").combine_chunks().fill_null(_NO_ID).to_numpy()
        named = ~t.column("vec_id").combine_chunks().is_null().to_numpy(zero_copy_only=False)
        label, file, at = (t.column(c).to_numpy() for c in ("label", "file", "at"))
        for dims in np.unique(sizes):
            own = np.flatnonzero(sizes == dims)
            own = own[np.lexsort((~named[own], ids[own]))]
            x = whole(flat[(ends[own][:, None] + np.arange(dims)).ravel()]).reshape(len(own), dims)
            yield int(dims), x, ids[own], label[own], list(zip(file[own].tolist(), at[own].tolist(), strict=True))

    for b in batches:
        for i in range(0, b.num_rows, ROW_TILE):
            held.append(b.slice(i, ROW_TILE))
            if sum(h.num_rows for h in held) >= ROW_TILE:
                yield from cut()
                held = []
    if held:
        yield from cut()


def _told(columns: dict) -> pa.RecordBatch:
    """Columns as a batch; the id that stands for none is null."""
    out = {c: pa.array(v, mask=v == _NO_ID) if c.endswith("_id") else pa.array(v) for c, v in columns.items()}
    return pa.RecordBatch.from_pydict(out)


def _positives(shared, k: int):
    """The first ``k`` rows of an anchor's own label, but for its own row, of those in this task."""

    def f(batches):
        anchors = shared()
        got = [np.empty(0, np.int64)] * 3
        for dims, x, ids, labels, keys in _tiles(batches):
            new = [got]
            own = {anchors.place[key]: j for j, key in enumerate(keys) if key in anchors.place}
            for label, d, of, a in anchors.tiles:
                cols = np.flatnonzero(labels == label)
                if d != dims or not len(cols):
                    continue
                order, s = sorted_scores(a, x[cols])
                for row, i in enumerate(of):
                    js = cols[order[row, : k + 1]]
                    keep = js != own.get(int(i), -1)
                    js, ss = js[keep][:k], s[row, : k + 1][keep][:k]
                    new.append([np.full(len(js), i), ss, ids[js]])
            got = [np.concatenate(c) for c in zip(*new, strict=True)]
            keep = first(*got, k)
            got = [c[keep] for c in got]
        if len(got[0]):
            key = [np.array([anchors.rows[i][c] for i in got[0]], np.int64) for c in ("file", "at")]
            yield _told({"file": key[0], "at": key[1], "score": got[1], "positive_id": got[2]})

    return f


def _negatives(shared, k: int, low: int, high: int):
    """Of each positive the first ``k`` rows of another label between its limits, of those in this task."""

    def f(batches):
        anchors = shared()
        limits = []
        for r in anchors.rows:
            p = [int(x["score"]) for x in r["positives"]]
            # a score counts if low * p <= 100 * score <= high * p
            limits.append(([-(-low * s // 100) for s in p], [high * s // 100 for s in p]))
        got = [np.empty(0, np.int64)] * 3
        for dims, x, ids, labels, _ in _tiles(batches):
            new = [got]
            for label, d, of, a in anchors.tiles:
                cols = np.flatnonzero(labels != label)
                if d != dims or not len(cols):
                    continue
                order, s = sorted_scores(a, x[cols])
                for row, i in enumerate(of):
                    lows, highs = limits[i]
                    ss = s[row]
                    down = ss[::-1]
                    for n, (lo, hi) in enumerate(zip(lows, highs, strict=True)):
                        start = len(ss) - int(np.searchsorted(down, min(hi, _END), side="right"))
                        part = ss[start : start + k]
                        m = int((part >= max(lo, -_END)).sum())
                        new.append([np.full(m, i * 1_000_000 + n), part[:m], ids[cols[order[row, start : start + m]]]])
            got = [np.concatenate(c) for c in zip(*new, strict=True)]
            keep = first(*got, k)
            got = [c[keep] for c in got]
        if len(got[0]):
            i, n = np.divmod(got[0], 1_000_000)
            rows = [anchors.rows[j] for j in i]
            own = lambda c: np.array([_NO_ID if r[c] is None else r[c] for r in rows], np.int64)
            of = [r["positives"][j] for r, j in zip(rows, n, strict=True)]
            yield _told(
                {
                    "file": own("file"),
                    "at": own("at"),
                    "anchor_id": own("vec_id"),
                    "positive_rank": n,
                    "positive_id": np.array([_NO_ID if p["positive_id"] is None else p["positive_id"] for p in of], np.int64),
                    "negative_id": got[2],
                    "positive_score": np.array([p["score"] for p in of], np.int64),
                    "negative_score": got[1],
                }
            )

    return f


def _by_chunks(rows: DataFrame, anchors: DataFrame, chunks: int, f, schema: str, name: str) -> DataFrame:
    """``f`` of each chunk of anchors over all rows, a job a chunk."""
    spark, out = rows.sparkSession, None
    for c in range(chunks):
        own = anchors.filter(F.pmod(F.xxhash64("file", "at"), F.lit(chunks)) == c).collect()  # about CHUNK_BYTES
        sent = spark.sparkContext.broadcast(cloudpickle.dumps([r.asDict(True) for r in own]))
        part = settle(rows.mapInArrow(f(lambda sent=sent: _Anchors(cloudpickle.loads(sent.value))), schema), name)
        sent.unpersist()
        out = part if out is None else out.unionByName(part)
    return out


def mine(vectors: DataFrame, label: Column, is_anchor: Column, positives: int = 5, k: int = 5, low: int = 80, high: int = 100, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: hard negatives of ``vectors`` (vec_id, embedding, ...).

    Rows for which ``is_anchor`` holds are anchors. A score is the inner product of components floor(256 * x); higher
    ones come first, ties go to the smaller vec_id. Positives are an anchor's first ``positives`` other rows of equal
    ``label``; a positive's negatives the first ``k`` rows of other labels whose score is ``low`` to ``high`` percent of its own.

    Rows with a null label, a null vector or a null or non-finite component take no part; nor has an anchor a score with
    rows of another number of components. Rows of equal vec_id are rows of their own, each an anchor, a positive and a
    negative; a null vec_id is no anchor's unless ``is_anchor`` says so and comes after all others of equal score. A
    positive without negatives has no rows. Scores beyond a long are held at its ends. An empty table gives an empty table.
    """
    keyed, row = numbered(vectors, "vectors")
    v = F.col("embedding")
    rows = keyed.select(
        F.col(row)["file"].alias("file"),
        F.col(row)["at"].alias("at"),
        F.col("vec_id").cast("long").alias("vec_id"),
        label.cast("long").alias("label"),
        v.cast("array<double>").alias("v"),
        F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"),
    ).filter("label is not null and v is not null")
    rows = rows.filter(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    anchors = settle(rows.filter("is_anchor").drop("is_anchor"), "anchors")
    size = anchors.agg(F.sum(8 * F.size("v") + 64)).first()[0] or 0
    chunks, rows = max(1, -(-size // chunk_bytes)), rows.drop("is_anchor")
    by = Window.partitionBy("file", "at").orderBy(F.desc("score"), F.asc_nulls_last("positive_id"))
    found = _by_chunks(rows, anchors, chunks, lambda shared: _positives(shared, positives), "file long, at long, score long, positive_id long", "positives")
    found = found.withColumn("n", F.row_number().over(by)).filter(F.col("n") <= positives)
    found = found.groupBy("file", "at").agg(F.array_sort(F.collect_list(F.struct("n", "score", "positive_id"))).alias("positives"))
    asked = settle(anchors.join(found, ["file", "at"]), "asked")
    schema = "file long, at long, anchor_id long, positive_rank long, positive_id long, negative_id long, positive_score long, negative_score long"
    out = _by_chunks(rows, asked, chunks, lambda shared: _negatives(shared, k, low, high), schema, "negatives")
    of = Window.partitionBy("file", "at", "positive_rank").orderBy(F.desc("negative_score"), F.asc_nulls_last("negative_id"))
    out = out.withColumn("rank", F.row_number().over(of)).filter(F.col("rank") <= k)
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
