"""Language-model scores: an n-gram model by deleted interpolation.

Maximum-likelihood estimates of every order are mixed with weights that depend
on how often the context was seen; expectation-maximisation learns the weights
on the counts of a part of the training texts that is held back ("deleted")
while the estimates are made from the rest. The final model counts all training
texts.

Nothing is kept in a table that every task needs. Texts are cut into chunks;
a chunk sends its distinct n-grams, hashed to 64 bits, sorted and packed, to
hash buckets; a bucket adds up what all chunks sent and answers each with the
totals; a second pass meets the answers with the chunk's texts. One frequent
n-gram is one key per chunk, so no bucket is hot.
"""

from __future__ import annotations

import binascii
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.llm._util import WordHashes, mix64, pack, parts_for, plan_bytes, settle, small_batches, squeeze, steady, unpack, unsqueeze

KEPT, DELETED, HELD_OUT = 0, 1, 2
#: Characters of text in a chunk (a longer document makes a longer chunk).
CHUNK_CHARS = 6_000_000
#: Compressed input for which a bucket is made.
BUCKET_MB = 8
#: Context frequencies 0, 1, 2-3, 4-7, ...
CONTEXT_BUCKETS = 48
#: Cells per factor of e into which likelihoods are put for expectation-maximisation, by order; they come to the driver,
#: whole numbers of 15 bits each in one long.
EM_CELLS = {1: 6, 2: 6, 3: 2}
EM_ROUNDS = 60
#: Setting that takes the place of the number of cores where Spark splits files.
SPLITS = "spark.sql.files.minPartitionNum"

_END, _START = np.uint64(0x2545F4914F6CDD1D), np.uint64(0x9E6C63D0876A9A47)


def role_of(doc_id: int | None) -> int:
    """Held out if crc32(doc_id as text) mod 5 is 1, deleted (for the weights) if 0, else kept. A null id counts as the text ''."""
    r = binascii.crc32(b"" if doc_id is None else str(int(doc_id)).encode()) % 5
    return HELD_OUT if r == 1 else DELETED if r == 0 else KEPT


class _Tokens:
    """The tokens of a chunk's documents with ``order - 1`` start marks before each document and an end after it."""

    def __init__(self, texts: list[bytes], order: int, hashes: WordHashes):
        parts, lens = [], np.empty(len(texts), np.int64)
        head = np.full(order - 1, _START)
        for i, t in enumerate(texts):
            ws = t.lower().split()
            parts += (head, hashes.of(ws), np.array([_END]))
            lens[i] = len(ws) + order
        self.seq = np.concatenate(parts) if parts else np.empty(0, np.uint64)
        self.doc = np.repeat(np.arange(len(texts)), lens)
        self.at = np.arange(len(self.seq)) - np.repeat(np.cumsum(lens) - lens, lens)
        self.real = np.flatnonzero(self.at >= order - 1)
        self.lens = lens - order + 1

    def grams(self, j: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the j-grams that end at each position where one fits, and those positions."""
        at = np.flatnonzero(self.at >= j - 1)
        h = self.seq[at - (j - 1)]
        for i in range(1, j):
            h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + self.seq[at - (j - 1) + i])
        return h, at


def _chunks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, int, list, list[bytes]]]:
    """(chunk id, role, ids, texts). The same rows of a partition give the same chunks, whatever the batches are."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    held: dict[int, tuple[list, list[bytes]]] = {r: ([], []) for r in (KEPT, DELETED, HELD_OUT)}
    size, number = dict.fromkeys(held, 0), dict.fromkeys(held, 0)

    def out(r: int):
        ids, texts = held[r]
        held[r], size[r] = ([], []), 0
        number[r] += 1
        return (part << 26) | (r << 24) | (number[r] - 1), r, ids, texts

    for b in batches:
        for d, t in zip(b["doc_id"], b["text"], strict=True):
            d = None if pd.isna(d) else int(d)
            r = role_of(d)
            raw = (t or "").encode("utf-8", "surrogatepass")
            held[r][0].append(d)
            held[r][1].append(raw)
            size[r] += len(raw) + 8
            if size[r] >= CHUNK_CHARS:
                yield out(r)
    for r in held:
        if held[r][0]:
            yield out(r)


def _bounds(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's keys begin among sorted keys; a bucket is a range of hashes."""
    b = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    return np.searchsorted(b, np.arange(buckets + 1, dtype=np.uint64))


def _ask(order: int, buckets: int):
    def f(batches):
        hashes = WordHashes()
        for chunk, role, _, texts in _chunks(batches):
            tok = _Tokens(texts, order, hashes)
            for j in range(1, order + 1):
                keys, n = np.unique(tok.grams(j)[0], return_counts=True)
                cut = _bounds(keys, buckets)
                rows = [b for b in range(buckets) if cut[b] < cut[b + 1]]
                yield pd.DataFrame(
                    {
                        "j": j,
                        "bucket": rows,
                        "chunk": chunk,
                        "role": role,
                        "keys": [pack(keys[cut[b] : cut[b + 1]]) for b in rows],
                        "n": [pack(n[cut[b] : cut[b + 1]].astype(np.uint32)) for b in rows],
                    }
                )

    return f


def _answer(group: pd.DataFrame) -> pd.DataFrame:
    """Totals of a bucket's n-grams in all training texts and in the kept ones, for each chunk in the order it asked."""
    keys = [unpack(k, np.uint64) for k in group["keys"]]
    ends = np.cumsum([len(k) for k in keys])
    kinds, inv = np.unique(np.concatenate(keys), return_inverse=True)
    train, kept = np.zeros(len(kinds), np.int64), np.zeros(len(kinds), np.int64)
    for (a, e), role, n in zip(zip(ends - [len(k) for k in keys], ends, strict=True), group["role"], group["n"], strict=True):
        if role == HELD_OUT:
            continue
        n = unpack(n, np.uint32)
        train[inv[a:e]] += n  # a chunk's keys are distinct
        if role == KEPT:
            kept[inv[a:e]] += n
    j = int(group["j"].iloc[0])
    own = kinds != _START if j == 1 else np.ones(len(kinds), bool)
    rows = [(int(c), j, int(b), pack(train[i].astype(np.uint64)), pack(kept[i].astype(np.uint64)), None, None, None, None) for c, b, i in zip(group["chunk"], group["bucket"], np.split(inv, ends[:-1]), strict=True)]
    if j == 1:
        rows.append((-1, 1, int(group["bucket"].iloc[0]), None, None, int((train[own] > 0).sum()), int(train[own].sum()), int((kept[own] > 0).sum()), int(kept[own].sum())))
    out = pd.DataFrame(rows, columns=[c.split()[0] for c in _ANSWER.split(", ")])
    return out.astype({c: "Int64" for c in ("v", "n", "v_kept", "n_kept")})


_REQUEST = "j int, bucket int, chunk long, role int, keys binary, n binary"
_ANSWER = "chunk long, j int, bucket int, train binary, kept binary, v long, n long, v_kept long, n_kept long"
_TEXTS = "chunk long, j int, bucket int, train binary, kept binary"
_SCORE = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
_CELL = "cell long, tokens long, sums array<double>"


def _carry(batches):
    """A chunk's documents in one row; j is 0."""
    for chunk, _, ids, texts in _chunks(batches):
        meta = np.array([[-1 if d is None else 0, d or 0, len(t)] for d, t in zip(ids, texts, strict=True)], np.int64)
        yield pd.DataFrame({"chunk": [chunk], "j": 0, "bucket": 0, "train": [pack(meta.ravel())], "kept": [squeeze(b"".join(texts))]})


def _open(group: pd.DataFrame, order: int, column: str):
    """A chunk's ids, tokens and for each order the counts at every position."""
    docs = group[group["j"] == 0].iloc[0]
    meta = unpack(docs["train"], np.int64).reshape(-1, 3)
    blob, cut = unsqueeze(docs["kept"]), np.concatenate([[0], np.cumsum(meta[:, 2])])
    texts = [blob[cut[i] : cut[i + 1]] for i in range(len(meta))]
    ids = [None if a < 0 else int(b) for a, b, _ in meta]
    tok = _Tokens(texts, order, WordHashes())
    counts = []
    for j in range(1, order + 1):
        h, at = tok.grams(j)
        _, inv = np.unique(h, return_inverse=True)
        told = np.concatenate([unpack(b, np.uint64) for b in group[group["j"] == j].sort_values("bucket")[column]])
        if len(told) != (inv.max() + 1 if len(inv) else 0):
            raise ValueError("a chunk's n-grams differ from those it asked for: its rows changed between two reads")
        c = np.zeros(len(tok.seq))
        c[at] = told[inv]
        counts.append(c)
    return ids, tok, counts


def _estimates(tok: _Tokens, counts: list[np.ndarray], n: int, v: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context bucket of each token, its likelihoods (uniform, then the maximum-likelihood estimate of each order), and whether there is such an estimate."""
    at = tok.real
    p = np.empty((len(counts) + 1, len(at)))
    told = np.ones(p.shape, bool)
    p[0] = 1.0 / (v + 1)
    p[1] = counts[0][at] / max(n, 1)
    context = np.full(len(at), float(n))
    for j in range(2, len(counts) + 1):
        context = counts[j - 2][at - 1]
        p[j] = np.divide(counts[j - 1][at], context, out=np.zeros(len(at)), where=context > 0)
        told[j] = context > 0
    bucket = np.where(context > 0, 1 + np.floor(np.log2(np.maximum(context, 1))), 0).astype(np.int64)
    return np.minimum(bucket, CONTEXT_BUCKETS - 1), p, told


def _cells(order: int, n: int, v: int):
    def f(group: pd.DataFrame) -> pd.DataFrame:
        _, tok, counts = _open(group, order, "kept")
        bucket, p, _ = _estimates(tok, counts, n, v)
        with np.errstate(divide="ignore"):
            q = np.where(p > 0, np.minimum(1 - np.floor(np.log(p) * EM_CELLS.get(order, 1)), 32767), 0).astype(np.int64)
        key = bucket
        for x in q[1:4]:
            key = (key << 15) | x
        kinds, inv, many = np.unique(key, return_inverse=True, return_counts=True)
        sums = np.stack([np.bincount(inv, weights=x, minlength=len(many)) for x in p], 1)
        return pd.DataFrame({"cell": kinds, "tokens": many, "sums": list(sums)})

    return f


def learn_weights(bucket: np.ndarray, tokens: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Expectation-maximisation: mixture weights by context bucket that make the deleted tokens likeliest. ``p``: a row for each cell, a column for each estimate."""
    k = p.shape[1]
    w = np.full((CONTEXT_BUCKETS, k), 1.0 / k)
    for _ in range(EM_ROUNDS):
        r = w[bucket] * p
        r *= (tokens / np.maximum(r.sum(1), 1e-300))[:, None]
        for i in range(k):
            w[:, i] = np.bincount(bucket, weights=r[:, i], minlength=CONTEXT_BUCKETS)
        total = w.sum(1)
        seen = np.flatnonzero(total > 0)
        w[seen] /= total[seen, None]
        # a bucket without deleted tokens takes the weights of the nearest that has some
        for b in np.flatnonzero(total <= 0):
            w[b] = w[seen[np.argmin(abs(seen - b))]] if len(seen) else 1.0 / k
    return np.maximum(w, 1e-9) / np.maximum(w, 1e-9).sum(1, keepdims=True)


def _score(order: int, n: int, v: int, weights: np.ndarray):
    def f(group: pd.DataFrame) -> pd.DataFrame:
        ids, tok, counts = _open(group, order, "train")
        bucket, p, told = _estimates(tok, counts, n, v)
        c = counts[0][tok.real]
        doc = tok.doc[tok.real]
        total = lambda x: np.bincount(doc, weights=x, minlength=len(ids))
        w = weights[bucket].T * told  # after an unseen context its share goes to the shorter ones
        mixed = np.log10((w * p).sum(0) / w.sum(0))
        out = pd.DataFrame({"doc_id": pd.array(ids, "Int64"), "held_out": [role_of(d) == HELD_OUT for d in ids]})
        out["n_tokens"], out["n_known"], out["train_tokens"] = tok.lens, total(c > 0).astype(np.int64), n
        out["base_score"], out["score"] = total(np.log10((c + 0.5) / (n + 0.5 * (v + 1)))), total(mixed)
        return out

    return f


def score(docs: DataFrame, order: int = 3) -> DataFrame:
    """Score the texts of ``docs`` (doc_id, text) with a model learned from those that are not held out.

    Returns one row per row of ``docs``: doc_id, held_out, n_tokens (words, lower-cased A-Z, and one end),
    n_known (tokens seen in training), train_tokens, base_score (unigrams with 0.5 added to every count) and
    score (log10 probability by the interpolated model of the given ``order``).

    Null and empty texts are one end token. A null doc_id counts as the text '' for its fold. Repeated rows are
    scored, and counted, each. With nothing to train on, every token has probability 1 (V + 1 = 1 kinds). An
    empty table gives an empty table. Columns other than doc_id and text are ignored, whatever their names.
    """
    spark = docs.sparkSession
    if not spark.conf.get(SPLITS, None):  # else how files are split follows the cores at hand, and chunks must be the same at each read
        spark.conf.set(SPLITS, str(spark.sparkContext.defaultParallelism))
    docs = steady(small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "lm-docs")
    # shuffles are dealt to as many tasks as there are groups, so that a task's share doesn't grow with the input
    buckets = parts_for(docs, BUCKET_MB)
    # a table that is no scan of files has no known size: there the session's number of shuffle partitions holds
    known = plan_bytes(docs) < 1 << 58
    dealt = lambda df, n, *keys: df.repartition(n, *keys) if known else df
    asked = docs.mapInPandas(_ask(order, buckets), _REQUEST)
    answers = settle(dealt(asked, buckets * order, "j", "bucket").groupBy("j", "bucket").applyInPandas(_answer, _ANSWER), "lm-counts")
    n = answers.filter("chunk = -1").agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("v", "n", "v_kept", "n_kept"))).first()
    told = answers.filter("chunk >= 0").select(*(c.split()[0] for c in _TEXTS.split(", ")))
    grouped = lambda role: dealt(docs.filter(role).mapInPandas(_carry, _TEXTS).unionByName(told), buckets, "chunk").groupBy("chunk")
    # deleted chunks by the role in their ids
    deleted = docs.filter(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0)
    d_told = told.filter(F.shiftright("chunk", 24).bitwiseAND(3) == DELETED)
    cells = dealt(deleted.mapInPandas(_carry, _TEXTS).unionByName(d_told), buckets, "chunk").groupBy("chunk").applyInPandas(_cells(order, n[3], n[2]), _CELL)
    # one row for each cell of the grid that has tokens, not for each token
    rows = cells.groupBy("cell").agg(F.sum("tokens").alias("tokens"), *(F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(order + 1))).toArrow()
    bucket = rows["cell"].to_numpy().astype(np.int64) >> (15 * min(order, 3))
    tokens = rows["tokens"].to_numpy().astype(float)
    sums = np.stack([rows[f"s{i}"].to_numpy().astype(float) for i in range(order + 1)], 1)
    weights = learn_weights(bucket, tokens, sums / np.maximum(tokens, 1)[:, None])
    return grouped(F.lit(True)).applyInPandas(_score(order, n[1], n[0], weights), _SCORE)
