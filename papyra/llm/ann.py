"""Nearest neighbours by a hierarchical k-means tree with best-bin-first search.

The top of the tree is fitted on a bounded sample. All rows are then put into its
leaves, and leaves that hold too many are split again, each by a bounded sample of
its own rows, until none is over ``LEAF_ROWS`` or the centroids reach
``TREE_BYTES``: so leaves don't grow with the table (up to that bound, which 64
float dimensions reach at some 60 million rows), and the tree that goes to every
task has a fixed size.

A query walks the tree with a priority queue of branches, nearest centroid first,
and visits leaves until it has seen as many as calibration found to be needed for
the wanted recall. Equal vectors are one entry with their smallest ids, folded
before rows are shuffled, so a group of copies costs as much as one row. Entries
and visits of a leaf are packed in blocks after they were dealt by leaf; a leaf
with very many of either is dealt over several tasks by the number of its blocks.
"""

from __future__ import annotations

import heapq
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papyra.llm._util import settle, share, sure_broadcast

#: Rows on which the top of the tree is fitted, and distinct ones of them whose true neighbours calibrate the search.
FIT_ROWS, CALIBRATE = 20_000, 256
#: Branches of a node, rows a leaf may hold, and rows of a sample needed for a leaf.
BRANCH, LEAF_ROWS, LEAF_SAMPLE = 16, 256, 24
#: Rows from which one leaf is split at a time, and the size of all centroids.
SPLIT_ROWS, TREE_BYTES = 4096, 64 << 20
#: Times that leaves are split by all rows; each makes them up to 30 times smaller.
ROUNDS = 8
RECALL = 0.97
#: Rows in a block of entries and of visits, and blocks of each that meet in one task.
BLOCK, VISITS, MEET_BLOCKS, MEET_VISITS = 512, 256, 8, 64
#: Visits a task holds, of any number of queries, before it sends them off.
HELD = 65_536


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision."""
    x = _scaled(x)
    return x / np.sqrt((x * x).sum(-1, keepdims=True))


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows divided by powers of two that bring their largest component under 1: exact, and squares can't overflow."""
    x = np.asarray(x, np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(-1, keepdims=True))[1])


def cosine(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosine of one vector with the rows of a matrix. Equal rows give equal values whatever stands around them."""
    q, x = _scaled(q), _scaled(x)
    return (x * q).sum(1) / (np.sqrt((q * q).sum()) * np.sqrt((x * x).sum(1)))


def _k_means(x: np.ndarray, branch: int, rng) -> list[np.ndarray]:
    """Rows by nearest of up to ``branch`` centroids on the unit sphere; one part if they can't be told apart."""
    seen = np.unique(x, axis=0)
    c = seen[rng.choice(len(seen), min(branch, len(seen)), replace=False)]
    for _ in range(12):
        near = (x @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        size = np.sqrt((sums * sums).sum(1, keepdims=True))
        c = np.where(size > 0, sums / np.maximum(size, 1e-300), c)
    near = (x @ c.T).argmax(1)
    return [p for p in (np.flatnonzero(near == i) for i in range(len(c))) if len(p)]


def fit(x: np.ndarray, leaf_rows: float, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(parents, centroids) of the nodes under a root, parents first; -1 is the root. Nodes of over ``leaf_rows`` rows of ``x`` are split."""
    rng, parents, cents, todo = np.random.default_rng(seed), [], [], [(-1, x)]
    for me, rows in todo:  # grows while it is walked
        if len(rows) <= leaf_rows:
            continue
        parts = _k_means(rows, min(BRANCH, max(2, int(2 * len(rows) // leaf_rows))), rng)
        if len(parts) < 2:
            continue
        for p in parts:
            parents.append(me)
            mean = rows[p].mean(0)
            cents.append(mean / max(np.sqrt((mean * mean).sum()), 1e-300))
            todo.append((len(parents) - 1, rows[p]))
    return np.array(parents, np.int32), np.array(cents, np.float32).reshape(len(parents), x.shape[1])


class Tree:
    """Nodes with a centroid each; node 0 is the root, ``leaf_of`` numbers those without children."""

    def __init__(self, dims: int):
        self.centroid, self.children = np.zeros((1, dims), np.float32), [np.empty(0, np.int64)]
        self._number()

    def _number(self) -> None:
        ends = [i for i, kids in enumerate(self.children) if not len(kids)]
        self.leaf_of, self.node_of, self.leaves = {n: i for i, n in enumerate(ends)}, ends, len(ends)

    def graft(self, grown: list[tuple[int, np.ndarray, np.ndarray]]) -> None:
        """Put subtrees (node, parents, centroids) under nodes that had no children."""
        for node, parents, cents in grown:
            at = len(self.children)
            self.children += [np.empty(0, np.int64)] * len(parents)
            for p in np.unique(parents):
                self.children[node if p < 0 else at + p] = at + np.flatnonzero(parents == p)
        self.centroid = np.concatenate([self.centroid, *(cents for _, _, cents in grown)])
        self._number()

    def place(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row: the nearest child at every level."""
        out = np.empty(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            kids = self.children[node]
            if not len(kids):
                out[rows] = self.leaf_of[node]
                continue
            near = (x[rows] @ self.centroid[kids].T).argmax(1)
            todo += [(int(kids[i]), rows[near == i]) for i in np.unique(near)]
        return out

    def best_bins(self, q: np.ndarray):
        """Leaves, best bin first: the queue holds branches by how near their centroid is."""
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            while len(kids := self.children[node]):
                near = self.centroid[kids] @ q
                best = int(near.argmax())
                for i, k in enumerate(kids):
                    if i != best:
                        heapq.heappush(queue, (-float(near[i]), int(k)))
                node = int(kids[best])
            yield self.leaf_of[node]


def _places(tree):
    """For each query and each leaf that holds one of its true neighbours, how many leaves are visited up to it; the walk ends with the last."""

    def f(batches):
        t = tree()
        for b in batches:
            out = []
            for v, leaves in zip(b["v"], b["leaves"], strict=True):
                wanted = Counter(int(x) for x in leaves)
                for n, leaf in enumerate(t.best_bins(_unit(np.asarray(v, np.float64)[None])[0]), 1):
                    out += [n] * wanted.pop(leaf, 0)
                    if not wanted:
                        break
            yield pd.DataFrame({"place": np.array(out, np.int64)})

    return f


def _matrix(column) -> np.ndarray:
    return np.stack(column.to_numpy())


def _folded(leaf: np.ndarray, ids: np.ndarray, x: np.ndarray, keep: int):
    """(leaf, smallest ids, how many, row) for each distinct row of a batch."""
    _, first, of = np.unique(x, axis=0, return_index=True, return_inverse=True)
    order = np.lexsort((ids, of.ravel()))
    ends = np.cumsum(np.bincount(of.ravel()))
    for n, own in enumerate(np.split(order, ends[:-1])):
        yield int(leaf[first[n]]), np.unique(ids[own])[:keep], len(own), x[first[n]]


def _enter(tree, keep: int):
    """Rows to entries: the leaf of each vector, equal ones of a batch as one."""

    def f(batches):
        t = tree()
        for b in batches:
            x = _matrix(b["v"])
            rows = list(_folded(t.place(_unit(x)), b["vec_id"].to_numpy(np.int64), x, keep))
            leaf, ids, n, v = zip(*rows, strict=True)
            yield pd.DataFrame({"leaf": leaf, "ids": [i.tobytes() for i in ids], "n": n, "v": [r.tobytes() for r in v]})

    return f


def _pack(keep: int):
    """Entries sorted by leaf and vector to blocks; equal vectors that follow each other become one entry."""

    def block(leaf, ids, rows, n):
        return {"leaf": leaf, "ids": np.concatenate(ids).tobytes(), "counts": np.array(list(map(len, ids)), np.int64).tobytes(), "rows": b"".join(rows), "n": n}

    def f(batches):
        leaf, ids, rows, n = -1, [], [], 0
        for b in batches:
            out = []
            for to, i, m, v in zip(b["leaf"], b["ids"], b["n"], b["v"], strict=True):
                i = np.frombuffer(i, np.int64)
                if to == leaf and rows and rows[-1] == v:
                    ids[-1], n = np.union1d(ids[-1], i)[:keep], n + m
                    continue
                if rows and (to != leaf or len(rows) == BLOCK):
                    out.append(block(leaf, ids, rows, n))
                    ids, rows, n = [], [], 0
                leaf, n = to, n + m
                ids.append(i)
                rows.append(v)
            yield pd.DataFrame(out, columns=["leaf", "ids", "counts", "rows", "n"])
        if rows:
            yield pd.DataFrame([block(leaf, ids, rows, n)])

    return f


def _shard(tree, shards: np.ndarray):
    """Queries with the shard of the leaf they lie in, so those of one shard visit much the same leaves."""

    def f(batches):
        t = tree()
        for b in batches:
            leaf, x = t.place(_unit(_matrix(b["v"]))), b["v"]
            ids = b["vec_id"].to_numpy(np.int64)
            yield pd.DataFrame({"shard": leaf + len(shards) * (ids // 50 % shards[leaf]), "vec_id": ids, "v": x})

    return f


def _visit(tree, visits: int, sizes: np.ndarray, k: int):
    def f(batches):
        t = tree()
        held: dict[int, list] = {}
        count = 0

        def out(leaf: int) -> dict:
            ids, xs = zip(*held.pop(leaf), strict=True)
            return {"leaf": leaf, "qids": np.array(ids, np.int64).tobytes(), "qrows": np.stack(xs).tobytes()}

        full: list[dict] = []
        ready = 0
        for b in batches:
            x = _matrix(b["v"])
            for i, row, q in zip(b["vec_id"], x, _unit(x), strict=True):
                seen = found = 0
                for leaf in t.best_bins(q):
                    if seen >= visits and found > k:
                        break
                    seen, found = seen + 1, found + sizes[leaf]
                    if sizes[leaf]:
                        held.setdefault(leaf, []).append((i, row))
                        count += 1
                        if len(held[leaf]) == VISITS:
                            full.append(out(leaf))
                            count, ready = count - VISITS, ready + VISITS
                    if count + ready >= HELD:  # sent off in the midst of a batch, as a batch may ask for millions of visits
                        if count >= HELD // 2:
                            full += map(out, list(held))
                            count = 0
                        yield pd.DataFrame(full, columns=["leaf", "qids", "qrows"])
                        full, ready = [], 0
        yield pd.DataFrame(full + list(map(out, list(held))), columns=["leaf", "qids", "qrows"])

    return f


def nearest_entries(qids, q, ids, counts, x, k: int) -> list[tuple]:
    """(query_id, vec_id, score) of the k nearest of the entries' ids for each query, ties to the smaller id.

    ``ids`` holds each entry's ids, smallest first, ``counts`` how many; the k + 1 nearest entries hold the k nearest ids.
    """
    near, out = _unit(q) @ _unit(x).T, []
    ends = np.cumsum(counts)
    lead = ids[ends - counts]
    for i, row in zip(range(len(qids)), near, strict=True):
        c = np.flatnonzero(row >= np.partition(row, -k - 1)[-k - 1] - 1e-9) if len(row) > k + 1 else np.arange(len(row))
        s = cosine(q[i], x[c])
        best = np.lexsort((lead[c], -s))[: k + 1]
        found = [(-s[j], int(v)) for j in best for v in ids[ends[c[j]] - counts[c[j]] : ends[c[j]]] if v != qids[i]]
        out += [(int(qids[i]), v, -float(m)) for m, v in sorted(found)[:k]]
    return out


def _block(r, dtype: str) -> tuple:
    counts = np.frombuffer(r.counts, np.int64)
    return np.frombuffer(r.ids, np.int64), counts, np.frombuffer(r.rows, dtype).reshape(len(counts), -1)


def _meet(k: int, dtype: str):
    def f(blocks: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for a in asked.itertuples():
            qids = np.frombuffer(a.qids, np.int64)
            q = np.frombuffer(a.qrows, dtype).reshape(len(qids), -1)
            for b in blocks.itertuples():
                rows += nearest_entries(qids, q, *_block(b, dtype), k)
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"])

    return f


def _brute(qids: np.ndarray, q: np.ndarray, k: int, dtype: str):
    """The nearest of a task's rows for each of a bounded set of queries, with their leaves."""

    def f(batches):
        best: dict[int, list] = {int(i): [] for i in qids}
        for b in batches:
            for r in b.itertuples():
                for i, v, s in nearest_entries(qids, q, *_block(r, dtype), k):
                    best[i].append((-s, v, r.leaf))
            best = {i: sorted(rows)[:k] for i, rows in best.items()}
        rows = [(i, v, -s, leaf) for i, found in best.items() for s, v, leaf in found]
        yield pd.DataFrame(rows, columns=["query_id", "vec_id", "score", "leaf"])

    return f


def _top(df: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _count(tree):
    def f(batches):
        t = tree()
        n = np.zeros(t.leaves, np.int64)
        for b in batches:
            n += np.bincount(t.place(_unit(_matrix(b["v"]))), minlength=len(n))
        at = np.flatnonzero(n)
        yield pd.DataFrame({"leaf": at, "n": n[at]})

    return f


def _picked(tree, portion: dict[int, float]):
    """Of the leaves to be split, rows whose vector's hash is low."""

    def f(batches):
        t = tree()
        for b in batches:
            b["leaf"] = t.place(_unit(_matrix(b["v"])))
            low = (b["h"].to_numpy(np.int64).view(np.uint64) >> np.uint64(11)).astype(np.float64) * 2.0**-53
            yield b[low < b["leaf"].map(portion).fillna(0.0).to_numpy()].drop_duplicates("h")[["leaf", "h", "v"]]

    return f


def _grown(leaf_rows: dict[int, float]):
    def f(g: pd.DataFrame) -> pd.DataFrame:
        leaf = int(g["leaf"].iloc[0])
        parents, cents = fit(_unit(_matrix(g.sort_values("h")["v"])), leaf_rows[leaf])
        return pd.DataFrame({"leaf": [leaf], "parents": [parents.tobytes()], "cents": [cents.tobytes()]})

    return f


def grow(rows: DataFrame, dims: int, sample: np.ndarray, total: int, kind: str) -> Tree:
    """A tree whose leaves hold up to ``LEAF_ROWS`` of all ``total`` rows (v, h), or more where ``TREE_BYTES`` forbids it or equal vectors can't be split."""
    tree = Tree(dims)
    leaf_rows = max(LEAF_ROWS, total * 4 * dims * 2 / TREE_BYTES)
    if len(sample):
        tree.graft([(0, *fit(_unit(sample), max(leaf_rows * min(1.0, len(sample) / total), LEAF_SAMPLE)))])
    done: set[int] = set()
    for _ in range(ROUNDS if total > len(sample) else 0):
        shared = share(rows.sparkSession, tree)
        counts = {r["leaf"]: r["n"] for r in rows.select("v").mapInPandas(_count(shared), "leaf long, n long").groupBy("leaf").agg(F.sum("n").alias("n")).collect()}
        open_ = {leaf: n for leaf, n in counts.items() if n > 2 * leaf_rows and tree.node_of[leaf] not in done}
        if not open_:
            break
        portion = {leaf: min(1.0, SPLIT_ROWS / n) for leaf, n in open_.items()}
        goal = {leaf: max(leaf_rows * portion[leaf], LEAF_SAMPLE) for leaf in open_}
        picked = rows.select("v", "h").mapInPandas(_picked(shared, portion), f"leaf long, h long, v array<{kind}>").dropDuplicates(["leaf", "h"])
        done |= {tree.node_of[leaf] for leaf in open_}
        grown = picked.groupBy("leaf").applyInPandas(_grown(goal), "leaf long, parents binary, cents binary").collect()
        nodes = [(tree.node_of[r["leaf"]], np.frombuffer(r["parents"], np.int32), np.frombuffer(r["cents"], np.float32).reshape(-1, dims)) for r in grown]
        tree.graft([n for n in sorted(nodes, key=lambda n: n[0]) if len(n[1])])
    return tree


def search(vectors: DataFrame, is_query, k: int = 5, recall: float = RECALL, fit_rows: int = FIT_ROWS, calibrate: int = CALIBRATE) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` rows nearest by cosine to each row of ``vectors`` (vec_id, embedding) for which ``is_query`` holds.

    All rows are indexed, and all are candidates but those with the query's own vec_id. Scores are cosines of the
    original vectors in double precision; ties go to the smaller vec_id. Fewer than ``k`` rows come back only if there
    are no more. Vectors that are null, zero or hold a null or non-finite component take no part, nor do null vec_ids
    and vectors of another dimension than the most frequent one. Rows of equal vec_id and vector count once; a query
    id with several vectors is asked for one of them, the one that hashes lowest. An empty table gives an empty table.
    Other columns are ignored.

    The top of the tree is fitted on about ``fit_rows`` rows (those whose vector hashes low); of their distinct
    vectors ``calibrate`` are searched by brute force to find how many leaves have to be visited for ``recall``.
    """
    spark = vectors.sparkSession
    kind = "float" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "double"
    dtype = "<f4" if kind == "float" else "<f8"
    v = F.col("embedding").cast(f"array<{kind}>")
    fine = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"), is_query.alias("is_query")).filter("vec_id is not null and v is not null").filter(fine)
    by_size = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if not by_size:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dims, total = by_size["d"], by_size["count"]
    rows = rows.filter(F.size("v") == dims).withColumn("h", F.xxhash64("v"))
    low = F.pmod("h", F.lit(1 << 31)) < F.lit(int(min(1.0, fit_rows / total) * (1 << 31)))
    sample = rows.filter(low).groupBy("h").agg(F.min("vec_id").alias("vec_id"), F.first("v").alias("v")).toPandas().sort_values("h")
    x = _matrix(sample["v"]) if len(sample) else np.empty((0, dims))
    tree = grow(rows, dims, x, total, kind)
    shared = share(spark, tree)
    entries = rows.select("vec_id", "v").mapInPandas(_enter(shared, k + 1), "leaf long, ids binary, n long, v binary")
    blocks = "leaf long, ids binary, counts binary, rows binary, n long"
    index = settle(entries.repartition("leaf").sortWithinPartitions("leaf", "v").mapInPandas(_pack(k + 1), blocks), "index")
    per_leaf = index.groupBy("leaf").agg(F.sum("n").alias("n"), F.sum(F.length("counts") / 8).cast("long").alias("entries"), F.count("*").alias("blocks"))
    sizes, shards = np.zeros(tree.leaves, np.int64), np.ones(tree.leaves, np.int64)
    for r in per_leaf.collect():  # bounded by the number of leaves
        sizes[r["leaf"]], shards[r["leaf"]] = r["entries"], -(-r["n"] // (1 << 18))
    picked = sample.iloc[:: max(1, -(-len(sample) // calibrate))]
    visits = 1
    if len(picked):
        qids, q = picked["vec_id"].to_numpy(np.int64), _matrix(picked["v"])
        truth = _top(index.mapInPandas(_brute(qids, q, k, dtype), "query_id long, vec_id long, score double, leaf long"), k)
        asked = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(qids, q, strict=True)], "query_id long, v array<double>")
        asked = truth.groupBy("query_id").agg(F.collect_list("leaf").alias("leaves")).join(asked, "query_id").repartition(32)
        needed = np.sort([r["place"] for r in asked.mapInPandas(_places(shared), "place long").collect()])  # calibrate * k numbers
        visits = int(needed[min(int(np.ceil(recall * len(needed))), len(needed)) - 1]) if len(needed) else 1
    asked = rows.filter("is_query").groupBy("vec_id").agg(F.min_by("v", "h").alias("v"))
    asked = asked.mapInPandas(_shard(shared, shards), f"shard long, vec_id long, v array<{kind}>").repartition("shard").sortWithinPartitions("shard")
    asked = settle(asked.mapInPandas(_visit(shared, visits, sizes, k), "leaf long, qids binary, qrows binary"), "visits")
    of_asked = asked.groupBy("leaf").agg(F.ceil(F.count("*") / MEET_VISITS).alias("b_parts"))
    shape = sure_broadcast(per_leaf.join(of_asked, "leaf").select("leaf", F.ceil(F.col("blocks") / MEET_BLOCKS).alias("a_parts"), "b_parts"))  # a row a leaf

    def parts(n: str):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))

    left = index.join(shape, "leaf").withColumn("a", F.pmod(F.xxhash64("ids"), "a_parts")).withColumn("b", parts("b_parts"))
    right = asked.join(shape, "leaf").withColumn("b", F.pmod(F.xxhash64("qids"), "b_parts")).withColumn("a", parts("a_parts"))
    key = ["leaf", "a", "b"]
    met = left.select(*key, "ids", "counts", "rows").groupBy(*key).cogroup(right.select(*key, "qids", "qrows").groupBy(*key)).applyInPandas(_meet(k, dtype), "query_id long, vec_id long, score double")
    return _top(met, k).select("query_id", "rank", "vec_id", "score")
