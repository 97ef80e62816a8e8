"""Near-duplicate texts: ProbMinHash signatures, banding, exact verification, components.

ProbMinHash gives each weighted shingle a Poisson process of arrivals whose
rate is its weight; every arrival falls into a random register, and a register
keeps the element that arrives there first. Two texts agree in a register with
the probability Jaccard similarity of their weighted shingles. A text's arrivals
are made in rounds for all its shingles at once and stop for a shingle when its
next arrival is later than all registers' first ones. A shingle weighs as often as
it occurs in the text, and a link is defined and verified by the probability Jaccard
similarity of the same weights, so texts agree in a register with the very
similarity that is verified.

Registers are cut into bands; texts that agree in a whole band are candidates.
Candidates are compared by their exact weighted shingles, first with the leader of
each bucket, so a bucket of thousands of near copies costs a comparison each and
not one per pair. Where buckets connect texts that are still in different
components, the rest is done in blocks, bounded in texts and bytes. A text of
which too small a part of the weight is on shingles of any other text of its cluster
has no partner and takes no part. A task takes two blocks, passes over pairs that
can't be similar enough (by that part, and by the weight that both put on the same
shingles, which is never less than the similarity), and yields one link for each two components
that it finds linked. So no link between different components is lost, no list of
pairs is made, and a large group is spread over many tasks.

Components come from contracting edges towards
smaller ids; each round is written to the shared folder.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.llm._util import WordHashes, cut, join_counted, mix64, numbered, sent_if_small, shingle_hashes, small_batches, words, worker_cache

SIMILARITY = 0.8
WIDTH = 5
BANDS, ROWS = 32, 5
#: Bytes of a node's id in a table that is sent to every task.
NODE_BYTES = 16
#: Texts, and bytes of shingles, in a block of those that are compared at the end.
BLOCK, BLOCK_BYTES = 256, 4 << 20


def _uniform(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def prob_minhash(element: np.ndarray, doc: np.ndarray, weight: np.ndarray, docs: int, registers: int) -> np.ndarray:
    """Signatures (docs x registers) of weighted 64-bit elements; ``doc`` says whose each is. A text without elements has zeros."""
    first = np.full(docs * registers, np.inf)
    kept = np.zeros(docs * registers, np.uint64)
    time, step = np.zeros(len(element)), 0
    e, d, w = element, doc, weight
    while len(e):
        step += 1
        with np.errstate(over="ignore"):
            r = mix64(e + np.uint64(step) * np.uint64(0x9E3779B97F4A7C15))
            slot = d * registers + (mix64(r ^ np.uint64(0xD6E8FEB86659FD93)) % np.uint64(registers)).astype(np.int64)
        time = time - np.log(_uniform(r)) / w
        better = np.flatnonzero(time < first[slot])
        better = better[np.argsort(-time[better], kind="stable")]  # of several in a register the earliest is written last
        first[slot[better]], kept[slot[better]] = time[better], e[better]
        on = time < first.reshape(docs, registers).max(1)[d]
        e, d, w, time = e[on], d[on], w[on], time[on]
    return kept.reshape(docs, registers)


#: What rounding may take from a similarity.
NOISE = 1e-9


def prob_jaccard(x: np.ndarray, a: np.ndarray, y: np.ndarray, b: np.ndarray) -> float:
    """The probability Jaccard similarity of two weighted sets, sum over i of 1 / sum over j of max(a_j / a_i, b_j / b_i); elements are distinct, weights positive."""
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    ca, cb = a[i].astype(np.float64), b[j].astype(np.float64)
    order = np.argsort(ca / cb)
    ca, cb = ca[order], cb[order]
    # elements of a larger ratio of weights count by a, the others by b
    above = a.sum() - np.cumsum(ca)
    below = b.sum() - cb.sum() + np.cumsum(cb)
    return float((ca / (above + ca / cb * below)).sum())


def _weighted(texts, hashes: WordHashes, width: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct shingles of each text, and how often each occurs in it."""
    return [np.unique(shingle_hashes(hashes.of(words(t)), width), return_counts=True) for t in texts]


def _unpacked(shingles: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(shingles, np.uint64), np.frombuffer(counts, np.uint32)


def _signatures(width: int, bands: int, rows: int):
    def f(batches):
        worker_cache().clear()  # what another operator has left in this worker
        hashes = WordHashes()
        salt = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        for big in batches:
            for at in range(0, len(big), 500):
                b = big.iloc[at : at + 500]
                sets = _weighted(b["text"], hashes, width)
                n = np.array([len(s) for s, _ in sets])
                weights = np.concatenate([w for _, w in sets]).astype(np.float64)
                sig = prob_minhash(np.concatenate([s for s, _ in sets]), np.repeat(np.arange(len(b)), n), weights, len(b), bands * rows)
                key = np.zeros((len(b), bands), np.uint64) + salt
                for i in range(rows):
                    key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + sig.reshape(len(b), bands, rows)[:, :, i])
                yield pd.DataFrame({"node": b["node"], "bands": list(key.view(np.int64))})[n > 0]

    return f


def _packed(width: int):
    def f(batches):
        hashes = WordHashes()
        for b in batches:
            sets = _weighted(b["text"], hashes, width)
            yield pd.DataFrame({"node": b["node"], "shingles": [s.tobytes() for s, _ in sets], "counts": [w.astype(np.uint32).tobytes() for _, w in sets]})

    return f


def _exploded(batches):
    """Each shingle of a text with its part of the text's weight."""
    for b in batches:
        sets = [_unpacked(x, c) for x, c in zip(b["shingles"], b["counts"], strict=True)]
        n = [len(x) for x, _ in sets]
        mass = np.concatenate([c / c.sum() for _, c in sets])
        yield pd.DataFrame({"cluster": np.repeat(b["cluster"].to_numpy(), n), "node": np.repeat(b["node"].to_numpy(), n), "shingle": np.concatenate([x for x, _ in sets]).view(np.int64), "mass": mass})


def _blocks(least: float):
    """Links between the texts of two blocks of a cluster (or inside one) that are in different components."""

    def f(g: pd.DataFrame) -> pd.DataFrame:
        if g["i"].iloc[0] == g["j"].iloc[0]:
            a = b = g
        else:
            a, b = g[g["part"] == g["i"]], g[g["part"] == g["j"]]
        return _across(a, b, least)

    return f


def _across(a: pd.DataFrame, b: pd.DataFrame, least: float) -> pd.DataFrame:
    sets = [_unpacked(x, c) for x, c in zip(b["shingles"], b["counts"], strict=True)]
    ob, cb, vb = b["own"].to_numpy(), b["comp"].to_numpy(), b["node"].to_numpy()
    key = np.concatenate([np.empty(0, np.uint64), *(x for x, _ in sets)])
    order = np.argsort(key)
    key, holder = key[order], np.repeat(np.arange(len(sets)), [len(x) for x, _ in sets])[order]
    mass = np.concatenate([np.empty(0), *(c / c.sum() for _, c in sets)])[order]
    out = {}
    for raw, counts, oa, ca, va in zip(a["shingles"], a["counts"], a["own"], a["comp"], a["node"], strict=True):
        x, c = _unpacked(raw, counts)
        # both put no more weight on the same shingles than either does on any that others of the cluster have
        open_ = (cb != ca) & (vb > va if a is b else True) & (np.minimum(1 - oa, 1 - ob) >= least - NOISE)
        if not open_.any():
            continue
        lo, hi = np.searchsorted(key, x, "left"), np.searchsorted(key, x, "right")
        n = hi - lo
        at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
        both = np.bincount(holder[at], weights=np.minimum(np.repeat(c / c.sum(), n), mass[at]), minlength=len(sets))
        for i in np.flatnonzero(open_ & (both >= least - NOISE)):
            pair = (min(ca, cb[i]), max(ca, cb[i]))
            if pair not in out and prob_jaccard(x, c, *sets[i]) >= least - NOISE:
                out[pair] = (va, vb[i])
    return pd.DataFrame(list(out.values()), columns=["a", "b"], dtype=np.int64)


def _linked(least: float):
    def f(batches):
        for b in batches:
            pairs = zip(b["sa"], b["ca"], b["sb"], b["cb"], strict=True)
            keep = [prob_jaccard(*_unpacked(x, c), *_unpacked(y, d)) >= least - NOISE for x, c, y, d in pairs]
            yield b.loc[keep, ["a", "b"]]

    return f


def components(links: DataFrame) -> DataFrame:
    """(node, comp): the smallest node id that each end of a link (a, b) is connected with.

    Each round sends a node to its smallest neighbour's smallest neighbour and contracts the edges, so their number
    falls from round to round.
    """
    edges = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = None
    while True:
        low = cut(edges.groupBy("a").agg(F.min(F.least("a", "b")).alias("up")), "low")
        step = low.join(low.select(F.col("a").alias("up"), F.col("up").alias("comp")), "up").select(F.col("a").alias("node"), "comp")
        step = cut(step, "step")
        if labels is None:
            labels = step
        else:
            moved = step.select(F.col("node").alias("comp"), F.col("comp").alias("to"))
            labels = cut(labels.join(moved, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp")), "labels")
        left = edges.join(step.select(F.col("node").alias("a"), F.col("comp").alias("x")), "a").join(step.select(F.col("node").alias("b"), F.col("comp").alias("y")), "b")
        edges = cut(left.filter("x != y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "edges")
        if edges.isEmpty():
            return labels


def classes_of(nodes: DataFrame, similarity: float = SIMILARITY, width: int = WIDTH, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(node, comp) for the nodes of (node, text) whose text is similar to another's; equal nodes have equal texts."""
    sigs = nodes.mapInPandas(_signatures(width, bands, rows), "node long, bands array<long>").groupBy("node").agg(F.first("bands").alias("bands"))
    sigs = cut(sigs, "signatures")
    keyed = sigs.select("node", F.explode("bands").alias("band"))
    leads = cut(keyed.groupBy("band").agg(F.min("node").alias("lead"), F.count("*").alias("k")).filter("k > 1"), "leads")
    buckets = cut(join_counted(keyed, leads, ["band"], "k"), "buckets")
    inside = sent_if_small(cut(buckets.select("node").distinct(), "inside"), NODE_BYTES)
    packed = nodes.join(inside, "node", "left_semi").mapInPandas(_packed(width), "node long, shingles binary, counts binary")
    packed = cut(packed.groupBy("node").agg(F.first("shingles").alias("shingles"), F.first("counts").alias("counts")), "shingles")

    def verify(pairs: DataFrame) -> DataFrame:
        first = pairs.join(packed.select(F.col("node").alias("b"), F.col("shingles").alias("sb"), F.col("counts").alias("cb")), "b")
        return cut(first.join(packed.select(F.col("node").alias("a"), F.col("shingles").alias("sa"), F.col("counts").alias("ca")), "a").mapInPandas(_linked(similarity), "a long, b long"), "links")

    pair = (F.least("node", "lead").alias("a"), F.greatest("node", "lead").alias("b"))
    tried = cut(buckets.filter("node != lead").select(*pair).distinct(), "pairs")
    links = verify(tried)
    comps = components(links)
    # nodes that any chain of buckets connects; a link can only be inside such a cluster
    clusters = components(buckets.filter("node != lead").select(F.col("node").alias("a"), F.col("lead").alias("b")))
    now = clusters.withColumnRenamed("comp", "cluster").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    now = cut(now, "now")
    open_ = cut(now.groupBy("cluster").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("k")).filter("lo != hi").select("cluster", "k"), "open")
    x = cut(join_counted(now, open_, ["cluster"], "k").join(packed, "node"), "open-texts")
    exploded = x.select("cluster", "node", "shingles", "counts").mapInPandas(_exploded, "cluster long, node long, shingle long, mass double")
    alone = exploded.groupBy("cluster", "shingle").agg(F.count("*").alias("k"), F.min("node").alias("node"), F.min("mass").alias("mass")).filter("k = 1")
    x = x.join(alone.groupBy("node").agg(F.sum("mass").alias("own")), "node", "left").withColumn("own", F.coalesce("own", F.lit(0.0)))
    x = cut(x.filter(1 - F.col("own") >= similarity - NOISE), "partners")
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum(F.length("shingles") + F.length("counts")) / BLOCK_BYTES))
    blocks = cut(x.groupBy("cluster").agg(F.count("*").alias("k"), blocks.alias("parts")), "blocks")
    x = join_counted(x, blocks, ["cluster"], "k")
    x = x.select("cluster", "parts", F.pmod(F.xxhash64("node"), F.col("parts")).alias("part"), "node", "comp", "own", "shingles", "counts")
    x = x.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    x = x.withColumns({"i": F.least("part", "other"), "j": F.greatest("part", "other")})
    more = x.groupBy("cluster", "i", "j").applyInPandas(_blocks(similarity), "a long, b long")
    return components(links.unionByName(cut(more, "links")))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, width: int = WIDTH, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, class_id, class_rows, stays.

    Texts are in one class if a chain of texts connects them, each similar to the next: exactly equal, or a probability
    Jaccard similarity of ``similarity`` or more of their ``width``-word shingles, each weighed by how often it occurs. Words are runs of anything but ASCII
    white space, compared as they are. A shorter text is one shingle of all its words. Null, empty and blank texts have
    no words and are each a class of their own. class_id is the smallest doc_id of the class (null if it has no id);
    class_rows counts its rows; stays is true for one row of each class, the one with the smallest id, then text hash;
    of equal rows any. Texts are told apart by 128 bits. Columns other than doc_id and text are ignored. An empty table
    gives an empty table.
    """
    return _classes(docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row")), similarity, width, bands, rows).drop("row")


def drop_near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` (doc_id, text, ...) with one row of each class of near duplicates, columns as they are."""
    docs, row = numbered(docs, "neardup-docs")
    gone = _classes(docs.select("doc_id", "text", F.col(row).alias("row")), similarity).filter("not stays")
    gone = sent_if_small(cut(gone.select(F.col("row").alias(row)), "gone"), 2 * NODE_BYTES)
    return docs.join(gone, row, "left_anti").drop(row)


def _classes(docs: DataFrame, similarity: float = SIMILARITY, width: int = WIDTH, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """row, doc_id, class_id, class_rows, stays of (row, doc_id, text).

    A node is a 64-bit hash of a text, but where unequal texts share one (n texts make n * n / 2^65 such pairs, a few
    hundred in 10^11 texts) a second hash takes its place.
    """
    node, check = F.xxhash64("text"), F.xxhash64(F.lit(1), "text")
    blank = ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    rows_ = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), node.alias("node"), check.alias("check"), blank.alias("blank"), "row"), "rows")
    shared = rows_.groupBy("node").agg(F.min("check").alias("lo"), F.max("check").alias("hi")).filter("lo != hi").select("node").collect()

    def told(a, b):
        return F.when(a.isin([r["node"] for r in shared]), b).otherwise(a) if shared else a

    rows_ = rows_.withColumn("node", told(F.col("node"), F.col("check"))).drop("check")
    texts = small_batches(docs).select(told(node, check).alias("node"), "text").filter(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    comps = cut(classes_of(texts, similarity, width, bands, rows), "comps")
    at = rows_.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "node", "row")
    lone = at.filter("blank").select("row", "doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_rows"), F.lit(True).alias("stays"))
    at = cut(at.filter("not blank"), "at")
    groups = at.groupBy("comp").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_rows"), F.count("*").alias("k"), F.min(order).alias("first"))
    told_ = join_counted(at, cut(groups, "groups"), ["comp"], "k")
    return told_.select("row", "doc_id", "class_id", "class_rows", (F.col("row") == F.col("first.row")).alias("stays")).unionByName(lone)
