"""Prefix tries of conversations: succinct level-order tries of shards, heavy upper levels merged by themselves.

A turn is 128 bits of its role and text, a path (the first d turns) 128 bits of its turns and their places. Equal
conversations are one sequence. Paths below which more than ``SHARD_ROWS`` turns of distinct sequences lie are heavy;
they are the upper levels, few and closed under prefixes. What hangs below them are shards, dealt over groups of about
``SHARD_ROWS`` turns. Each group is built in numpy as one level-order trie (a bitvector of degrees, LOUDS, and arrays of
labels), and a pass from the last level to the first adds up what lies below each node. The sums of the shards' tops
are added to the heavy nodes, whose own sums are doubled in distance each round, so a tall upper part takes rounds by
the logarithm of its height and no task holds it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyra.llm._util import join_counted, settle

#: Turns of distinct sequences from which a path is heavy, and about as many in a group of shards; ids in a block of one path's.
SHARD_ROWS, BLOCK = 1 << 17, 8192
#: First letters of a text that order turns of equal number and role before its hash does.
HEAD = 32
_NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends binary, up_a long, up_b long"


class Louds:
    """A trie in level order: ``bits`` has a one for each child of each node, then a zero; ``labels`` are the edges to the nodes from 1 on.

    Node 0 stands above all; ``levels`` has the first node of each level, and the number of nodes.
    """

    def __init__(self, seq: np.ndarray, level: np.ndarray, a: np.ndarray, b: np.ndarray):
        """From the rows of sequences: number of the sequence, level from 1 without gaps, label. ``node`` is that of each row."""
        order = np.lexsort((seq, level))
        ends = np.flatnonzero(np.diff(np.append(level[order], 0)) != 0) + 1 if len(order) else np.array([], np.int64)
        above, self.node = np.zeros(int(seq.max()) + 1 if len(seq) else 0, np.int64), np.empty(len(seq), np.int64)
        parents, labels, self.levels = [], [], [0, 1]
        for start, end in zip(np.append(0, ends[:-1]) if len(ends) else [], ends, strict=True):
            own = order[start:end]
            own = own[np.lexsort((b[own], a[own], above[seq[own]]))]
            p, x, y = above[seq[own]], a[own], b[own]
            new = np.concatenate([[True], (p[1:] != p[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
            self.node[own] = self.levels[-1] + np.cumsum(new) - 1
            above[seq[own]] = self.node[own]
            parents.append(p[new])
            labels.append(np.stack([x[new], y[new]]))
            self.levels.append(self.levels[-1] + int(new.sum()))
        n = self.levels[-1]
        self.labels = np.concatenate(labels, 1) if labels else np.empty((2, 0), np.int64)
        degrees = np.bincount(np.concatenate(parents) if parents else np.array([], np.int64), minlength=n)
        self.bits = np.ones(2 * n - 1, bool)
        self.bits[np.cumsum(degrees) + np.arange(n)] = False

    def __len__(self) -> int:
        return self.levels[-1]

    def parents(self) -> np.ndarray:
        """Of each node but 0: as many zeros stand before the one of node j as nodes have all their children before it."""
        ones = np.flatnonzero(self.bits)
        return ones - np.arange(len(ones))

    def degrees(self) -> np.ndarray:
        return np.diff(np.append(-1, np.flatnonzero(~self.bits))) - 1

    def up(self, values: np.ndarray, add=np.add) -> np.ndarray:
        """Values of nodes, each with those of all nodes below it added, level by level from the last."""
        out, parents = values.copy(), self.parents()
        for lo, hi in zip(self.levels[-2:0:-1], self.levels[:1:-1], strict=True):
            add.at(out, parents[lo - 1 : hi - 1], out[lo:hi])
        return out


def _shards(pdf: pd.DataFrame) -> pd.DataFrame:
    """The nodes of one group of shards, from the rows of its sequences."""
    conv, n, size = (pdf[c].to_numpy(np.int64) for c in ("conv_id", "n", "bytes"))
    depth, level = pdf["d"].to_numpy(np.int64), pdf["level"].to_numpy(np.int64)
    a, b, step_a, step_b = (pdf[c].to_numpy(np.int64) for c in ("pa", "pb", "sa", "sb"))
    seq = np.unique(conv, return_inverse=True)[1]
    trie = Louds(seq, level, a, b)
    count, at = len(trie), trie.node
    ends = np.zeros(count, np.int64)
    last = pdf["last"].to_numpy(bool)
    ends[at[last]] = n[last]
    digest = np.full(count, None, object)
    digest[at[last]] = pdf["ends"].to_numpy(object)[last]
    least = np.full(count, np.iinfo(np.int64).max)
    np.minimum.at(least, at[last], conv[last])
    least, members = trie.up(least, np.minimum), trie.up(ends)
    deep, own, up_a, up_b = (np.zeros(count, np.int64) for _ in range(4))
    deep[at], own[at], up_a[at], up_b[at] = depth, size, a ^ step_a, b ^ step_b
    degrees, parents = trie.degrees(), trie.parents()
    leaves, saved = trie.up((degrees == 0).astype(np.int64)), trie.up((members - 1) * own)
    inner = parents > 0
    told = lambda x, ok: pd.arrays.IntegerArray(x, ~ok)
    return pd.DataFrame(
        {
            "conv_id": least[1:],
            "depth": deep[1:],
            "parent_conv_id": told(least[parents], inner),
            "n_convs": members[1:],
            "n_children": degrees[1:],
            "n_leaves": leaves[1:],
            "saved_tokens": saved[1:],
            "ends": digest[1:],
            "up_a": told(up_a[1:], ~inner),
            "up_b": told(up_b[1:], ~inner),
        }
    )


def _blocks(batches):
    """Sorted (pa, pb, d, conv_id) as the comma-joined ids of each path, up to BLOCK at a time."""
    for big in batches:
        for lo in range(0, len(big), BLOCK):
            b = big.iloc[lo : lo + BLOCK]
            pa, pb, conv = (b[c].to_numpy() for c in ("pa", "pb", "conv_id"))
            cut = np.flatnonzero(np.concatenate([[True], (pa[1:] != pa[:-1]) | (pb[1:] != pb[:-1])]))
            ends = np.append(cut[1:], len(b))
            ids = [",".join(map(str, conv[s:e].tolist())).encode() for s, e in zip(cut, ends, strict=True)]
            yield pd.DataFrame({"pa": pa[cut], "pb": pb[cut], "d": b["d"].to_numpy()[cut], "conv_id": conv[cut], "n": ends - cut, "ids": ids})


def _digests(batches):
    """Blocks sorted by (pa, pb, first id) as a row a path: the digest of all its ids, their number and the smallest; blocks pass by as a stream."""
    open_ = None
    for b in batches:
        done = []
        for pa, pb, d, conv, n, ids in b[["pa", "pb", "d", "conv_id", "n", "ids"]].itertuples(index=False):
            if open_ and open_[:2] == [pa, pb]:
                open_[4] += n
                open_[5].update(b"," + ids)
                continue
            if open_:
                done.append((*open_[:5], open_[5].digest()))
            open_ = [pa, pb, d, conv, n, hashlib.sha256(ids)]
        yield pd.DataFrame(done, columns=["pa", "pb", "d", "conv_id", "n", "ends"])
    if open_:
        yield pd.DataFrame([(*open_[:5], open_[5].digest())], columns=["pa", "pb", "d", "conv_id", "n", "ends"])


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, d, a, b, bytes): a conversation's turns from 1 in order of (turn, null first; role; text), and a row with d = 0 for itself."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    t = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        role.alias("role"),
        F.substring(text, 1, HEAD).alias("head"),
        F.xxhash64(role, text).alias("a"),
        F.xxhash64(F.lit(1), text, role).alias("b"),
        F.octet_length(text).cast("long").alias("bytes"),
    )
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "head", "a", "b")
    t = t.withColumn("d", F.row_number().over(order)).select("conv_id", "d", "a", "b", "bytes")
    return with_starts(settle(t, "turns"))


def with_starts(t: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("long")
    return t.unionByName(t.filter("d = 1").select("conv_id", F.lit(0).alias("d"), zero.alias("a"), zero.alias("b"), zero.alias("bytes")))


def rebuilt(t: DataFrame, base: Column, first: Column, most: int) -> DataFrame:
    """``turns`` of conversations that begin with the ``first`` (``most`` at most) turns of conversation ``base`` in place of their own."""
    heads = t.filter("d = 0").select("conv_id", base.alias("base"), first.cast("int").alias("first"))
    starts = t.filter(F.col("d").between(1, most)).withColumnRenamed("conv_id", "base")
    given = heads.join(starts, "base").filter("d <= first").select("conv_id", "d", "a", "b", "bytes")
    own = t.filter((F.col("d") == 0) | (F.col("d") > first)).select("conv_id", "d", "a", "b", "bytes")
    order = Window.partitionBy("conv_id").orderBy("d")
    return own.unionByName(given).withColumn("d", F.row_number().over(order) - 1)


def trie(t: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """A row a node of the prefix trie of ``turns``: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    A node is a distinct sequence of first turns, the root that of none; its members are the conversations that start
    with it. conv_id is its smallest member, parent_conv_id its parent's (root: null), n_children its children, n_leaves
    the childless nodes at or below it, saved_tokens the bytes of text that need not be stored or read again at or below
    it ((members - 1) times those of the last text), ends_sha256 the digest of the comma-joined ascending ids of the
    members that end there. Null roles and texts are empty; null turn numbers come first; turns of equal number go by
    role, then text (by its first 32 letters, then its hash). Rows without a conv_id take no part. Equal conversations
    are members of the same nodes; repeated rows are turns of their own. A conversation of any length, with texts of
    any length, is one path. Other columns are ignored. An empty table has no nodes, not even a root.
    """
    spark = t.sparkSession
    by = Window.partitionBy("conv_id").orderBy("d")
    so_far = by.rowsBetween(Window.unboundedPreceding, 0)
    zero = F.lit(0).cast("long")
    paths = t.select(
        "conv_id",
        F.col("d").cast("int").alias("d"),
        "bytes",
        F.when(F.col("d") == 0, zero).otherwise(F.xxhash64("d", "a", "b")).alias("sa"),
        F.when(F.col("d") == 0, zero).otherwise(F.xxhash64(F.lit(7), "b", "a", "d")).alias("sb"),
    )
    paths = settle(paths.select("*", F.bit_xor("sa").over(so_far).alias("pa"), F.bit_xor("sb").over(so_far).alias("pb"), F.lead("d").over(by).isNull().alias("last")), "paths")

    ends = paths.filter("last").select("pa", "pb", "d", "conv_id")
    key = ["pa", "pb", "conv_id"]
    blocks = ends.repartitionByRange(*key).sortWithinPartitions(*key).mapInPandas(_blocks, "pa long, pb long, d int, conv_id long, n long, ids binary")
    whole = blocks.repartition("pa", "pb").sortWithinPartitions(*key).mapInPandas(_digests, "pa long, pb long, d int, conv_id long, n long, ends binary")
    whole = settle(whole.select("conv_id", "n", F.col("d").alias("len"), "ends"), "sequences")
    rows = paths.join(whole, "conv_id").withColumn("ends", F.when(F.col("last"), F.col("ends")))
    rows = settle(rows, "rows")

    heavy = rows.groupBy("pa", "pb").agg(
        F.max("d").alias("d"),
        F.sum(F.col("len") - F.col("d") + 1).alias("weight"),
        F.count("*").alias("seqs"),
        F.min("conv_id").alias("conv_id"),
        F.sum("n").alias("n_convs"),
        F.max("bytes").alias("bytes"),
        F.max("sa").alias("sa"),
        F.max("sb").alias("sb"),
        F.max("ends").alias("ends"),
    )
    heavy = settle(heavy.filter((F.col("weight") > shard_rows) | (F.col("d") == 0)), "heavy")
    shape = heavy.agg(F.count("*").alias("heavy"), F.max("weight").alias("rows")).first()
    if shape["heavy"] > 1:
        met = join_counted(rows.filter("d > 0").select("conv_id", "d", "pa", "pb"), heavy.filter("d > 0").select("pa", "pb", "seqs"), ["pa", "pb"], "seqs")
        depth = met.groupBy("conv_id").agg(F.max("d").alias("k"))
        rows = rows.join(depth, "conv_id", "left").withColumn("level", F.col("d") - F.coalesce("k", F.lit(0))).drop("k")
    else:
        rows = rows.withColumn("level", F.col("d"))
    groups = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(shape["rows"] or 0) // shard_rows))
    top = F.max(F.when(F.col("level") == 1, F.xxhash64("pa", "pb"))).over(Window.partitionBy("conv_id"))
    shards = rows.filter("level > 0").withColumn("bucket", F.pmod(top, F.lit(groups)))
    nodes = settle(shards.groupBy("bucket").applyInPandas(_shards, _NODES), "nodes")

    up = [F.col("pa").bitwiseXOR(F.col("sa")), F.col("pb").bitwiseXOR(F.col("sb"))]
    up_a, up_b = (F.when(F.col("d") > 0, c) for c in up)
    below = nodes.filter("up_a is not null").groupBy(F.col("up_a").alias("pa"), F.col("up_b").alias("pb")).agg(
        F.count("*").alias("tops"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens")
    )
    kids = heavy.filter("d > 0").groupBy(up[0].alias("pa"), up[1].alias("pb")).agg(F.count("*").alias("kids"))
    upper = heavy.join(below, ["pa", "pb"], "left").join(kids, ["pa", "pb"], "left").fillna(0, ["tops", "kids", "n_leaves", "saved_tokens"])
    upper = upper.withColumns(
        {
            "n_children": F.col("tops") + F.col("kids"),
            "n_leaves": F.when(F.col("tops") + F.col("kids") == 0, 1).otherwise(F.col("n_leaves")),
            "saved_tokens": F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("bytes"),
            "up_a": up_a,
            "up_b": up_b,
        }
    )
    upper = settle(upper, "upper")
    sums = summed(upper.select("pa", "pb", "up_a", "up_b", "n_leaves", "saved_tokens")) if shape["heavy"] > 1 else upper
    over = upper.select(F.col("pa").alias("up_a"), F.col("pb").alias("up_b"), F.col("conv_id").alias("parent_conv_id"))
    named = upper.drop("n_leaves", "saved_tokens").join(sums.select("pa", "pb", "n_leaves", "saved_tokens"), ["pa", "pb"]).join(over, ["up_a", "up_b"], "left")
    told = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends"]
    tops = nodes.filter("up_a is not null").drop("parent_conv_id")
    parents = upper.filter("tops > 0").select(F.col("pa").alias("up_a"), F.col("pb").alias("up_b"), F.col("conv_id").alias("parent_conv_id"), "tops")
    out = nodes.filter("up_a is null").select(told)
    out = out.unionByName(join_counted(tops, parents, ["up_a", "up_b"], "tops").select(told))
    out = out.unionByName(named.withColumn("depth", F.col("d").cast("long")).select(told))
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select(*told[:-1], F.coalesce(F.lower(F.hex("ends")), none).alias("ends_sha256"))


def summed(level: DataFrame) -> DataFrame:
    """(pa, pb, up_a, up_b, n_leaves, saved_tokens) of the nodes of a tree, with the two sums of all nodes below added to each.

    After each round a node holds those of twice as many levels below it and knows the node so many above it.
    """
    sums = ["n_leaves", "saved_tokens"]
    while level.filter("up_a is not null").head(1):
        added = level.filter("up_a is not null").groupBy(F.col("up_a").alias("pa"), F.col("up_b").alias("pb")).agg(*(F.sum(c).alias("more_" + c) for c in sums))
        next_ = level.filter("up_a is not null").select(F.col("pa").alias("up_a"), F.col("pb").alias("up_b"), F.col("up_a").alias("next_a"), F.col("up_b").alias("next_b"))
        both = level.join(added, ["pa", "pb"], "left").join(next_, ["up_a", "up_b"], "left")
        level = settle(both.select("pa", "pb", F.col("next_a").alias("up_a"), F.col("next_b").alias("up_b"), *((F.col(c) + F.coalesce("more_" + c, F.lit(0))).alias(c) for c in sums)), "sums")
    return level
