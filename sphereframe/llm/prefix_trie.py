"""The prefix trie of conversations, as balanced parentheses in shards whose shared spines merge.

A node is a distinct sequence of first turns; its key is its depth and two polynomial hashes of 61 bits, which run over split
conversations like any associative value.  A conversation's path are the nodes that others pass too and the first one that
is its own; what follows is a chain with one member and needs no tree.  Paths, sorted and split by range, are the shards.

A shard writes its nodes in preorder as parentheses.  ``find_close`` searches minimum excesses of blocks under a binary tree
and delimits a subtree; the rank of opening ones is the preorder number, the rank of "()" counts leaves, cumulative arrays
count members and savings.  A node that a neighbouring shard may have too lies on the path of a shard's first or last
conversation.  These spines, some nodes a shard, merge by key and are encoded once more for their own sums.

Rows: a null role or text is empty; rows without ``conv_id`` belong to no conversation; turns without number come first; ties
go by role, then text; a repeated row is one more turn.  An empty table has no nodes, not even a root.  Other columns are not
read.  ``c - c % 20`` goes towards zero for negative ids.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import turns
from .common import arrow_schema, batch_of, rows_of, stage

PRIME = (1 << 61) - 1
BASES = (1_000_000_007_000_003, 1_234_567_890_123_457)  # any two numbers below the prime
KEY = ["depth", "k1", "k2"]
WORD = r"[^\x20\x09-\x0D]+"
SHARD_NODES = 1 << 19
BLOCK = 256


# ----------------------------------------------------------------------------- balanced parentheses
class Parentheses:
    """The tree of a preorder list of depths, the root's 0 first."""

    def __init__(self, depths: np.ndarray):
        n = len(depths)
        self.opens = 2 * np.arange(n) - depths  # before a node: one opening each, closings up to its depth
        self.bits = np.zeros(2 * n + 1, np.int8)
        self.bits[self.opens] = 1
        leaf = self.bits[:-1] & (1 - self.bits[1:])
        self.bits = self.bits[:-1]
        pad = -len(self.bits) % BLOCK
        blocks = np.pad(self.bits, (0, pad)).reshape(-1, BLOCK)
        steps = np.pad(2 * self.bits - 1, (0, pad)).reshape(-1, BLOCK).astype(np.int64)
        before = lambda sums: np.concatenate([[0], np.cumsum(sums)])
        self.opened, self.excess = before(blocks.sum(1)), before(steps.sum(1))
        self.leaves = before(np.pad(leaf, (0, pad)).reshape(-1, BLOCK).sum(1))
        self.blocks, self.steps, self.leaf = blocks, steps, np.pad(leaf, (0, pad)).reshape(-1, BLOCK)
        low = self.excess[:-1] + np.cumsum(steps, 1).min(1)
        self.width = 1 << max(0, (len(low) - 1).bit_length())
        self.tree = np.full(2 * self.width, np.iinfo(np.int64).max)
        self.tree[self.width:self.width + len(low)] = low
        for i in range(self.width - 1, 0, -1):
            self.tree[i] = min(self.tree[2 * i], self.tree[2 * i + 1])

    def rank_open(self, i: int) -> int:
        """Opening parentheses before ``i``."""
        b, k = divmod(int(i), BLOCK)
        return int(self.opened[b]) + (int(self.blocks[b, :k].sum()) if k else 0)

    def rank_leaf(self, i: int) -> int:
        """Pairs "()" that begin before ``i``."""
        b, k = divmod(int(i), BLOCK)
        return int(self.leaves[b]) + (int(self.leaf[b, :k].sum()) if k else 0)

    def _block_under(self, first: int, excess: int) -> int:
        """The first block from ``first`` on whose excess comes down to ``excess``."""
        i = self.width + first
        while self.tree[i] > excess:
            while i & 1:
                i >>= 1
            i += 1
        while i < self.width:
            i = 2 * i if self.tree[2 * i] <= excess else 2 * i + 1
        return i - self.width

    def find_close(self, i: int) -> int:
        """The closing parenthesis of the opening one at ``i``: where the excess first falls below that before it."""
        b, k = divmod(int(i), BLOCK)
        inside = np.cumsum(self.steps[b])
        down = np.flatnonzero(inside[k + 1:] == inside[k] - 1)
        if len(down):
            return b * BLOCK + k + 1 + int(down[0])
        wanted = int(self.excess[b] + inside[k] - 1)
        b = self._block_under(b + 1, wanted)
        return b * BLOCK + int(np.flatnonzero(self.excess[b] + np.cumsum(self.steps[b]) == wanted)[0])

    def subtrees(self) -> tuple[np.ndarray, np.ndarray]:
        """For each node in preorder: the number after its subtree's last, and the leaves in it."""
        closes = [self.find_close(i) for i in self.opens]
        return (np.array([self.rank_open(c) for c in closes]),
                np.array([self.rank_leaf(c) - self.rank_leaf(i) for i, c in zip(self.opens, closes, strict=True)]))


def sums(values: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sums over preorder stretches by one cumulative array."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[end] - total[first]


# ----------------------------------------------------------------------------- rebuilt conversations and their nodes
def rebuilt(conversations: DataFrame, group: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """All ``conv_id``, and the rows (conv_id, turn, role, text) with the first turns of each group's first conversation."""
    rows = turns.select(conversations).where("conv_id is not null")
    own = stage(turns.running(rows, ["turn"]).select("conv_id", F.col("pos").alias("turn"), "role", "text"), "own")
    ids = stage(own.select("conv_id").distinct(), "ids")
    borrowed = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    heads = own.where((F.col("conv_id") % group == 0) & (F.col("turn") < most - 1)).withColumnRenamed("conv_id", "base")
    lent = (ids.withColumn("base", F.col("conv_id") - F.col("conv_id") % group).join(heads, "base")
            .where(F.col("turn") < borrowed).select("conv_id", "turn", "role", "text"))
    return ids, lent.unionByName(own.where(F.col("turn") >= borrowed))


def roll(state: turns.State, role: str, text: str) -> turns.State:
    """Powers and values of both hashes after one more turn."""
    turn = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
    (p, v, q, w), (a, b) = state, BASES
    return (p * a % PRIME, (v * a + int.from_bytes(turn[:8], "big")) % PRIME,
            q * b % PRIME, (w * b + int.from_bytes(turn[8:], "big")) % PRIME)


def joined(one: turns.State, two: turns.State) -> turns.State:
    (p, v, q, w), (r, x, s, y) = one, two
    return p * r % PRIME, (v * r + x) % PRIME, q * s % PRIME, (w * s + y) % PRIME


def steps(rows: DataFrame) -> DataFrame:
    """``conv_id, depth, k1, k2, words, shared``: the nodes that each conversation passes, the root left out."""
    lines = turns.running(rows, ["turn"], (1, 0, 1, 0), roll, joined).select(
        "conv_id", (F.col("pos") + 1).alias("depth"), F.col("state")[1].alias("k1"), F.col("state")[3].alias("k2"),
        F.regexp_count("text", F.lit(WORD)).cast("bigint").alias("words"))
    lines = stage(lines, "lines")
    shared = stage(lines.groupBy(*KEY).agg(F.count(F.lit(1)).alias("members")).where("members > 1"), "shared")
    return stage(lines.join(shared, KEY, "left").select("conv_id", *KEY, "words", F.col("members").isNotNull().alias("shared")), "steps")


def paths(ids: DataFrame, lines: DataFrame) -> DataFrame:
    """``conv_id, length, path``: shared nodes and the first one of its own, if any."""
    node = F.struct(*KEY, "words")
    ends = lines.groupBy("conv_id").agg(F.max("depth").alias("length"), F.array_sort(F.collect_list(F.when(F.col("shared"), node))).alias("common"),
                                        F.min(F.when(~F.col("shared"), node)).alias("own"))
    path = F.when(F.col("own").isNull(), F.col("common")).otherwise(F.concat("common", F.array("own")))
    root = F.array().cast("array<struct<depth:bigint,k1:bigint,k2:bigint,words:bigint>>")
    return ids.join(ends, "conv_id", "left").select("conv_id", F.coalesce("length", F.lit(0).cast("bigint")).alias("length"),
                                                    F.coalesce(path, root).alias("path"))


# ----------------------------------------------------------------------------- shards
NODE = ("depth bigint, k1 bigint, k2 bigint, up1 bigint, up2 bigint, spine boolean, shard bigint, number bigint, words bigint, "
        "n_convs bigint, conv_id bigint, parent_conv_id bigint, n_children bigint, chained boolean, n_leaves bigint, "
        "saved_tokens bigint")


def encode(convs: Iterator[dict], shard: int) -> list[tuple]:
    """Nodes of one shard; spine nodes have the sums of what lies under them and is no spine."""
    nodes, parents, stack = [(0, 0, 0, 0)], [-1], [0]
    members, ends, chained, edges = [], [], set(), []
    for conv in convs:
        path = [(0, 0, 0, 0), *((n["depth"], n["k1"], n["k2"], n["words"]) for n in conv["path"])]
        same = 0
        while same < min(len(path), len(stack)) and nodes[stack[same]] == path[same]:
            same += 1
        del stack[same:]
        for node in path[same:]:
            parents.append(stack[-1])
            stack.append(len(nodes))
            nodes.append(node)
        members.append(conv["conv_id"])
        ends.append(stack[-1])
        if conv["length"] > path[-1][0]:
            chained.add(stack[-1])
        edges = [edges[0] if edges else stack[:], stack[:]]
    if not members:
        return []
    depth, k1, k2, words = np.array(nodes, np.int64).T
    parent = np.array(parents)
    spine = np.zeros(len(nodes), bool)
    spine[[*edges[0], *edges[1]]] = True
    first = np.arange(len(nodes))
    end, leaves = Parentheses(depth).subtrees()
    ended = np.concatenate([[0], np.cumsum(np.bincount(ends, minlength=len(nodes)))])
    n_convs = ended[end] - ended[first]
    least = np.minimum.reduceat([*members, np.iinfo(np.int64).max], np.column_stack([ended[first], ended[end]]).ravel())[::2]
    saved = sums(np.where(spine, 0, (n_convs - 1) * words), first, end)
    leaves = leaves - sums(spine & (end == first + 1), first, end)
    children = np.bincount(parent[1:][~spine[1:]], minlength=len(nodes))
    rows = []
    for i in range(len(nodes)):
        up = parent[i]
        known = int(least[up]) if up >= 0 and not spine[up] else None
        rows.append((int(depth[i]), int(k1[i]), int(k2[i]), int(k1[up]), int(k2[up]), bool(spine[i]), shard, i, int(words[i]),
                     int(n_convs[i]), int(least[i]), known, int(children[i]) + (i in chained), i in chained, int(leaves[i]), int(saved[i])))
    return rows


def merged_spines(rows: list[dict]) -> list[tuple]:
    """Spine nodes of all shards, merged by key and in preorder, with the sums of their whole subtrees."""
    if not rows:
        return []
    depth, n_convs, words = (np.array([r[c] for r in rows]) for c in ("depth", "n_convs", "words"))
    end, _ = Parentheses(depth).subtrees()
    first = np.arange(len(rows))
    stack, parent = [], []
    for i, d in enumerate(depth):
        del stack[d:]
        parent.append(stack[-1] if stack else -1)
        stack.append(i)
    children = np.bincount(np.array(parent[1:], int), minlength=len(rows)) + [r["n_children"] for r in rows]
    alone = children - [r["chained"] for r in rows] == 0
    leaves = sums(alone, first, end) + [r["n_leaves"] for r in rows]
    saved = sums((n_convs - 1) * words, first, end) + [r["saved_tokens"] for r in rows]
    return [(r["depth"], r["k1"], r["k2"], r["conv_id"], rows[p]["conv_id"] if p >= 0 else None, r["n_convs"], int(children[i]),
             int(leaves[i]), int(saved[i])) for i, (r, p) in enumerate(zip(rows, parent, strict=True))]


def trie(ids: DataFrame, lines: DataFrame) -> DataFrame:
    """All nodes of the paths, and below them the chains of one conversation."""
    out = [*KEY, "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    routes = stage(paths(ids, lines), "paths")
    spark = ids.sparkSession
    nodes = routes.agg(F.sum(F.size("path") + 1)).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-nodes // SHARD_NODES))
    schema = arrow_schema(NODE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = encode((r for b in batches for r in rows_of(b)), TaskContext.get().partitionId())
        for i in range(0, len(rows), 10_000):
            yield batch_of(rows[i:i + 10_000], schema)
    made = stage(routes.repartitionByRange(shards, "path", "conv_id").sortWithinPartitions("path", "conv_id").mapInArrow(run, NODE), "nodes")
    spines = made.where("spine").groupBy(*KEY).agg(
        F.min(F.struct("shard", "number")).alias("place"), F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"),
        F.max("words").alias("words"), F.sum("n_children").alias("n_children"), F.max("chained").alias("chained"),
        F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    ddl = ", ".join(f"{c} bigint" for c in out)
    whole = arrow_schema(ddl)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield batch_of(merged_spines([r for b in batches for r in rows_of(b)]), whole)
    spines = stage(spines.repartition(1).sortWithinPartitions("place").mapInArrow(merge, ddl), "spines")
    above = spines.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("up1"), F.col("k2").alias("up2"), F.col("conv_id").alias("above"))
    inner = made.where("not spine").join(above, ["depth", "up1", "up2"], "left").withColumn(
        "parent_conv_id", F.coalesce("parent_conv_id", "above")).select(*out)
    chains = (lines.where("not shared").join(routes.select("conv_id", "length", F.size("path").alias("reached")), "conv_id")
              .where(F.col("depth") > F.col("reached")))
    chains = chains.select(*KEY, "conv_id", F.col("conv_id").alias("parent_conv_id"), F.lit(1).cast("bigint").alias("n_convs"),
                           (F.col("depth") < F.col("length")).cast("bigint").alias("n_children"),
                           F.lit(1).cast("bigint").alias("n_leaves"), F.lit(0).cast("bigint").alias("saved_tokens"))
    return spines.unionByName(inner).unionByName(chains)


def end_hashes(ids: DataFrame, lines: DataFrame) -> DataFrame:
    """For each node where conversations end, the hash of their ids in ascending order, streamed."""
    last = lines.groupBy("conv_id").agg(F.max(F.struct(*KEY)).alias("last"))
    zero = F.lit(0).cast("bigint")
    ended = ids.join(last, "conv_id", "left").select(*[F.coalesce(f"last.{k}", zero).alias(k) for k in KEY], "conv_id")
    ddl = "depth bigint, k1 bigint, k2 bigint, ends_sha256 string"
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, digest = None, None
        for batch in batches:
            out = []
            for *key, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != at:
                    if at:
                        out.append((*at, digest.hexdigest()))
                    at, digest = key, hashlib.sha256(str(conv).encode())
                else:
                    digest.update(f",{conv}".encode())
            yield batch_of(out, schema)
        if at:
            yield batch_of([(*at, digest.hexdigest())], schema)
    return ended.repartition(*KEY).sortWithinPartitions(*KEY, "conv_id").mapInArrow(run, ddl)


def nodes(conversations: DataFrame) -> DataFrame:
    """One row for each node of the trie of rebuilt conversations."""
    ids, rows = rebuilt(conversations)
    lines = steps(rows)
    found = trie(ids, lines).join(end_hashes(ids, lines), KEY, "left")
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
