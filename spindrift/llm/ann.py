"""Approximate nearest neighbours by a hierarchical k-means tree.

The tree is fitted on a bounded sample (``SAMPLE`` vectors of smallest id hash) of
unit vectors; every vector of the table is then assigned to a leaf.  A query goes
through the tree best bin first: a priority queue holds the unopened branches by
the cosine to their centres, and leaves are visited in that order until the
calibrated number is reached (and k candidates at least).  That number is the
fewest leaves at which queries of the sample found ``RECALL`` of their true
neighbours, times ``WIDEN``.

Leaves are dealt in blocks of ``BLOCK`` candidates and ``ASKED`` queries, so one
vector that holds a third of the table fills many small tasks, none of them large.
Scores are cosines in double precision of the original vectors, the same for equal
vectors wherever they stand; ties go to the smaller id.

Vectors that are null, zero, of another length than most of the sample, or hold null
or non-finite components take no part, and neither do rows without an id.  Rows
that repeat an id count as one candidate, with its largest score; a query never
finds its own id.  Extra columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spindrift.llm.common import materialise

SAMPLE = 20_000
BRANCHES = 8
LEAF = 48
RECALL = 0.98
WIDEN = 1.2
TRIALS = 400
BLOCK, ASKED = 4096, 1024


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Unit centres, and the centre of each vector."""
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        own = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 0, sums / np.maximum(size, 1e-30), centres)
    return centres, (x @ centres.T).argmax(axis=1)


class Tree:
    """Centres of the children of each node; a leaf has none."""

    def __init__(self, x: np.ndarray, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.centres: list[np.ndarray] = []
        self.children: list[list[int]] = []
        self.leaves = 0
        self.root = self.grow(x, rng, 0)

    def grow(self, x: np.ndarray, rng: np.random.Generator, depth: int) -> int:
        """The number of the node: its place in centres, or ~leaf."""
        if len(x) > LEAF and depth < 12:
            centres, own = kmeans(x, min(BRANCHES, len(x)), rng)
            held = np.unique(own)
            if len(held) > 1:
                node = len(self.centres)
                self.centres.append(centres[held])
                self.children.append([])
                self.children[node] = [self.grow(x[own == h], rng, depth + 1) for h in held]
                return node
        self.leaves += 1
        return ~(self.leaves - 1)

    def leaf(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each unit vector, by the nearest centre at every node."""
        out = np.zeros(len(x), np.int32)
        todo = [(self.root, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                out[rows] = ~node
                continue
            own = (x[rows] @ self.centres[node].T).argmax(axis=1)
            todo += [(child, rows[own == i]) for i, child in enumerate(self.children[node]) if (own == i).any()]
        return out

    def visit(self, q: np.ndarray):
        """Leaves in order of the best open branch."""
        queue = [(-2.0, 0, self.root)]
        turn = 0
        while queue:
            _, _, node = heapq.heappop(queue)
            if node < 0:
                yield ~node
                continue
            for s, child in zip(self.centres[node] @ q, self.children[node]):
                turn += 1
                heapq.heappush(queue, (-float(s), turn, child))


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def calibrated(tree: Tree, x: np.ndarray, k: int, target: float, seed: int = 1) -> int:
    """The fewest leaves at which sampled queries find that share of their k nearest in the sample."""
    rng = np.random.default_rng(seed)
    asked = rng.choice(len(x), min(TRIALS, len(x)), replace=False)
    own = tree.leaf(x)
    needed = []
    for q in asked:
        s = x @ x[q]
        s[q] = -9
        near = np.argsort(-s)[: min(k, len(x) - 1)]
        place = {leaf: i + 1 for i, leaf in enumerate(tree.visit(x[q]))}
        needed += [place[leaf] for leaf in own[near]]
    needed.sort()
    return needed[min(len(needed) - 1, int(np.ceil(target * len(needed))))] if needed else 1


def usable(vector: Column, size: int | None = None) -> Column:
    """Finite, not zero, of the given length."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    some = F.exists(vector, lambda x: x != 0)
    fits = vector.isNotNull() & F.coalesce(~odd, F.lit(False)) & F.coalesce(some, F.lit(False))
    return fits & (F.size(vector) == size) if size else fits


def matrix(column: pa.Array) -> np.ndarray:
    """An Arrow list column without nulls as a double matrix."""
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(n, -1) if n else flat.reshape(0, 0)


def nearest(table: DataFrame, queries: Column, k: int = 5, ident: str = "vec_id", vector: str = "embedding", recall: float = RECALL, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row for which the condition queries (over the table's columns) holds."""
    spark = table.sparkSession
    rows = table.select(F.col(ident).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(queries, F.lit(False)).alias("asks"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    fitted = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").toArrow()["v"].combine_chunks()  # bounded
    nothing = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    if not len(fitted):
        return nothing
    lengths = np.diff(fitted.offsets.to_numpy())
    size = int(np.bincount(lengths).argmax())
    x = unit(np.array([v for v in fitted.to_pylist() if len(v) == size]))
    tree = Tree(x)
    visits = min(tree.leaves, int(np.ceil(calibrated(tree, x, k, recall) * WIDEN)))

    def assign(batches):
        for batch in batches:
            leaf = tree.leaf(unit(matrix(batch.column(1)))) if batch.num_rows else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf, pa.int32())], names=["vec_id", "v", "asks", "leaf"])

    held = materialise(rows.where(F.size("v") == size).mapInArrow(assign, "vec_id bigint, v array<double>, asks boolean, leaf int"), "leaves")
    counts, distinct = np.zeros(tree.leaves, np.int64), np.zeros(tree.leaves, np.int64)
    for r in held.groupBy("leaf").agg(F.count("*").alias("n")).collect():  # as many rows as the tree has leaves
        counts[r["leaf"]] = r["n"]
    # an id counts in the first of its leaves alone, so that leaves together never seem to hold more ids than they do
    for r in held.groupBy("vec_id").agg(F.min("leaf").alias("leaf")).groupBy("leaf").agg(F.count("*").alias("ids")).collect():
        distinct[r["leaf"]] = r["ids"]

    def probe(batches):
        for batch in batches:
            ids, leaves = [], []
            for i, q in enumerate(unit(matrix(batch.column(1)))):
                seen = found = 0
                for leaf in tree.visit(q):
                    if counts[leaf]:
                        ids.append(i)
                        leaves.append(leaf)
                        found += distinct[leaf]
                    seen += 1
                    if seen >= visits and found > k:
                        break
            take = pa.array(ids, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(leaves, pa.int32())], names=["vec_id", "v", "leaf"])

    probes = materialise(held.where("asks").select("vec_id", "v").mapInArrow(probe, "vec_id bigint, v array<double>, leaf int"), "probes")
    asked = np.zeros(tree.leaves, np.int64)
    for r in probes.groupBy("leaf").agg(F.count("*").alias("n")).collect():
        asked[r["leaf"]] = r["n"]
    per_leaf = spark.createDataFrame([(i, max(1, -(-int(counts[i]) // BLOCK)), max(1, -(-int(asked[i]) // ASKED))) for i in range(tree.leaves) if asked[i]], "leaf int, blocks int, shares int")
    dealt = F.broadcast(per_leaf)  # a row a leaf
    mine = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    candidates = held.join(dealt, "leaf").select("leaf", mine("blocks").alias("block"), every("shares").alias("share"), "vec_id", "v", F.lit(False).alias("asks"))
    asking = probes.join(dealt, "leaf").select("leaf", every("blocks").alias("block"), mine("shares").alias("share"), "vec_id", "v", F.lit(True).alias("asks"))

    def compare(group: pa.Table) -> pa.Table:
        asks = group["asks"].to_numpy(zero_copy_only=False) if group.num_rows else np.zeros(0, bool)
        ids = group["vec_id"].to_numpy()
        v = matrix(group["v"].combine_chunks())
        size = np.sqrt(np.einsum("nd,nd->n", v, v))
        q, c = np.flatnonzero(asks), np.flatnonzero(~asks)
        out_q, out_c, out_s = [], [], []
        if len(q) and len(c):
            # equal vectors are compared once; of each, the k + 1 smallest ids can matter
            _, first, same = np.unique(v[c], axis=0, return_index=True, return_inverse=True)
            same = same.reshape(-1)
            # a repeated row is one candidate, so it takes one of those places
            order = np.lexsort((ids[c], same))
            alone = np.ones(len(c), bool)
            alone[1:] = (ids[c][order][1:] != ids[c][order][:-1]) | (same[order][1:] != same[order][:-1])
            apart, c, same = c[first], c[order[alone]], same[order[alone]]
            by = np.argsort(same, kind="stable")
            members = [by[a : a + k + 1] for a in np.searchsorted(same[by], np.arange(len(first)))]
            members = [m[same[m] == u] for u, m in enumerate(members)]
            near = (v[q] / size[q, None]) @ (v[apart] / size[apart, None]).T
            # the cut is at the (k + 1)-th id, whose best vector counts, however many vectors the ids before it have
            listed = c[np.concatenate(members)]
            of = np.repeat(np.arange(len(members)), [len(m) for m in members])
            by = np.argsort(ids[listed], kind="stable")
            starts = np.flatnonzero(np.diff(ids[listed][by], prepend=ids[listed][by][:1] - 1))
            if len(starts) == len(by):  # each vector has ids of its own
                most = min(k + 1, len(apart))
                edge = np.partition(near, len(apart) - most, axis=1)[:, len(apart) - most]
            else:
                most, edge = min(k + 1, len(starts)), np.zeros(len(q))
                for a in range(0, len(q), 64):
                    best = np.maximum.reduceat(near[a : a + 64, of[by]], starts, axis=1)
                    edge[a : a + 64] = np.partition(best, len(starts) - most, axis=1)[:, len(starts) - most]
            i, j = np.nonzero(near >= edge[:, None] - 1e-9)
            score = np.einsum("nd,nd->n", v[q[i]], v[apart[j]]) / (size[q[i]] * size[apart[j]])
            many = np.array([len(members[u]) for u in j])
            i, score = np.repeat(i, many), np.repeat(score, many)
            b = c[np.concatenate([members[u] for u in j])]
            other = ids[b] != ids[q[i]]
            i, b, score = i[other], b[other], score[other]
            order = np.lexsort((ids[b], -score, i))
            i, b, score = i[order], b[order], score[order]
            fresh = np.ones(len(i), bool)
            fresh[1:] = (i[1:] != i[:-1]) | (ids[b][1:] != ids[b][:-1])
            i, b, score = i[fresh], b[fresh], score[fresh]
            kept = np.arange(len(i)) - np.searchsorted(i, i) < k
            out_q, out_c, out_s = ids[q[i[kept]]], ids[b[kept]], score[kept]
        return pa.table({"query_id": pa.array(out_q, pa.int64()), "vec_id": pa.array(out_c, pa.int64()), "score": pa.array(out_s, pa.float64())})

    pairs = candidates.unionByName(asking).groupBy("leaf", "block", "share").applyInArrow(compare, "query_id bigint, vec_id bigint, score double")
    best = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
