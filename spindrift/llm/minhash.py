"""Near-duplicate documents by MinHash bands and odd sketches, confirmed on whole sets.

A document's set holds the hashes of its ``n``-word shingles (see ``jaccard.shingles``).
``SAMPLES`` minima of it are cut into bands of ``ROWS``; documents with equal sets form a
class, which its least id stands for, and classes that share a band are candidates.  Of
each class the minima are also folded into an odd sketch: a bitmap of ``BITS`` bits, each
the parity of the number of minima that hash to it.  Minima that two sets have in common
cancel in the XOR of their sketches, so its population count p estimates the similarity,
best where it is high: 1 + BITS / (2 * 2 * SAMPLES) * ln(1 - 2 p / BITS).  A candidate whose p
is more than 6.5 deviations above what the threshold gives is dropped (``furthest``).

What is left, with the members of bands of more than ``jaccard.COLD`` classes (which give a
star each and no pairs), forms clusters, dealt in blocks as in ``jaccard.deal``.  A task has
the whole sets of two blocks; it takes their pairs by rising population count and compares
the sets of a pair only if no chain of links joins them yet, so a group of near copies costs
about one comparison a document.  Every link that counts is confirmed on whole sets.

At the default threshold a pair meets in no band with a chance of 6e-11, and a sketch
drops one with about as much; tokens are 64-bit hashes.  Texts without words have an empty set and
are linked with nothing; null text has no words.  Rows that share an id count as linked,
each with its own text; rows without an id get no component.  Extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.llm import jaccard, texthash
from spindrift.llm.common import map_texts, materialise, small_side, trim
from spindrift.llm.components import components

U = np.uint64
SAMPLES, ROWS, BITS = 128, 4, 512
CHUNK = 2048  # tokens hashed at once
FAILURES = 20  # comparisons of a pair of blocks that may fail, a document, before all its sets are multiplied at once

PLACES = texthash.mix(np.arange(1, SAMPLES + 1, dtype=U) * U(0x9E3779B97F4A7C15))
FLIPS = (texthash.mix(PLACES + U(1)) >> U(32)).astype(np.uint32)[:, None]
TIMES = (texthash.mix(PLACES + U(2)) >> U(32)).astype(np.uint32)[:, None] | np.uint32(1)

SKETCHES = "doc bigint, n int, sig binary, sketch array<bigint>, keys array<bigint>"
SETS = "doc bigint, sig binary, tokens array<bigint>"


def minima(tokens: np.ndarray) -> np.ndarray:
    """The least value of each of ``SAMPLES`` hash functions over the tokens' upper halves (32 bits, which processors multiply and compare many at a time)."""
    out, halves = np.full(SAMPLES, ~np.uint32(0)), (tokens >> U(32)).astype(np.uint32)
    for a in range(0, len(halves), CHUNK):
        values = FLIPS ^ halves[None, a : a + CHUNK]
        np.multiply(values, TIMES, out=values)
        np.minimum(out, values.min(1), out=out)
    return out.astype(U)


def odd_sketch(values: np.ndarray) -> np.ndarray:
    """The parity bitmap of the minima, as 64-bit words."""
    at = (texthash.mix(values ^ PLACES) % U(BITS)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=BITS).astype(np.uint8) & 1).view(np.int64)


def band_keys(values: np.ndarray) -> np.ndarray:
    bands = values.reshape(-1, ROWS)
    key = np.arange(len(bands), dtype=U)
    for i in range(ROWS):
        key = texthash.mix(key + bands[:, i] * jaccard.FACTORS[i % 5])
    return key.view(np.int64)


def furthest(percent: int) -> float:
    """The largest population count of sketches that may reach the threshold: 6.5 deviations (of sampling and of folding) above the expected one."""
    s = percent / 100
    odd = 2 * SAMPLES * (1 - s)
    left = math.exp(-2 * odd / BITS)
    deviation = math.hypot(2 * left * math.sqrt(SAMPLES * s * (1 - s)), math.sqrt(BITS / 4 * (1 - left**2)))
    return BITS / 2 * (1 - left) + 6.5 * deviation


def distance(x: Column, y: Column) -> Column:
    """The population count of the XOR of two sketches."""
    return F.aggregate(F.zip_with(x, y, lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda s, b: s + b)


def similarity(count: Column) -> Column:
    """The similarity that a population count stands for; 0 where the sketches tell none."""
    part = F.greatest(1 - 2 * count / F.lit(float(BITS)), F.lit(1e-9))
    return F.greatest(1 + F.lit(BITS / (4.0 * SAMPLES)) * F.log(part), F.lit(0.0))


def lists(arrays: list, kind) -> pa.ListArray:
    """Arrays of numbers (or None) as an Arrow column."""
    ends = np.cumsum([0, *(0 if a is None else len(a) for a in arrays)]).astype(np.int32)
    flat = [a for a in arrays if a is not None]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int64), kind), mask=pa.array([a is None for a in arrays], pa.bool_()))


def sketched(given: DataFrame, n: int) -> DataFrame:
    """Every row of given (doc, text): the size and signature of its set, its sketch and band keys (null for an empty set)."""

    def run(batches):
        for batch in batches:
            for i, sets in jaccard.shingles(batch.column(1), n):
                held = [minima(s) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, len(sets)),
                        pa.array([len(s) for s in sets], pa.int32()),
                        pa.array([jaccard.signature(s) if len(s) else None for s in sets], pa.binary()),
                        lists([None if m is None else odd_sketch(m) for m in held], pa.int64()),
                        lists([None if m is None else band_keys(m) for m in held], pa.int64()),
                    ],
                    names=["doc", "n", "sig", "sketch", "keys"],
                )

    return map_texts(given, run, SKETCHES)


def whole_sets(given: DataFrame, n: int) -> DataFrame:
    """The tokens of every row of given (doc, text) that has any."""

    def run(batches):
        for batch in batches:
            for i, sets in jaccard.shingles(batch.column(1), n):
                some = [k for k, s in enumerate(sets) if len(s)]
                docs = batch.column(0).slice(i, len(sets)).take(pa.array(some, pa.int64()))
                sigs = pa.array([jaccard.signature(sets[k]) for k in some], pa.binary())
                yield pa.RecordBatch.from_arrays([docs, sigs, lists([sets[k].view(np.int64) for k in some], pa.int64())], names=["doc", "sig", "tokens"])

    return map_texts(given, run, SETS)


def candidates(sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(a, b, similarity: pairs of a band of few classes that the sketches let pass; a, b: stars of the other bands).  sets: node, n, sketch, keys."""
    pairs, stars = jaccard.keyed_sets(sets, percent)
    one, two = (sets.select(F.col("node").alias(c), F.col("sketch").alias(f"s{c}")) for c in "ab")
    met = pairs.join(one, "a").join(two, "b").select("a", "b", distance(F.col("sa"), F.col("sb")).alias("p")).where(F.col("p") <= furthest(percent))
    return met.select("a", "b", similarity(F.col("p")).alias("similarity")), stars


def confirmed(ns: np.ndarray, sketches: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among these sets: pairs by rising distance of their sketches, compared unless joined already."""
    most, m = furthest(percent), len(ns)
    near = []
    for a in range(0, m, 64):
        counts = np.bitwise_count(sketches[a : a + 64, None, :] ^ sketches[None, a:, :]).sum(2, dtype=np.uint16)
        x, y = np.nonzero(counts <= most)
        keep = (x < y) & (100 * np.minimum(ns[a + x], ns[a + y]) >= percent * np.maximum(ns[a + x], ns[a + y]))
        x, y = x[keep], y[keep]
        near.append((counts[x, y], (a + x).astype(np.int32), (a + y).astype(np.int32)))
    counts, x, y = (np.concatenate(p) for p in zip(*near))
    order = np.argsort(counts, kind="stable")
    up = list(range(m))

    def top(i: int) -> int:
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    out, failed = [], 0
    for i, j in zip(x[order].tolist(), y[order].tolist()):
        p, q = top(i), top(j)
        if p == q:
            continue
        shared = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        if 100 * shared >= percent * (len(sets[i]) + len(sets[j]) - shared):
            up[p] = q
            out.append((i, j))
        elif (failed := failed + 1) > FAILURES * m:
            return jaccard.forest(jaccard.compared(ns.astype(np.float32), sets, percent))
    return out


def links(given: DataFrame, sets: DataFrame, n: int, percent: int) -> DataFrame:
    """a, b: confirmed links that connect what the threshold connects.  sets: node (a document of given that stands for its class), n, sig, sketch, keys."""
    near, stars = candidates(sets, percent)
    clusters = materialise(components(near.select("a", "b").unionByName(stars), "clusters"), "clustered")
    members = small_side(clusters.select(F.col("node").alias("doc")), clusters.count())
    tokens = whole_sets(given.join(members, "doc", "left_semi"), n)
    dealt = jaccard.deal(clusters.join(sets.select("node", "n"), "node"), percent)
    dealt = dealt.join(sets.select("node", "sig", "sketch"), "node").join(tokens.withColumnRenamed("doc", "node"), ["node", "sig"])

    def verify(group: pa.Table) -> pa.Table:
        ids, held = group["node"].to_numpy(), group["tokens"].combine_chunks()
        flat, at = held.flatten().to_numpy(), held.offsets.to_numpy()
        at = at - at[0]
        words = group["sketch"].combine_chunks().flatten().to_numpy().view(U).reshape(-1, BITS // 64)
        own = [flat[a:b] for a, b in zip(at, at[1:])]
        found = confirmed(np.diff(at).astype(np.int64), words, own, percent)
        a, b = ids[[i for i, _ in found]], ids[[j for _, j in found]]
        del flat, held, own
        trim()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return dealt.groupBy("component", "p", "i", "q", "j").applyInArrow(verify, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, class_id (least id with the same set), component_id (least id that links reach) of every row."""
    given = docs.select(F.col(f"`{ident}`").cast("long").alias("doc"), F.col(f"`{text}`").alias("text"))
    rows = materialise(sketched(given, n), "sketches")
    named = rows.where("sig IS NOT NULL AND doc IS NOT NULL")
    classes = materialise(named.groupBy("sig").agg(F.count("*").alias("m"), F.min("doc").alias("class_id")), "classes")
    stand = classes.select("sig", F.col("class_id").alias("doc"))
    sets = materialise(named.join(stand, ["sig", "doc"], "left_semi").dropDuplicates(["sig", "doc"]).withColumnRenamed("doc", "node"), "sets")
    return jaccard.labelled(rows, classes, links(given, sets, n, percent))
