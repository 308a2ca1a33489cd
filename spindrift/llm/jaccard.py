"""Exact Jaccard self-join over word shingles, by prefixes of tokens and token combinations.

A token is the hash of ``n`` consecutive words.  Documents with equal sets form a
class, which its least id stands for.  Tokens are ordered by class of document
frequency (unique ones first, then by powers of two), then by hash.  Of two sets
that reach the threshold, the first |x| - ceil(t |x|) + 1 tokens share one, and one
token more makes them share two.  So tokens of the rare classes are indexed alone
over the prefix; those of the frequent classes are indexed as pairs over the prefix
extended by one (alone in sets of more than ``PAIRED`` tokens, where pairs would be too
many; sets near that size do both).  A set whose extended prefix is unique has no
partner.

Keys of up to ``COLD`` sets give candidate pairs.  Larger keys give none: sets
that meet under such keys form a cluster; clusters too large for one block are cut by
size bands so wide that only neighbouring bands can link, bands are dealt in blocks,
and a task holds two blocks against each other and returns a spanning forest of the
links it verified.  All links are verified on whole sets; none between different texts
that the components need is lost.

Every task packs its sets into lists and sends their sorted tokens, delta coded, to
buckets of tokens.  A bucket counts tokens over all lists and tells each list which of
its tokens other sets share, and their classes, list by list; a list's ids, sizes and
signatures go straight to where those answers meet.  A token that is common within
one list goes as a name alone and counts as of the highest class everywhere; the
classes of all others are exact.  Tokens are 56 bits of a hash, and the verification
runs on them too, so "exact" holds up to their collisions.

The lists are made again if a task is lost, so ``docs`` must give the same partitions
when computed again, as a table does.  Texts without words have an empty set and are
linked with nothing.  Rows that share an id count as linked, each with its own text.
Rows without an id get no component.  Null text has no words.  Extra columns are ignored.
"""

from __future__ import annotations

import math
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spindrift.llm import texthash
from spindrift.llm.common import MANY, left_join, map_texts, materialise, small_side, trim
from spindrift.llm.components import components

U = np.uint64
FACTORS = [U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9), U(0x27D4EB2F165667C5), U(0x85EBCA77C2B2AE63)]
BITS = 56
FLUSH = 2_000_000  # tokens a list
LIST_ROWS = 200_000
LOCAL = 64
FREQUENT = 7  # classes from this on are frequent: more than 64 documents
HOT = 30
PAIRED = 60
COLD = 20
BLOCK, BLOCK_TOKENS = 1500, 3_000_000
SLICE = 24_000_000  # bytes of text a bucket of tokens
CUTS = 8  # parts in which a bucket is counted


def shingles(texts: pa.Array, n: int):
    """(index of the first text, sorted distinct hashes of each text) block by block."""
    for i, (words, counts, *_) in texthash.blocks(texts):
        out, end = [], 0
        for k in counts.tolist():
            w = words[end : end + k]
            end += k
            if k >= n:
                h = w[: k - n + 1] * FACTORS[0]
                for j in range(1, n):
                    h = h + w[j : k - n + 1 + j] * FACTORS[j % 5] + U(j // 5)
                out.append(np.unique(texthash.mix(h)))
            elif k:
                h = U(k)
                for j in range(k):
                    h = texthash.mix(w[j : j + 1] + h)
                out.append(h)
            else:
                out.append(w)
        yield i, out


def packed(values: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane, compressed."""
    v = np.ascontiguousarray(values)
    return zstandard.ZstdCompressor(level=1).compress(v.view(np.uint8).reshape(len(v), v.itemsize).T.tobytes()) if len(v) else b""


def unpacked(data: bytes | None, kind) -> np.ndarray:
    if not data:
        return np.zeros(0, kind)
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).reshape(-1)


def differences(sorted_values: np.ndarray) -> np.ndarray:
    return np.diff(sorted_values, prepend=sorted_values[:0].dtype.type(0))


def signature(tokens: np.ndarray) -> bytes:
    return blake2b(tokens.tobytes(), digest_size=16).digest()


# kind 0: what a list holds (docs: ids of its rows, which: the set of each, classes: 1 where the id is null, sizes of the sets, tokens: their signatures);
# 1: tokens of a list for a bucket (tokens, which: their sets); 2: tokens that are common in a list, for a bucket; 3: shared tokens of a list (tokens, which, classes)
TOLD = "kind int, bucket int, list bigint, tokens binary, which binary, classes binary, docs binary, sizes binary"
TOLD_NAMES = [f.split()[0] for f in TOLD.split(", ")]
TOLD_KINDS = (pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 5)


def told(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 8, TOLD_KINDS)], names=TOLD_NAMES)


class TokenList:
    """Rows of a task whose sets are sent together."""

    def __init__(self, number: int):
        self.number, self.rows, self.sets, self.known, self.size = number, [], [], {}, 0

    def add(self, doc: int | None, tokens: np.ndarray) -> None:
        sig = signature(tokens) if len(tokens) else bytes(16)
        at = self.known.get(sig)
        if at is None:
            at = self.known[sig] = len(self.sets)
            self.sets.append((sig, tokens))
            self.size += len(tokens)
        self.rows.append((doc, at))

    def full(self) -> bool:
        return self.size >= FLUSH or len(self.rows) >= LIST_ROWS

    def told(self, bits: int):
        """The rows of kinds 0 to 3 that tell this list."""
        buckets = 1 << bits
        docs = np.array([d or 0 for d, _ in self.rows], np.int64)
        lacks = np.array([d is None for d, _ in self.rows], np.uint8)
        which = np.array([i for _, i in self.rows], np.uint32)
        sizes = np.array([len(t) for _, t in self.sets], np.int32)
        yield (0, -1, self.number, b"".join(s for s, _ in self.sets), packed(which), packed(lacks), packed(docs), packed(sizes))
        named = np.zeros(len(self.sets), bool)
        named[which[lacks == 0]] = True
        used = np.flatnonzero(named & (sizes > 1)).astype(np.uint32)
        if not len(used):
            return
        tokens = np.concatenate([self.sets[i][1] for i in used.tolist()]) >> U(64 - BITS)
        which = np.repeat(used, sizes[used])
        order = np.argsort(tokens, kind="stable")
        tokens, which = tokens[order], which[order]
        del order
        starts = np.flatnonzero(np.diff(tokens, prepend=tokens[:1] + U(1)))
        counts = np.diff(starts, append=len(tokens))
        common = np.repeat(counts > LOCAL, counts)
        if common.any():
            yield (3, -1, self.number, packed(differences(tokens[common])), packed(which[common]), packed(np.full(int(common.sum()), HOT, np.uint8)), None, None)
            hot = tokens[starts[counts > LOCAL]]
            to = (hot >> U(BITS - bits)).astype(np.int64)
            for b in np.unique(to):
                yield (2, int(b), self.number, packed(hot[to == b]), None, None, None, None)
            tokens, which = tokens[~common], which[~common]
        edges = np.searchsorted(tokens, np.arange(buckets + 1, dtype=U) << U(BITS - bits))
        for b in range(buckets):
            x, y = edges[b], edges[b + 1]
            if x < y:
                yield (1, b, self.number, packed(differences(tokens[x:y])), packed(which[x:y]), None, None, None)


def tell(given: DataFrame, n: int, bits: int) -> DataFrame:
    """The lists of all rows of given (doc, text), see ``TOLD``."""

    def run(batches):
        part, made = TaskContext.get().partitionId(), 0
        held = TokenList(part << 16)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for i, sets in shingles(batch.column(1), n):
                for doc, s in zip(ids[i : i + len(sets)], sets):
                    held.add(doc, s)
                    if held.full():
                        yield told(list(held.told(bits)))
                        made += 1
                        held = TokenList(part << 16 | made)
        if held.rows:
            yield told(list(held.told(bits)))

    return map_texts(given, run, TOLD)


def shared_tokens(lists: DataFrame, bits: int) -> DataFrame:
    """Rows of kind 3: which tokens of each list more than one set has, and their classes, from groups of a token bucket; rows of kinds 0 and 3 pass.

    A bucket is counted in ``CUTS`` ranges of tokens, so beside the lists themselves memory holds a part of it at a time.
    """

    def run(group: pa.Table) -> pa.Table:
        group = group.select(TOLD_NAMES)
        if group["bucket"][0].as_py() < 0:
            return group
        parts, hot, bucket = [], [], group["bucket"][0].as_py()
        for kind, number, tokens, which in zip(*(group[c].to_pylist() for c in ("kind", "list", "tokens", "which"))):
            if kind == 2:
                hot.append(unpacked(tokens, U))
            else:
                parts.append((number, np.cumsum(unpacked(tokens, U)), which))
        hot = np.unique(np.concatenate(hot)) if hot else np.zeros(0, U)
        low, step = bucket << (BITS - bits), 1 << (BITS - bits)
        bounds = np.array([low + step * i // CUTS for i in range(CUTS + 1)], U)
        edges = [np.searchsorted(t, bounds) for _, t, _ in parts]
        found = [np.zeros(len(t), np.uint8) for _, t, _ in parts]
        for i in range(CUTS):
            tokens = np.concatenate([t[e[i] : e[i + 1]] for (_, t, _), e in zip(parts, edges)]) if parts else np.zeros(0, U)
            if not len(tokens):
                continue
            order = np.argsort(tokens, kind="stable")
            tokens = tokens[order]
            starts = np.flatnonzero(np.diff(tokens, prepend=tokens[:1] + U(1)))
            times = np.diff(starts, append=len(tokens))
            classes = np.where(times > 1, np.minimum(np.ceil(np.log2(times + 1)), HOT - 1), 0).astype(np.uint8)
            if len(hot):
                classes[np.isin(tokens[starts], hot)] = HOT
            back = np.empty(len(tokens), np.uint8)
            back[order] = np.repeat(classes, times)
            at = 0
            for f, e in zip(found, edges):
                f[e[i] : e[i + 1]] = back[at : at + e[i + 1] - e[i]]
                at += e[i + 1] - e[i]
        rows = []
        for (number, tokens, which), classes in zip(parts, found):
            some = classes > 0
            if some.any():
                rows.append((3, -1, number, packed(differences(tokens[some])), packed(unpacked(which, np.uint32)[some]), packed(classes[some]), None, None))
        del parts, found, edges
        trim()
        return pa.Table.from_batches([told(rows)])

    # what passes is dealt by list, the rest by bucket
    return lists.groupBy("bucket", F.when(F.col("bucket") < 0, F.col("list")).alias("own")).applyInArrow(run, TOLD)


SETS = "doc bigint, n int, sig binary, list bigint, node bigint, tokens array<bigint>, keys array<bigint>"


def prefix_keys(n: int, tokens: np.ndarray, classes: np.ndarray, percent: int) -> np.ndarray:
    """The index keys of a set of n tokens whose shared ones, in order, are given."""
    unique = n - len(tokens)
    prefix = n - -(-percent * n // 100) + 1
    m, longer = prefix - unique, prefix + 1 - unique
    if m < 1 or longer < 2:
        return np.zeros(0, U)
    out = []
    rare = classes[:m] < FREQUENT
    out.append(texthash.mix(tokens[:m][rare] + U(1)))
    if n > PAIRED * percent / 100:
        out.append(texthash.mix(tokens[:m][~rare] + U(2)))
    if n <= PAIRED:
        common = tokens[:longer][classes[:longer] >= FREQUENT]
        i, j = np.triu_indices(len(common), 1)
        out.append(texthash.mix(common[i] * FACTORS[0] + common[j] * FACTORS[1] + U(3)))
    return np.unique(np.concatenate(out))


def listed(group: pa.Table, percent: int) -> pa.Table:
    """The rows of one list; those that stand for a set which may have a partner bear its node, shared tokens and index keys."""
    parts, head = [], None
    for row in zip(*(group[c].to_pylist() for c in TOLD_NAMES)):
        kind, _, number, tokens, which, classes, docs, sizes = row
        if kind == 0:
            head = (number, tokens, unpacked(which, np.uint32), unpacked(classes, np.uint8), unpacked(docs, np.int64), unpacked(sizes, np.int32))
        else:
            parts.append((np.cumsum(unpacked(tokens, U)), unpacked(which, np.uint32), unpacked(classes, np.uint8)))
    number, sigs, of, lacks, docs, sizes = head
    held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    if parts:
        tokens, which, classes = (np.concatenate(p) for p in zip(*parts))
        order = np.lexsort((tokens, classes, which))
        tokens, which, classes = tokens[order], which[order], classes[order]
        starts = np.flatnonzero(np.diff(which.astype(np.int64), prepend=-1))
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(which)]):
            keys = prefix_keys(int(sizes[which[a]]), tokens[a:b], classes[a:b], percent)
            if len(keys):
                held[int(which[a])] = (tokens[a:b].view(np.int64), keys.view(np.int64))
    # of the rows of a set that of the least id stands for it
    named = np.flatnonzero(lacks == 0)
    named = named[np.lexsort((docs[named], of[named]))]
    first = set(named[np.flatnonzero(np.diff(of[named].astype(np.int64), prepend=-1))].tolist())
    own = [held.get(s) if i in first else None for i, s in enumerate(of.tolist())]

    def lists(k):
        ends = np.cumsum([0, *(0 if h is None else len(h[k]) for h in own)]).astype(np.int32)
        flat = [h[k] for h in own if h is not None]
        values = pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int64), pa.int64())
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values, mask=pa.array([h is None for h in own], pa.bool_()))

    return pa.table({
        "doc": pa.array(docs, pa.int64(), mask=lacks == 1),
        "n": pa.array(sizes[of], pa.int32()),
        "sig": pa.array([sigs[16 * s : 16 * s + 16] if sizes[s] else None for s in of.tolist()], pa.binary()),
        "list": pa.array(np.full(len(of), number, np.int64)),
        "node": pa.array([number << 24 | s if h is not None else None for s, h in zip(of.tolist(), own)], pa.int64()),
        "tokens": lists(0),
        "keys": lists(1),
    })


def read_sets(given: DataFrame, n: int, percent: int, bits: int) -> DataFrame:
    """Every row of given (doc, text) with its set's size and signature, see ``listed``; written as a table."""

    def run(group: pa.Table) -> pa.Table:
        try:
            return listed(group, percent)
        finally:
            trim()

    return materialise(shared_tokens(tell(given, n, bits), bits).groupBy("list").applyInArrow(run, SETS), "sets")


def forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a symmetric boolean matrix."""
    out, left = [], np.ones(len(linked), bool)
    for root in range(len(linked)):
        if not left[root]:
            continue
        left[root] = False
        todo = [root]
        while todo:
            i = todo.pop()
            new = np.flatnonzero(linked[i] & left)
            left[new] = False
            out += [(i, int(j)) for j in new]
            todo += new.tolist()
    return out


def compared(ns: np.ndarray, sets: list[np.ndarray], percent: int, chunk: int = 2048) -> np.ndarray:
    """Which sets reach the threshold, from the sizes and the shared tokens: one product of 0/1 matrices a chunk of tokens."""
    m = len(ns)
    which = np.repeat(np.arange(m), [len(s) for s in sets])
    _, token, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = count[token] > 1
    which, token = which[keep], token[keep]
    names, token = np.unique(token, return_inverse=True)
    order = np.argsort(token, kind="stable")
    which, token = which[order], token[order]
    shared = np.zeros((m, m), np.float32)
    for first in range(0, len(names), chunk):
        a, b = np.searchsorted(token, (first, first + chunk))
        x = np.zeros((m, min(chunk, len(names) - first)), np.float32)
        x[which[a:b], token[a:b] - first] = 1
        rows = np.unique(which[a:b])
        if len(rows) < m // 2:
            x = x[rows]
            shared[np.ix_(rows, rows)] += x @ x.T
        else:
            shared += x @ x.T
    union = ns[:, None] + ns[None, :] - shared
    out = 100 * shared >= percent * union
    np.fill_diagonal(out, False)
    return out


def keyed_sets(sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(a, b: candidate pairs of keys of up to ``COLD`` sets; a, b: links of each set of a larger key to the key's least one).

    Keys with more than the ``MANY``-th part of all rows, of which there are at most ``MANY``, are told to all
    tasks, so no key with many rows is shuffled.
    """
    keyed = materialise(sets.select("node", "n", F.explode("keys").alias("key")), "keys")
    most = max(COLD, keyed.count() // MANY)
    hot = materialise(keyed.groupBy("key").agg(F.count("*").alias("m"), F.min("node").alias("first")).where(F.col("m") > most).select("key", "first"), "hot")
    told_all = F.broadcast(hot)
    stars = keyed.join(told_all, "key").select(F.col("first").alias("a"), F.col("node").alias("b"))
    rest = keyed.join(told_all, "key", "left_anti").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("node", "n"))).alias("held")).where(F.size("held") > 1)
    # all pairs of a short key, the pairs with the first of a longer one
    later = lambda x, i: F.transform(F.slice("held", i + 2, F.size("held")), lambda y: F.struct(x["node"].alias("a"), y["node"].alias("b"), x["n"].alias("na"), y["n"].alias("nb")))
    pairs = rest.where(F.size("held") <= COLD).select(F.inline(F.flatten(F.transform("held", later))))
    pairs = pairs.where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent).select("a", "b").distinct()
    longer = rest.where(F.size("held") > COLD).select(F.inline(F.transform("held", lambda x: F.struct(F.element_at("held", 1)["node"].alias("a"), x["node"].alias("b")))))
    return pairs, stars.unionByName(longer) if most > COLD else stars


def deal(clusters: DataFrame, percent: int) -> DataFrame:
    """component, node, p, i, q, j: the pairs of blocks of its cluster that a set belongs to, so that all sets which can link meet in one.

    clusters: component, node, n (size of the set).  A block holds some ``BLOCK`` sets and ``BLOCK_TOKENS`` tokens.
    """
    # bands of sizes: sets that link are in the same or in neighbouring ones
    width = -math.log(percent / 100) * 1.0001 if percent < 100 else 1e-6
    large = clusters.groupBy("component").agg(F.count("*").alias("m"), F.sum("n").alias("t")).where((F.col("m") > BLOCK) | (F.col("t") > BLOCK_TOKENS))
    large = materialise(large.select("component", F.lit(True).alias("large")), "large")
    clusters = clusters.join(small_side(large, large.count()), "component", "left").withColumn("band", F.when(F.col("large"), F.floor(F.log("n") / width) + 1).otherwise(0).cast("int"))
    clusters = materialise(clusters.select("component", "node", "n", "band"), "banded")
    blocks = clusters.where("band > 0").groupBy("component", "band").agg(F.greatest(F.ceil(F.count("*") / F.lit(BLOCK)), F.ceil(F.sum("n") / F.lit(BLOCK_TOKENS))).cast("int").alias("blocks"))
    beside = lambda by, name: blocks.select("component", (F.col("band") - by).alias("band"), F.col("blocks").alias(name))
    blocks = materialise(blocks.join(beside(1, "above"), ["component", "band"], "left").join(beside(-1, "below"), ["component", "band"], "left"), "blocks")
    placed = clusters.join(small_side(blocks, blocks.count()), ["component", "band"], "left")
    placed = placed.withColumn("block", F.pmod(F.xxhash64("node"), F.coalesce("blocks", F.lit(1))).cast("int"))
    own = F.transform(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1), lambda o: F.struct(F.col("band").alias("p"), F.least("block", o).alias("i"), F.col("band").alias("q"), F.greatest("block", o).alias("j")))
    others = lambda name, make: F.when(F.col(name).isNotNull(), F.transform(F.sequence(F.lit(0), F.col(name) - 1), make)).otherwise(F.array())
    above = others("above", lambda o: F.struct(F.col("band").alias("p"), F.col("block").alias("i"), (F.col("band") + 1).alias("q"), o.alias("j")))
    below = others("below", lambda o: F.struct((F.col("band") - 1).alias("p"), o.alias("i"), F.col("band").alias("q"), F.col("block").alias("j")))
    return placed.select("component", "node", F.explode(F.concat(own, above, below)).alias("to")).select("component", "node", "to.*")


def links(sets: DataFrame, percent: int) -> DataFrame:
    """a, b: verified links that connect what the threshold connects.  sets: node (unique), doc, n, tokens, keys."""
    pairs, stars = keyed_sets(sets, percent)
    one = sets.select(F.col("node").alias("a"), F.col("doc").alias("da"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    two = sets.select(F.col("node").alias("b"), F.col("doc").alias("db"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    shared = F.size(F.array_intersect("ta", "tb"))
    cold = pairs.join(one, "a").join(two, "b").where(shared * 100 >= (F.col("na") + F.col("nb") - shared) * percent).select(F.col("da").alias("a"), F.col("db").alias("b"))

    dealt = deal(components(stars, "clusters").join(sets.select("node", "n"), "node"), percent)
    dealt = dealt.join(sets.select("node", "doc", "n", "tokens"), "node")

    def verify(group: pa.Table) -> pa.Table:
        ids = group["doc"].to_numpy()
        lists = group["tokens"].combine_chunks()
        flat, at = lists.flatten().to_numpy(), lists.offsets.to_numpy()
        at = at - at[0]
        found = forest(compared(group["n"].to_numpy().astype(np.float32), [flat[a:b] for a, b in zip(at, at[1:])], percent))
        return pa.table({"a": pa.array([int(ids[i]) for i, _ in found], pa.int64()), "b": pa.array([int(ids[j]) for _, j in found], pa.int64())})

    warm = dealt.groupBy("component", "p", "i", "q", "j").applyInArrow(verify, "a bigint, b bigint")
    return cold.unionByName(warm)


def labelled(rows: DataFrame, classes: DataFrame, linked: DataFrame) -> DataFrame:
    """doc_id, n_shingles, class_id, component_id of rows (doc, n, sig), from classes (sig, m, class_id: its least id) and links of class ids (a, b)."""
    named = rows.where("sig IS NOT NULL AND doc IS NOT NULL").select("doc", "sig")
    # rows that share an id and differ in text
    ids = named.groupBy("doc").agg(F.min("sig").alias("x"), F.max("sig").alias("y")).where("x <> y").select("doc")
    same = named.join(ids, "doc", "left_semi").join(classes, "sig").select(F.col("doc").alias("a"), F.col("class_id").alias("b"))
    found = components(linked.unionByName(same))
    told = classes.join(found, F.col("class_id") == F.col("node"), "left").where("m > 1 OR component IS NOT NULL").select("sig", "class_id", "component")
    out = left_join(rows.select("doc", "n", "sig"), materialise(told, "told"), "sig")
    label = F.coalesce("component", "class_id", "doc")
    return out.select(F.col("doc").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), F.coalesce("class_id", "doc").alias("class_id"), F.when(F.col("doc").isNotNull(), label).alias("component_id"))


def near_duplicates(docs: DataFrame, n: int = 4, percent: int = 85, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, class_id (least id with the same set), component_id of every row."""
    given = docs.select(F.col(f"`{ident}`").cast("long").alias("doc"), F.col(f"`{text}`").alias("text"))
    total = given.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    rows = read_sets(given, n, percent, min(20, max(4, (total // SLICE).bit_length())))
    named = rows.where("sig IS NOT NULL AND doc IS NOT NULL").select("doc", "sig", "list")
    # the set of a class is the one that stands in the list of its least id
    least = named.groupBy("sig").agg(F.count("*").alias("m"), F.min(F.struct("doc", "list")).alias("f"))
    classes = materialise(least.select("sig", "m", F.col("f.doc").alias("class_id"), F.col("f.list").alias("class_list")), "classes")
    own = (F.col("doc") == F.col("class_id")) & (F.col("list") == F.col("class_list"))
    stand = materialise(rows.where("node IS NOT NULL").select("node", "sig", "doc", "list").join(classes, "sig").where(own).select("node"), "stand")
    sets = rows.where("node IS NOT NULL").join(small_side(stand, stand.count()), "node", "left_semi")
    return labelled(rows, classes, links(sets, percent))


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each group of near copies: that of the least id.  Rows without an id or without words stay.

    Rows that share an id are told apart by their text: they go only if a near copy of them stays, and of those that also share
    their text that of the least hash of all columns stays, so a run can be repeated.
    """
    key = F.col(f"`{ident}`").cast("long")
    again = materialise(docs.where(key.isNotNull()).groupBy(key.alias("__again")).agg(F.count("*").alias("n")).where("n > 1").select("__again"), "again")
    repeated = again.count()
    if not repeated:
        return without_copies(docs.withColumn("__key", key), n, percent, text).drop("__key")
    told = docs.join(small_side(again, repeated), key == F.col("__again"), "left")
    told = materialise(told.withColumn("__key", F.when(F.col("__again").isNotNull(), F.xxhash64(f"`{ident}`", f"`{text}`")).otherwise(key)), "told-apart")
    kept = without_copies(told, n, percent, text)
    order = W.partitionBy("__key").orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))
    first = kept.where("__again IS NOT NULL").withColumn("__place", F.row_number().over(order)).where("__place = 1").drop("__place")
    return kept.where("__again IS NULL").unionByName(first).drop("__key", "__again")


def without_copies(docs: DataFrame, n: int, percent: int, text: str) -> DataFrame:
    """docs without the rows whose near copy has a lesser __key."""
    found = near_duplicates(docs, n, percent, "__key", text)
    gone = materialise(found.where("component_id <> doc_id").select(F.col("doc_id").alias("__gone")).distinct(), "gone")
    return docs.join(small_side(gone, gone.count()), F.col("__key") == F.col("__gone"), "left_anti")
