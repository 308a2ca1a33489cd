"""Quality classification by importance resampling over hashed n-gram models.

Features are hashed n-grams: words, pairs of consecutive words, whether a pair repeats
its word, and the character n-grams at words' edges (the first four and five bytes, the
last two).  Two generative models of them are set against each other twice:

* ``rate``: the mean log ratio a word of multinomial models of target text (labelled
  good and not toxic) and raw text (every document).  It tells junk, whose n-grams
  differ all along.
* ``signs``: the sum over the n-grams that a document holds of the log ratio of their
  share in labelled documents that are not toxic to that in all labelled ones, where it
  is below 1, over the root of the length.  It tells toxic texts, which differ in a few
  n-grams.  Shares are smoothed towards the usual one and each ratio is weighted by its
  evidence, so n-grams of few documents count at every size and chance hardly does; what
  is nearer to 0 than ``LEAST`` counts as 0.

A document's log importance weight is what of these log ratios, in nats, lies below
the threshold that labelled rows of a held-out fifth set (there a clean document lost
weighs as much as ``COST`` bad ones caught): the words times the rate's lack, plus the
root of the length times the signs' lack; 0 where neither falls short.  Resampling
without replacement is Gumbel top-k: keep the k largest of log weight plus standard
Gumbel noise.  k is ``share`` of the rows if that is given, else the sum of all
weights, the number that rejection sampling would keep.  The noise comes from a hash of
id and text, so a run can be repeated.  So documents a few nats below the thresholds
are drawn now and then, and push out as many others; those far below are not.

At most ``SAMPLE`` labelled rows (those of smallest id hash) are used; everything
else is counted over all documents.  Null text is empty and has weight 1; rows
that repeat get the same decision, and all rows at the last key are kept.  Null ids are
judged like others.  Without labelled good rows every weight is 1.  Extra columns are
kept by ``keep`` and ignored otherwise; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.llm import texthash
from spindrift.llm.common import map_texts, materialise

SAMPLE = 200_000
BUCKETS = 1 << 18
FOLDS = 5
#: How many bad documents caught weigh as much as a clean one lost, when thresholds are set.
COST = 10
#: Documents of the usual share that each share is smoothed by; the log likelihood ratio at which a feature counts half, and how steeply.
SMOOTH, HALF, STEEP = 2.0, 8.0, 4
#: Weighted log ratios nearer to 0 than this count as 0.
LEAST = 0.01
#: Words that lengths are smoothed by.
FEW_WORDS = 20
CHUNKS = 16
U = np.uint64
RAW, GOOD, TOXIC_DOCS, LABELLED_DOCS = range(4)


def features(texts: pa.Array):
    """(index of the first text, word counts, feature buckets, text of each feature) block by block."""
    for i, (whole, counts, head, tail, _, longer) in texthash.blocks(texts, 4, 2, 5):
        doc = np.repeat(np.arange(len(counts)), counts)
        second = doc[1:] == doc[:-1]
        again = np.zeros(len(whole), bool)
        again[1:] = (whole[1:] == whole[:-1]) & second
        pair = (whole[:-1] * U(3) + whole[1:])[second]
        kinds = [whole ^ U(11), head ^ U(22), longer ^ U(33), tail ^ U(44), again.astype(U) + U(55), pair ^ U(66)]
        buckets = np.concatenate([texthash.mix(k) % U(BUCKETS) for k in kinds]).astype(np.int64)
        yield i, counts, buckets, np.concatenate([np.tile(doc, 5), doc[1:][second]])


def label_column() -> Column:
    """0: not labelled, 1: good, 2: rejected; null quality counts as good, null toxic as not toxic."""
    good = (F.coalesce(F.col("quality"), F.lit(1)) == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)
    return F.when(F.col("label_id").isNull(), 0).when(good, 1).otherwise(2)


def labelled(docs: DataFrame, labels: DataFrame, ident: str, text: str, sample: int) -> DataFrame:
    """doc_id, text, kind (see ``label_column``), quality, toxic, fold of every document."""
    known = labels.where(F.col(ident).isNotNull()).groupBy(F.col(ident).alias("label_id")).agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    known = known.orderBy(F.xxhash64("label_id"), "label_id").limit(sample)  # bounded, so it may be broadcast
    given = docs.select(F.col(ident).alias("doc_id"), F.col(text).alias("text"))
    out = given.join(F.broadcast(known), F.col("doc_id") == F.col("label_id"), "left")
    return out.select("doc_id", "text", label_column().alias("kind"), "quality", "toxic", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int").alias("fold"))


def counted(rows: DataFrame) -> tuple[np.ndarray, int, int, int]:
    """The four count vectors, and how many training rows are good, labelled and toxic."""

    def count(batches):
        vectors, n = np.zeros((4, BUCKETS), np.int64), np.zeros(3, np.int64)
        for batch in batches:
            kind = batch.column(1).to_numpy(zero_copy_only=False)
            fold = batch.column(2).to_numpy(zero_copy_only=False)
            train = fold != 0
            good, known = train & (kind == 1), train & (kind > 0)
            toxic = known & batch.column(3).to_numpy(zero_copy_only=False)
            n += good.sum(), known.sum(), toxic.sum()
            for i, counts, buckets, doc in features(batch.column(0)):
                vectors[RAW] += np.bincount(buckets, minlength=BUCKETS)
                g, k = good[i : i + len(counts)][doc], known[i : i + len(counts)][doc]
                vectors[GOOD] += np.bincount(buckets[g], minlength=BUCKETS)
                pairs = np.unique(doc[k] * BUCKETS + buckets[k])
                vectors[LABELLED_DOCS] += np.bincount(pairs % BUCKETS, minlength=BUCKETS)
                vectors[TOXIC_DOCS] += np.bincount((pairs % BUCKETS)[toxic[i : i + len(counts)][pairs // BUCKETS]], minlength=BUCKETS)
        packer, task = zstandard.ZstdCompressor(), TaskContext.get().partitionId()
        parts = [packer.compress(p.tobytes()) for p in np.split(vectors.reshape(-1), 4 * CHUNKS)] + [packer.compress(n.tobytes())]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([task % 64] * len(parts), pa.int32()), pa.array(parts, pa.binary())], names=["chunk", "lane", "data"])

    def add(table: pa.Table) -> pa.Table:
        total = None
        for blob in table["data"]:
            v = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob.as_py()), np.int64)
            total = v.copy() if total is None else total + v
        return pa.table({"chunk": table["chunk"][:1], "lane": table["lane"][:1], "data": pa.array([zstandard.ZstdCompressor().compress(total.tobytes())], pa.binary())})

    schema = "chunk int, lane int, data binary"
    parts = map_texts(rows.select("text", "kind", "fold", F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("toxic")), count, schema)
    # two levels, so no task adds the vectors of more than a 64th of all tasks
    sums = parts.groupBy("chunk", "lane").applyInArrow(add, schema).groupBy("chunk").applyInArrow(add, schema)
    held = {r["chunk"]: np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(r["data"])), np.int64) for r in sums.collect()}
    if not held:
        return np.zeros((4, BUCKETS), np.int64), 0, 0, 0
    vectors = np.concatenate([held[i] for i in range(4 * CHUNKS)]).reshape(4, BUCKETS)
    return vectors, *(int(x) for x in held[4 * CHUNKS])


@dataclass
class Model:
    rate: np.ndarray
    signs: np.ndarray
    rate_at: float = -np.inf
    signs_at: float = -np.inf

    def score(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """rate, signs and words of each text."""
        n = len(texts)
        rate, signs, words = np.zeros(n), np.zeros(n), np.zeros(n)
        for i, counts, buckets, doc in features(texts):
            m = len(counts)
            words[i : i + m] = counts
            rate[i : i + m] = np.bincount(doc, self.rate[buckets], m) / np.maximum(counts, 1)
            some = self.signs[buckets] != 0
            pairs = np.unique(doc[some] * BUCKETS + buckets[some])
            signs[i : i + m] = np.bincount(pairs // BUCKETS, self.signs[pairs % BUCKETS], m) / np.sqrt(counts + FEW_WORDS)
        return rate, signs, words

    def weight(self, rate: np.ndarray, signs: np.ndarray, words: np.ndarray) -> np.ndarray:
        """The log importance weights."""
        return words * np.minimum(rate - self.rate_at, 0.0) + np.sqrt(words + FEW_WORDS) * np.minimum(signs - self.signs_at, 0.0)


def evidence(held: np.ndarray, expected: np.ndarray) -> np.ndarray:
    """One term of a log likelihood ratio: counts held where so many were expected."""
    return held * np.log(np.maximum(held, 1) / np.maximum(expected, 1e-12))


def trained(vectors: np.ndarray, good_rows: int, known_rows: int, toxic_rows: int) -> Model:
    v = vectors.astype(float)
    if not good_rows or not v[RAW].sum():
        return Model(np.zeros(BUCKETS), np.zeros(BUCKETS))
    prior = (v[RAW] + 1e-3) / (v[RAW] + 1e-3).sum()
    rate = np.log((v[GOOD] + BUCKETS * prior) / (v[GOOD].sum() + BUCKETS)) - np.log(prior)
    if not toxic_rows:
        return Model(rate, np.zeros(BUCKETS))
    docs, clean, usual = v[LABELLED_DOCS], v[LABELLED_DOCS] - v[TOXIC_DOCS], 1 - toxic_rows / known_rows
    ratio = np.log((clean + SMOOTH * usual) / (docs + SMOOTH) / usual) if usual else np.zeros(BUCKETS)
    sure = np.maximum(evidence(clean, docs * usual) + evidence(docs - clean, docs * (1 - usual)), 0) ** STEEP
    signs = ratio * sure / (sure + HALF**STEEP)
    return Model(rate, np.where(signs <= -LEAST, signs, 0.0))


def threshold(good: np.ndarray, bad: np.ndarray) -> float:
    """Below which to reject: the share of bad less ``COST`` times that of good there is greatest (the middle of the best stretch)."""
    if not len(good):
        return -np.inf
    at = np.unique(np.concatenate([good, bad]))
    mid = np.concatenate([at[:1] - (float(np.std(good)) or 1.0), (at[1:] + at[:-1]) / 2])
    if not len(bad):
        return float(mid[0])
    value = np.searchsorted(np.sort(bad), mid) / len(bad) - COST * np.searchsorted(np.sort(good), mid) / len(good)
    best = np.flatnonzero(value >= value.max() - 1e-12)
    return float(mid[best[len(best) // 2]])


SCORES = "doc_id bigint, rate double, signs double, words double, noise double, kind int, quality int, toxic int, fold int"


def gumbel(ident: str, text: str, seed: int = 0) -> Column:
    """Standard Gumbel noise from a hash of id and text."""
    u = (F.shiftrightunsigned(F.xxhash64(F.col(ident), F.col(text), F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(u))


def scored(rows: DataFrame, model: Model) -> DataFrame:
    names = [f.split()[0] for f in SCORES.split(", ")]

    def run(batches):
        for batch in batches:
            arrays = [batch.column(0), *map(pa.array, model.score(batch.column(1))), *(batch.column(i) for i in range(2, 7))]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    given = rows.select(F.col("doc_id").cast("long"), "text", gumbel("doc_id", "text").alias("noise"), "kind", F.col("quality").cast("int"), F.col("toxic").cast("int"), "fold")
    return map_texts(given, run, SCORES)


def kth_largest(df: DataFrame, column: str, k: int, bins: int = 4096, few: int = 10_000) -> float:
    """The k-th largest value, by histograms of at most bins rows, each within the one bin that holds it."""
    ends = df.agg(F.min(column).alias("a"), F.max(column).alias("b"), F.count(column).alias("n")).first()
    if not ends["n"] or k <= 0:
        return float("inf")
    if k >= ends["n"]:
        return ends["a"]
    low, high, above, inside = ends["a"], ends["b"], 0, ends["n"]
    held = df
    while inside > few and high > low:
        width = (high - low) / bins
        if low + width <= low:
            break
        number = F.least(F.floor((F.col(column) - low) / width), F.lit(bins - 1)).alias("bin")
        counts = {r["bin"]: (r["n"], r["a"], r["b"]) for r in held.groupBy(number).agg(F.count("*").alias("n"), F.min(column).alias("a"), F.max(column).alias("b")).collect()}
        for b in sorted(counts, reverse=True):
            n, a, z = counts[b]
            if above + n >= k:
                low, high, inside = a, z, n
                break
            above += n
        held = df.where((F.col(column) >= low) & (F.col(column) <= high))
    if high == low:
        return low
    rest = sorted((r[0] for r in held.select(column).collect()), reverse=True)  # at most few rows
    return rest[k - above - 1]


@dataclass
class Decision:
    model: Model
    cutoff: float
    scores: DataFrame


def decide(docs: DataFrame, labels: DataFrame, ident: str = "doc_id", text: str = "text", sample: int = SAMPLE, share: float | None = None) -> Decision:
    """Fits, calibrates and draws: scores has doc_id, rate, signs, words, weight (its log), noise, key and keep of every row."""
    rows = labelled(docs, labels, ident, text, sample)
    model = trained(*counted(rows))
    table = materialise(scored(rows, model), "scores")
    held = table.where("fold = 0 AND kind > 0").select("rate", "signs", "kind", "quality", "toxic").toPandas()  # at most SAMPLE rows
    good = held[held.kind == 1]
    model.rate_at = threshold(good.rate.to_numpy(), held[held.quality == 0].rate.to_numpy())
    model.signs_at = threshold(good.signs.to_numpy(), held[held.toxic == 1].signs.to_numpy())
    lack = lambda c, at: F.least(F.col(c) - F.lit(at), F.lit(0.0))
    table = table.withColumn("weight", F.col("words") * lack("rate", model.rate_at) + F.sqrt(F.col("words") + FEW_WORDS) * lack("signs", model.signs_at))
    table = table.withColumn("key", F.col("weight") + F.col("noise"))
    size = table.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.exp("weight")), F.lit(0.0)).alias("weights")).first()
    cutoff = kth_largest(table, "key", round(size["weights"] if share is None else share * size["n"]))
    out = table.select("doc_id", "rate", "signs", "words", "weight", "noise", "key", (F.col("key") >= cutoff).alias("keep"))
    return Decision(model, cutoff, out)


def keep(docs: DataFrame, labels: DataFrame, ident: str = "doc_id", text: str = "text", sample: int = SAMPLE, share: float | None = None) -> DataFrame:
    """The documents that are drawn, all their columns kept; the texts are scored again rather than joined."""
    decision = decide(docs, labels, ident, text, sample, share)
    m, cutoff = decision.model, decision.cutoff
    names = [f"c{i}" for i in range(len(docs.columns))]  # clashing names travel as numbers

    def run(batches):
        for batch in batches:
            key = m.weight(*m.score(batch.column(len(names)))) + batch.column(len(names) + 1).to_numpy()
            kept = key >= cutoff - 1e-9  # sums may differ in the last place
            yield batch.select(names).filter(pa.array(kept))

    given = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names)], F.col(text).alias("__text"), gumbel(ident, text).alias("__noise"))
    schema = ", ".join(f"{n} {given.schema[n].dataType.simpleString()}" for n in names)
    return map_texts(given, run, schema).select(*[F.col(n).alias(c) for c, n in zip(docs.columns, names)])
