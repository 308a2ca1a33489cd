"""Best-fit packing by linear grouping.

The plan needs only how many pieces there are of each length (at most ``capacity``
numbers, whatever the corpus holds).  Lengths above ``capacity // SMALL`` are large:
they are rounded up to the longest of their group, the groups having equal numbers
of pieces; a configuration program over the few rounded lengths (column generation,
priced by a knapsack) says how often to use which combination; actual pieces take
the places of their group, the last place of a sequence going to the longest piece
that still fits (so nothing is lost to rounding); what is left over, and the small
ones, go by best fit, longest first, into the fullest sequence that takes them.
Sequences that rounding left too empty are undone before that, their pieces being left
over too; of a few bounds for too empty (from none undone to all, which is best fit
decreasing alone) that with the fewest sequences is taken, so the plan never needs more
than best fit decreasing.  The column generation ends when no configuration would gain
more than ``GAP``, or after ``ROUNDS``.  All of this is done on runs (so many sequences of
the same make), so its size follows the number of lengths, not of documents.

Documents are cut only where longer than ``capacity``.  Null text is empty and has
the end token alone.  Rows that repeat are packed each.  Columns beyond id and text
are ignored.  An empty table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spindrift.llm.common import map_texts, materialise, small_side
from spindrift.llm.tokens import WordTokenizer

CAPACITY = 2048
SMALL = 8
GROUPS = 64
GAP = 0.001
ROUNDS = 800
#: Parts (tasks that cut documents) whose bases are broadcast, 8 * CAPACITY bytes each.
PARTS = 4000

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids binary, part int, place bigint"


def cut(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, ident: str = "doc_id", text: str = "text", end: int = 0) -> DataFrame:
    """The pieces of all documents, written as a table.

    ids: little-endian unsigned 32-bit.  part and place: the task that cut the piece, and how many of the same length it cut before.
    """

    def run(batches):
        words = WordTokenizer(tokenizer, end)
        part, seen = TaskContext.get().partitionId(), defaultdict(int)
        names = [f.split()[0] for f in PIECES.split(", ")]
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64())

        def table(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 7, kinds)], names=names)

        for batch in batches:
            rows, size = [], 0
            for doc, ids in words.encode_rows(batch):
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    held = ids[start : start + capacity]
                    n = len(held)
                    rows.append((doc, piece, start, n, held.astype("<u4").tobytes(), part, seen[n]))
                    seen[n] += 1
                    size += n
                if size > 1 << 19:
                    yield table(rows)
                    rows, size = [], 0
            if rows:
                yield table(rows)

    given = docs.select(F.col(ident).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return materialise(map_texts(given, run, PIECES), "pieces")


def knapsack(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes within capacity: its value, and how many of each."""
    best = np.zeros(capacity + 1)
    layers = []
    room = np.arange(capacity + 1)[None, :] - sizes[:, None]
    fits, back = room >= 0, np.maximum(room, 0)
    for _ in range(capacity // int(sizes.min())):
        gained = np.where(fits, best[back] + values[:, None], -1.0)
        pick = gained.argmax(axis=0)
        value = gained[pick, np.arange(capacity + 1)]
        better = value > best + 1e-12
        if not better.any():
            break
        layers.append((pick, better))
        best = np.where(better, value, best)
    counts, left = np.zeros(len(sizes)), capacity
    for pick, better in reversed(layers):
        if better[left]:
            counts[pick[left]] += 1
            left -= int(sizes[pick[left]])
    return float(best[capacity]), counts


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """(how many of each size, how many sequences): the configuration program's solution, rounded down."""
    k = len(sizes)
    columns = np.diag(np.maximum(1, capacity // sizes)).astype(float)
    for turn in range(ROUNDS):
        inverse = np.linalg.inv(columns) if turn % 50 == 0 else inverse
        used = inverse @ demand
        prices = np.ones(k) @ inverse
        value, column = knapsack(np.maximum(prices, 0), sizes, capacity)
        if value <= 1 + GAP:
            break
        step = inverse @ column
        ahead = step > 1e-9
        if not ahead.any():
            break
        ratio = np.full(k, np.inf)
        ratio[ahead] = np.maximum(used[ahead], 0) / step[ahead]
        leaves = int(ratio.argmin())
        columns[:, leaves] = column
        row = inverse[leaves] / step[leaves]
        inverse = inverse - np.outer(step, row)
        inverse[leaves] = row
    used = np.linalg.solve(columns, demand)
    return [(columns[:, j].round().astype(int), int(np.floor(used[j] + 1e-6))) for j in range(k) if used[j] >= 1 - 1e-6]


class Runs:
    """Sequences by makeup: so many of the same make stand together, by the room they have left.  A make is a chain (make before, length)."""

    def __init__(self, capacity: int):
        self.capacity, self.made = capacity, 0
        self.by_room: dict[int, list[tuple[tuple | None, int]]] = defaultdict(list)
        self.rooms = np.zeros(capacity + 1, bool)

    def add(self, room: int, make: tuple | None, count: int) -> None:
        self.by_room[room].append((make, count))
        self.rooms[room] = True

    def best_fit(self, left: dict[int, int]) -> None:
        """Places all pieces left (length: how many), longest first, each into the fullest sequence that takes it."""
        for n in sorted(left, reverse=True):
            waiting = left[n]
            while waiting:
                fitting = np.flatnonzero(self.rooms[n:])
                if len(fitting):
                    room = n + int(fitting[0])
                    make, count = self.by_room[room].pop()
                    if not self.by_room[room]:
                        self.rooms[room] = False
                else:
                    room, make = self.capacity, None
                    count = -(-waiting // (self.capacity // n))
                    self.made += count
                taken = min(count, waiting)
                if taken < count:
                    self.add(room, make, count - taken)
                self.add(room - n, (make, n), taken)
                waiting -= taken


def grouped(left: dict[int, int], capacity: int, groups: int, small: int) -> list[tuple[int, tuple, int]]:
    """(room, make, count) of the sequences that the configurations of the large lengths make of actual pieces; takes them from left."""
    large = sorted((n for n in left if capacity // small < n < capacity and left[n]), reverse=True)
    if not large:
        return []
    waiting = np.zeros(capacity + 1, bool)
    waiting[large] = True

    def take(most: int, make: tuple | None, count: int, used: int):
        """Fills a place of count sequences with the longest pieces of at most that length: (make, count, used)."""
        while count:
            held = np.flatnonzero(waiting[: most + 1])
            if not len(held):
                yield make, count, used
                return
            n = int(held[-1])
            c = min(count, left[n])
            left[n] -= c
            waiting[n] = left[n] > 0
            yield (make, n), c, used + n
            count -= c

    each, held, members = max(1, -(-sum(left[n] for n in large) // groups)), 0, [[]]
    for n in large:  # a length stays whole, so groups are equal but for the last length in each
        members[-1].append(n)
        held += left[n]
        if held >= each:
            members.append([])
            held = 0
    members = [m for m in members if m]
    sizes = np.array([m[0] for m in members])
    demand = np.array([sum(left[n] for n in m) for m in members], float)
    out = []
    for column, count in configurations(sizes, demand, capacity):
        runs = [(None, count, 0)]
        places = np.repeat(sizes, column)
        for i, most in enumerate(places):
            runs = [r for make, c, used in runs for r in take(capacity - used if i == len(places) - 1 else int(most), make, c, used)]
        out += [(capacity - used, make, c) for make, c, used in runs if make]
    return out


def lengths_of(make: tuple | None) -> list[int]:
    out = []
    while make:
        make, n = make
        out.append(n)
    return out[::-1]


def plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, small: int = SMALL) -> tuple[np.ndarray, int]:
    """Rows (length, rank, count, sequence, offset) and the number of sequences.

    The pieces of that length with ranks from rank on, count of them, go to as many
    sequences from sequence on, each at that offset.
    """
    left = {n: c for n, c in counts.items() if c}
    made = grouped(left, capacity, groups, small)
    best = None
    # sequences of the configurations that have more room left than that are undone again
    for most in [capacity, *(capacity >> i for i in range(4, capacity.bit_length() + 1)), -1]:
        runs, rest = Runs(capacity), dict(left)
        for room, make, count in made:
            if room <= most:
                runs.made += count
                runs.add(room, make, count)
            else:
                for n in lengths_of(make):
                    rest[n] += count
        runs.best_fit({n: c for n, c in rest.items() if c})
        if best is None or runs.made < best.made:
            best = runs
    rows, ranks, first = [], dict.fromkeys(counts, 0), 0
    for held in best.by_room.values():
        for make, count in held:
            offset = 0
            for n in lengths_of(make):
                rows.append((n, ranks[n], count, first, offset))
                ranks[n] += count
                offset += n
            first += count
    rows = np.array(rows, np.int64).reshape(-1, 5)
    return rows[np.lexsort((rows[:, 1], rows[:, 0]))], best.made


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, ident: str = "doc_id", text: str = "text", end: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids, sequence_id, offset of every piece."""
    pieces = cut(docs, tokenizer, capacity, ident, text, end)
    held = materialise(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "lengths")
    lengths = {r["length"]: r["n"] for r in held.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    rows, _ = plan(lengths, capacity)
    length, rank, _, sequence, offset = (np.ascontiguousarray(rows[:, i]) for i in range(5))
    most = max([1, *lengths.values()])
    keys = length * most + rank

    @F.pandas_udf("sequence_id bigint, offset bigint")
    def find(n: pd.Series, r: pd.Series) -> pd.DataFrame:
        n, r = n.to_numpy(), r.to_numpy()
        i = np.searchsorted(keys, n * most + r, side="right") - 1
        return pd.DataFrame({"sequence_id": sequence[i] + r - rank[i], "offset": offset[i]})

    # of each part, what earlier parts hold of every length: one row a part, of capacity numbers
    before = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    bases = held.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    told = bases.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("length", "base"))).alias("by"))
    told = materialise(told.select("part", F.transform(F.sequence(F.lit(1).cast("long"), F.lit(capacity).cast("long")), lambda n: F.coalesce(F.element_at("by", n), F.lit(0).cast("long"))).alias("bases")), "bases")
    ranked = pieces.join(small_side(told, told.count(), PARTS), "part")
    own = F.element_at("bases", F.col("length").cast("int")) + F.col("place")
    found = ranked.select("doc_id", "piece", "start", "length", "ids", own.alias("rank")).withColumn("at", find("length", "rank"))
    return found.select("doc_id", "piece", "start", "length", "ids", "at.sequence_id", "at.offset")
