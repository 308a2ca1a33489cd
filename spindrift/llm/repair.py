"""Repairs the structure of conversations by the cheapest edits.

A repaired conversation is empty, or an optional system turn and then pairs of a user
and an assistant turn: the initials of its roles match ``(s?(ua)+)?``.  Edits: K keeps a
turn (free), R gives it the role user or assistant (1), D deletes it (2), I inserts an
empty turn (5).  Blank and duplicate turns must go; truncated ones that stay cost 5 more.

The plan is a retained-subsequence program over the turns that stay, from the last to the
first.  For a turn retained in a role, what follows costs the deletions up to the next
retained turn (a difference of prefix sums), the inserts that the pair of roles calls for,
and the price of that turn onwards; the least of the latter, less its prefix sum, is kept
as one running minimum a role, so a turn costs a few comparisons.  Of equal plans that with
the least audit (edits in order) in ASCII wins.  Between two retained turns the deletions
stand before the inserts, as D < I, and audits of equal cost first differ where one still
deletes; so at each turn a later next turn is less, then more inserts, then K before R.

Turns are ordered by turn (nulls first), then role, then text.  The first fault of a turn
counts: blank (no character but space and \\t-\\r), duplicate (role and text seen earlier in
the conversation), truncated (the last such character is none of ``.!?``).  A role is kept
only if its first letter is s, u or a.  Null roles and texts are one space; null ids form
one conversation.  Extra columns are ignored.

Conversations of up to ``HELD`` bytes and ``HELD_TURNS`` turns are planned and written in one
pass over sorted partitions.  Longer ones take two: the first reads roles and faults alone
and tells the audit, the second writes the turns as they stream by, so a task holds the
audit (a byte a turn) and a batch.  The turns of one conversation stay in one task, since
its output is one sequence.
"""

from __future__ import annotations

import hashlib
from array import array

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import frugal, map_texts, materialise, small_side

REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
SPACES = " \t\n\x0b\f\r"
HELD, HELD_TURNS = 16 << 20, 50_000
FAULTS = ("", "blank", "duplicate", "truncated")
ROLES, START, END = "sua", 3, 3
NAMES = {1: "user", 2: "assistant"}
NO = 1 << 60
#: Inserts between a turn of one role (or the start) and the next retained one (or the end).
GAPS = {0: (NO, 0, 1, 2), 1: (NO, 1, 0, 1), 2: (NO, 0, 1, 0), START: (0, 0, 1, 0)}

EDITS = "conv_id bigint, at int, edit string, turn bigint, was string, fault string, role string, text string, cost bigint"
EDIT_NAMES = [f.split()[0] for f in EDITS.split(", ")]
EDIT_KINDS = (pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64())


def plan(initials, faults) -> tuple[str, int]:
    """The audit and cost of the cheapest edits of turns with these role initials and faults (0 to 3, see ``FAULTS``)."""
    n = len(faults)
    best = [(NO, 0)] * 3  # of each role: price of retaining a turn in it and all after, with the deletions before; that turn
    after = array("q", bytes(24 * n))  # of each turn and role: the next retained turn and its role

    def onwards(role: int, done: int) -> tuple[int, int]:
        """What follows a turn of this role after which `done` turns are dealt with: its price and the next turn and role."""
        gaps = GAPS[role]
        found = (DELETE * (n - done) + INSERT * gaps[END], -n, -gaps[END], n * 4 + END)
        for to in range(3):
            price, k = best[to]
            if price < NO and gaps[to] < NO:
                found = min(found, (price - DELETE * done + INSERT * gaps[to], -k, -gaps[to], k * 4 + to))
        return found[0], found[3]

    for j in range(n - 1, -1, -1):
        if faults[j] in (1, 2):
            continue
        own = ROLES.find(initials[j]) if initials[j] else -1
        new = list(best)
        for role in range(3):
            if role != own and role not in NAMES:
                continue
            price, then = onwards(role, j + 1)
            price += (role != own) * REROLE + (faults[j] == 3) * TRUNCATED + DELETE * j
            after[3 * j + role] = then
            if price < best[role][0]:
                new[role] = (price, j)
        best = new
    cost, then = onwards(START, 0)
    audit, at, role = [], 0, START
    while True:
        k, to = divmod(then, 4)
        audit.append("D" * (k - at) + "I" * GAPS[role][to])
        if k == n:
            return "".join(audit), cost
        audit.append("K" if initials[k] == ROLES[to] else "R")
        at, role, then = k + 1, to, after[3 * k + to]


def edited(conv_id, audit: str, rows):
    """The rows of ``EDITS`` that carry out an audit on turns (turn, role, text, fault); the first row names the conversation alone."""
    yield (conv_id, -1, None, None, None, None, None, None, 0)
    rows, state = iter(rows), ""
    for at, edit in enumerate(audit):
        due = "assistant" if state == "u" else "user"
        if edit == "I":
            yield (conv_id, at, edit, None, None, None, due, "", INSERT)
            state = due[0]
            continue
        turn, was, text, fault = next(rows)
        if edit == "D":
            yield (conv_id, at, edit, turn, was, FAULTS[fault], None, None, DELETE)
            continue
        role = was if edit == "K" else due
        yield (conv_id, at, edit, turn, was, FAULTS[fault], role, text, (edit == "R") * REROLE + (fault == 3) * TRUNCATED)
        state = role[0]


def batched(rows, size: int = 500, most: int = 1 << 20):
    """Rows of ``EDITS`` as Arrow batches of bounded length."""
    held, chars = [], 0
    for row in rows:
        held.append(row)
        chars += len(row[7] or "")
        if len(held) >= size or chars >= most:
            yield table(held)
            held, chars = [], 0
    if held:
        yield table(held)


def table(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), EDIT_KINDS)], names=EDIT_NAMES)


def conversations(batches):
    """(conv_id, rows) one after another; the rows must be read before the next conversation."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
    held = [next(rows, None)]

    def own(conv_id):
        while held[0] is not None and held[0][0] == conv_id:
            yield held[0][1:]
            held[0] = next(rows, None)

    while held[0] is not None:
        conv_id = held[0][0]
        one = own(conv_id)
        yield conv_id, one
        for _ in one:
            pass


def faulted(turns: DataFrame, conv: str, turn: str, role: str, text: str, dropped: str | None) -> DataFrame:
    """conv_id, turn, role, text, lost (the turn is named but gone), size."""
    space = F.lit(" ")
    return turns.select(
        F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role), space).alias("role"), F.coalesce(F.col(text), space).alias("text"),
        F.coalesce(F.col(dropped), F.lit(False)).alias("lost") if dropped else F.lit(False).alias("lost"),
    )


def fault(repeats: Column) -> Column:
    """The number in ``FAULTS`` of a turn, given how often its role and text stood before."""
    left = F.rtrim("text", F.lit(SPACES))
    return F.when(left == "", 1).when(repeats > 0, 2).when(~F.right(left, F.lit(1)).isin(".", "!", "?"), 3).otherwise(0).cast("int")


def in_order(rows: DataFrame, n: int, *first: str) -> DataFrame:
    """The turns with their faults, those of a conversation together and in order: one shuffle by conversation."""
    dealt = rows.repartition(n, "conv_id").withColumn("said", F.sha2(F.concat_ws("\x00", F.length("role"), "role", "text"), 256))
    seen = F.expr("row_number() OVER (PARTITION BY conv_id, lost, said ORDER BY turn NULLS FIRST) - 1")
    marked = dealt.withColumn("fault", F.when(F.col("lost"), -1).otherwise(fault(seen)).cast("int"))
    return marked.sortWithinPartitions("conv_id", *first, F.col("turn").asc_nulls_first(), "role", "text", F.col("fault") == 2)


def short_run(batches):
    def rows():
        for conv_id, given in conversations(batches):
            held = [r for r in given if r[3] >= 0]
            audit, _ = plan([r[1][:1] for r in held], [r[3] for r in held])
            yield from edited(conv_id, audit, held)

    return batched(rows())


def plan_run(batches):
    for conv_id, given in conversations(batches):
        initials, faults = bytearray(), bytearray()
        for initial, code in given:
            if code >= 0:
                initials += initial.encode() if initial in ROLES and initial else b"?"
                faults.append(code)
        audit, _ = plan(initials.decode(), faults)
        yield pa.RecordBatch.from_arrays([pa.array([conv_id], pa.int64()), pa.array([audit], pa.string())], names=["conv_id", "audit"])


def long_run(batches):
    def rows():
        for conv_id, given in conversations(batches):
            head = next(given)
            yield from edited(conv_id, head[2], (r for r in given if r[3] >= 0))

    return batched(rows())


def repair(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", dropped: str | None = None,
    partitions: int | None = None, held: int = HELD, held_turns: int = HELD_TURNS,
) -> DataFrame:
    """A row an edit, those of a conversation together and in order (see ``EDITS``), after a row (at -1) that names the conversation.

    dropped: a column that marks turns which are gone but whose conversation is still to be named.
    """
    n = partitions or int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = faulted(turns, conv, turn, role, text, dropped)
    sizes = rows.groupBy("conv_id").agg(F.sum(F.octet_length("text")).alias("b"), F.count("*").alias("m"))
    large = materialise(sizes.where((F.col("b") > held) | (F.col("m") > held_turns)).select(F.col("conv_id").alias("large")), "large")
    count = large.count()
    sent = ["conv_id", "turn", "role", "text", "fault"]
    if not count:
        return map_texts(in_order(rows, n).select(*sent), short_run, EDITS)
    side, same = small_side(large, count), F.col("conv_id").eqNullSafe(F.col("large"))
    short = map_texts(in_order(rows.join(side, same, "left_anti"), n).select(*sent), short_run, EDITS)
    rows = rows.join(side, same, "left_semi")
    initials = in_order(rows, n).select("conv_id", F.substring("role", 1, 1), "fault")
    audits = materialise(initials.mapInArrow(frugal(plan_run), "conv_id bigint, audit string"), "audits")
    head = audits.select("conv_id", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"), F.lit(True).alias("lost"), F.lit(0).alias("kind"))
    both = in_order(head.unionByName(rows.withColumn("kind", F.lit(1))), n, "kind")
    return short.unionByName(map_texts(both.select(*sent), long_run, EDITS))


REPORT = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
REPORT_NAMES = [f.split()[0] for f in REPORT.split(", ")]
REPORT_KINDS = (*[pa.int64()] * 7, pa.string(), pa.string())
LEGAL = {"su", "ua", "au"}


def told(conv_id, rows) -> tuple:
    """A row of ``REPORT`` from the edits of a conversation."""
    counts, cost, audit, digest, wrote = dict.fromkeys(FAULTS, 0), 0, [], hashlib.sha256(), False
    low = turn_before = None
    turns = illegal = 0
    before = None
    for at, edit, turn, was, why, role, text, price in rows:
        if at < 0:
            continue
        audit.append(edit)
        cost += price
        if edit != "I":
            counts[why] += 1
            if turn is not None and turn != turn_before:
                low, turn_before, turns = turn if low is None else low, turn, turns + 1
            illegal += before is not None and before + was[:1] not in LEGAL
            before = was[:1]
        if edit != "D":
            digest.update(f"{chr(10) if wrote else ''}{role}:{text}".encode())
            wrote = True
    gaps = 0 if low is None else turn_before - low + 1 - turns
    return conv_id, gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, "".join(audit), digest.hexdigest()


def report(edits: DataFrame) -> DataFrame:
    """What ``repair`` did to each conversation: gaps in its turns, faults, illegal neighbours, the cost, the audit, a digest of the repaired turns (role:text, joined by newlines).

    The rows must stand as ``repair`` left them.
    """

    def run(batches):
        done = []
        for conv_id, rows in conversations(batches):
            done.append(told(conv_id, rows))
            if len(done) >= 200:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), REPORT_KINDS)], names=REPORT_NAMES)
                done = []
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), REPORT_KINDS)], names=REPORT_NAMES)

    return edits.mapInArrow(frugal(run), REPORT)


def damage(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, dropped: each turn hurt by the remainder by 20 of crc32 of ``conv_id:turn`` (null: one space).

    0 drops it, 1 empties its text, 2 takes ``.!?`` from it, 3 repeats it, 4 makes it the user's; others leave it.
    """
    space = F.lit(" ")
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")])
    text, role = F.coalesce("text", space), F.coalesce("role", space)
    hurt = turns.select(
        "conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(key) % 20).alias("by"),
    )
    hurt = hurt.select(
        "conv_id", "turn",
        F.when(F.col("by") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("by") == 1, "").when(F.col("by") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        (F.col("by") == 0).alias("dropped"), F.when(F.col("by") == 3, 2).otherwise(1).alias("times"),
    )
    return hurt.withColumn("time", F.explode(F.sequence(F.lit(1), "times"))).drop("times", "time")
