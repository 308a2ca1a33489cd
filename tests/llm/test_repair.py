"""Conversation repair: the plan against all edits, the rows against a plain reading of the rules."""

import hashlib
import itertools
import random
import re
import zlib

from spindrift.llm import repair

PATTERN = re.compile("(s?(ua)+)?")
INSERTS = [(), ("u",), ("a",), ("u", "a"), ("a", "u")]


def all_edits(initials, faults):
    """(cost, audit) of the cheapest edits, by trying all of them."""
    n, best = len(faults), (1 << 30, "")
    options = []
    for c, f in zip(initials, faults):
        own = [("D", "", 2)]
        if f not in (1, 2):
            extra = 5 * (f == 3)
            own += [("K", c, extra)] if c else []
            own += [("R", "u", 1 + extra), ("R", "a", 1 + extra)]
        options.append(own)
    for edits in itertools.product(*options):
        for inserts in itertools.product(INSERTS, repeat=n + 1):
            roles, audit, cost = "".join(inserts[0]), "I" * len(inserts[0]), 5 * len(inserts[0])
            for (e, r, p), more in zip(edits, inserts[1:]):
                roles, audit, cost = roles + r + "".join(more), audit + e + "I" * len(more), cost + p + 5 * len(more)
            if (cost, audit) < best and PATTERN.fullmatch(roles):
                best = (cost, audit)
    return best


def forward(initials, faults):
    """The same by a forward program that carries whole audits."""
    gaps = {"-": {"s": 0, "u": 0, "a": 1}, "s": {"u": 0, "a": 1}, "u": {"a": 0, "u": 1}, "a": {"u": 0, "a": 1}}
    states = {"-": (0, "")}
    for c, f in zip(initials, faults):
        new = {s: (cost + 2, audit + "D") for s, (cost, audit) in states.items()}
        for s, (cost, audit) in states.items():
            for r, ins in gaps[s].items() if f not in (1, 2) else ():
                if r == c or r != "s":
                    one = (cost + 5 * ins + (r != c) + 5 * (f == 3), audit + "I" * ins + ("K" if r == c else "R"))
                    new[r] = min(new.get(r, one), one)
        states = new
    ends = {"-": 0, "s": 2, "u": 1, "a": 0}
    return min((cost + 5 * ends[s], audit + "I" * ends[s]) for s, (cost, audit) in states.items())


def test_plan_against_all_edits():
    rng = random.Random(3)
    assert repair.plan("", []) == ("", 0)
    for n, times in ((1, 30), (2, 60), (3, 25)):
        for _ in range(times):
            initials, faults = [rng.choice(["s", "u", "a", "t", ""]) for _ in range(n)], [rng.choice([0, 0, 0, 1, 2, 3]) for _ in range(n)]
            audit, cost = repair.plan(initials, faults)
            assert (cost, audit) == all_edits(initials, faults)


def test_plan_against_forward_program():
    rng = random.Random(4)
    for _ in range(3000):
        n = rng.randrange(0, 40)
        odds = rng.choice([[0] * 9 + [1], [0, 0, 0, 3], [0, 1, 2, 3], [0]])
        initials, faults = [rng.choice(rng.choice(["ua", "sua", "uuuat"])) for _ in range(n)], [rng.choice(odds) for _ in range(n)]
        audit, cost = repair.plan(initials, faults)
        assert (cost, audit) == forward(initials, faults)


ROWS = [
    (1, 0, "user", "hello there."), (1, 1, "assistant", "yes!"), (1, 1, "assistant", "yes!"), (1, 3, "assistant", "cut"), (1, 4, "user", " \t\n"),
    (2, None, None, None), (2, 5, "system", "be good."), (2, 9, "user", "no?"), (3, 0, "User", "upper."), (3, 0, "user", "tie b."), (3, 0, "user", "tie a."),
    (None, 1, "user", "no id."), (None, 2, "assistant", "still."), (4, 0, "user", ""), (5, 7, "", "no role."), (5, 8, "assistant", "x" * 40_000 + ". \x0b"),
    (6, 2, "uncle", "kept as it is."), (6, 3, "aunt", "too."), (7, None, "user", "a."), (7, None, "user", "b."),
]


def many():
    rng = random.Random(8)
    return [(100 + i % 40, rng.randrange(12), rng.choice(["user", "assistant", "system", "user"]), rng.choice(["one.", "two", "three?", "", " ", "Ünï.", "four! "])) for i in range(600)]


def expected(rows):
    """Report rows by the rules, from rows (conv_id, turn, role, text) as they are in the table."""
    held = {}
    for conv, turn, role, text in rows:
        held.setdefault(conv, [])
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        role = "user" if code == 4 else role
        held[conv] += [(turn, role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
    out = {}
    for conv, turns in held.items():
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults = set(), []
        for _, role, text in turns:
            left = text.rstrip(" \t\n\x0b\x0c\r")
            faults.append(1 if not left else 2 if (role, text) in seen else 3 if left[-1] not in ".!?" else 0)
            seen.add((role, text))
        initials = [r[1][:1] for r in turns]
        cost, audit = forward(initials, faults)
        lines, state, at = [], "", 0
        for e in audit:
            due = "assistant" if state == "u" else "user"
            if e == "I":
                lines.append(f"{due}:")
                state = due[0]
                continue
            _, role, text = turns[at]
            at += 1
            if e != "D":
                lines.append(f"{role if e == 'K' else due}:{text}")
                state = lines[-1][0]
        known = [t for t, _, _ in turns if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        out[conv] = (gaps, faults.count(1), faults.count(2), faults.count(3), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def got(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def test_report_against_the_rules(spark):
    rows = ROWS + many()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, fault string, said int").repartition(3)
    damaged = repair.damage(df)
    want = expected(rows)
    assert got(repair.report(repair.repair(damaged, dropped="dropped"))) == want
    # conversations too long to be held take two passes
    assert got(repair.report(repair.repair(damaged, dropped="dropped", held=200, held_turns=6))) == want
    assert got(repair.report(repair.repair(damaged, dropped="dropped", held=0, held_turns=0))) == want


def test_edits_and_empty_table(spark):
    df = spark.createDataFrame([(1, 1, "assistant", "so."), (1, 2, "user", "cut"), (1, 3, "assistant", "ok.")], "conv_id long, turn long, role string, text string")
    rows = repair.repair(df).collect()
    assert [(r["edit"], r["role"], r["text"], r["fault"]) for r in rows] == [(None,) * 4, ("R", "user", "so.", ""), ("D", None, None, "truncated"), ("K", "assistant", "ok.", "")]
    none = spark.createDataFrame([], df.schema)
    assert repair.report(repair.repair(repair.damage(none), dropped="dropped")).count() == 0
