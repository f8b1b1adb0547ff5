"""Conversation repair against an exhaustive search and a plain table of whole audits."""

import hashlib
import itertools
import random
import zlib
from collections import defaultdict

import pytest

from gleaner.llm import dialogues

AFTER = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        kept = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not kept else "duplicate" if (role, text) in seen else "" if kept[-1] in ".!?" else "truncated"
        seen.add((role, text))
        out.append(fault)
    return out


def best(rows, marks):
    """(cost, audit, repaired): a table of the least (cost, whole audit) for each row and state, insertions anywhere."""
    table = {"": (0, "", ())}

    def inserted(table):
        for _ in range(3):
            for state, (cost, audit, kept) in list(table.items()):
                for role in ("user", "assistant"):
                    if (after := AFTER.get((state, role[0]))) is not None:
                        put(table, after, (cost + 5, audit + "I", (*kept, f"{role}:")))

    def put(table, state, found):
        if state not in table or found[:2] < table[state][:2]:
            table[state] = found

    for (_, role, text), fault in zip(rows, marks):
        inserted(table)
        new = {}
        for state, (cost, audit, kept) in table.items():
            put(new, state, (cost + 2, audit + "D", kept))
            if fault in ("blank", "duplicate"):
                continue
            extra = 5 if fault else 0
            for letter, own, price in (("K", role, 0), ("R", "user", 1), ("R", "assistant", 1)):
                if (after := AFTER.get((state, own[:1]))) is not None:
                    put(new, after, (cost + price + extra, audit + letter, (*kept, f"{own}:{text}")))
        table = new
    inserted(table)
    return min((table[s] for s in ("", "a") if s in table), key=lambda x: x[:2])


def exhaustive(rows, marks):
    """The least (cost, audit) over all edits of all rows with up to two insertions in each gap."""
    ways = [[("D", None)] if m in ("blank", "duplicate") else [("D", None), ("K", r[1][:1]), ("R", "u"), ("R", "a")] for r, m in zip(rows, marks)]
    found = []
    for gaps in itertools.product(*[[(), ("u",), ("a",), ("u", "a"), ("a", "u")]] * (len(rows) + 1)):
        if sum(map(len, gaps)) > 2:
            continue
        for chosen in itertools.product(*ways):
            roles, audit, cost = list(gaps[0]), "I" * len(gaps[0]), 5 * len(gaps[0])
            for (letter, role), mark, gap in zip(chosen, marks, gaps[1:]):
                audit += letter + "I" * len(gap)
                cost += {"D": 2, "K": 0, "R": 1}[letter] + 5 * len(gap) + (5 if mark == "truncated" and letter != "D" else 0)
                roles += ([role] if letter != "D" else []) + list(gap)
            state = ""
            for role in roles:
                state = AFTER.get((state, role), "bad")
            if state in ("", "a"):
                found.append((cost, audit))
    return min(found)


def damage(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        own = out[conv]
        if kind == 0:
            continue
        if kind in (1, 2):
            text = "" if kind == 1 else "".join(c for c in text if c not in ".!?")
        own += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return {c: sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())) for c, rows in out.items()}


def summary(conv, rows):
    marks = faults(rows)
    cost, audit, kept = best(rows, marks)
    turns = [t for t, _, _ in rows if t is not None]
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(marks.count(m) for m in ("blank", "duplicate", "truncated")),
            illegal, cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest())


def corpus(seed=5, conversations=150):
    rnd = random.Random(seed)
    out = []
    for conv in range(conversations):
        for turn in range(rnd.randrange(1, 12)):
            if rnd.random() < 0.06:
                continue
            role = rnd.choice(["user", "assistant"] * 4 + ["system", "tool", "", None])
            role = ("user", "assistant")[turn % 2] if rnd.random() < 0.6 else role
            text = rnd.choice(["Yes.", "No!", "And then", "", None, " \n\t", "Größe? \x0b", "same.", "\x1c", "x" * 50 + "."])
            out.append((conv, None if rnd.random() < 0.05 else turn, role, text))
    out += [(None, t, r, "hello.") for t, r in ((0, "user"), (1, "assistant"), (None, "user"))]
    out += [(900, None, "user", "a."), (900, None, "assistant", "b."), (901, 3, "user", "q."), (901, 3, "user", "q."), (901, 9, "assistant", "r.")]
    out += [(902, t, "human", f"t{t}.") for t in range(300)] + [(903, t, ("user", "assistant")[t % 2], "long. " * 20_000 + str(t) + ".") for t in range(4)]
    return out


def test_search_is_the_exhaustive_one():
    rnd = random.Random(3)
    for _ in range(60):
        rows = [(k, rnd.choice(["user", "assistant", "system", "tool"]), rnd.choice(["a.", "b", "", f"{k}."])) for k in range(rnd.randrange(5))]
        marks = faults(rows)
        assert best(rows, marks)[:2] == exhaustive(rows, marks)


def test_repairer_settles_early_and_equals_the_table():
    rnd = random.Random(4)
    for _ in range(400):
        rows = [(k, rnd.choice(["user", "assistant", "system", "x"]), rnd.choice(["a.", "b", "", f"{k}."])) for k in range(rnd.randrange(40))]
        marks = faults(rows)
        repairer, got = dialogues.Repairer(), []
        for (_, role, _), mark in zip(rows, marks):
            got += repairer.push(role[0] if role[0] in "sua" else "", mark)
        got += repairer.finish()
        assert (repairer.cost, "".join(e for e, _ in got)) == best(rows, marks)[:2]


def test_memory_stays_bounded():
    repairer, pending, most = dialogues.Repairer(), 0, 0
    for k in range(30_000):
        pending += 1
        pending -= sum(1 for _ in repairer.push("ua"[k % 2] if k % 7 else "u", "truncated" if k % 11 == 0 else ""))
        most = max(most, pending)
    assert most < 200


@pytest.fixture(scope="module")
def conversations(spark):
    schema = "conv_id long, turn long, role string, text string, later boolean, copies int, digest string, first long"
    return spark.createDataFrame([(*r, True, 9, "d", 1) for r in corpus()], schema).repartition(5).cache()


def test_summaries(conversations):
    got = sorted((tuple(r) for r in dialogues.summaries(dialogues.damaged(conversations)).collect()), key=str)
    want = sorted((summary(c, rows) for c, rows in damage(corpus()).items()), key=str)
    assert got == want
    assert dialogues.summaries(dialogues.damaged(conversations.limit(0))).count() == 0


def test_edits_are_the_repaired_conversation(conversations):
    made = defaultdict(list)
    for r in dialogues.edits(dialogues.damaged(conversations)).collect():
        made[r.conv_id].append(r)
    want = {c: summary(c, rows) for c, rows in damage(corpus()).items()}
    assert set(made) == {c for c, s in want.items() if s[7]}
    for conv, rows in made.items():
        rows.sort(key=lambda r: r.position)
        assert [r.position for r in rows] == list(range(len(rows)))
        assert "".join(r.edit for r in rows) == want[conv][7]
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in rows if r.edit != "D").encode()).hexdigest() == want[conv][8]


def test_whole_conversations_without_damage(spark):
    rows = [("c", 0, "user", "Hi"), ("c", 1, "assistant", "Yes."), ("d", 0, "assistant", "Only."), ("", 0, "user", "x."), (None, 0, "user", "x.")]
    frame = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")
    got = {r.conv_id: (r.cost, r.audit) for r in dialogues.summaries(dialogues.undamaged(frame)).collect()}
    assert got == {"c": (4, "DD"), "d": (2, "D"), "": (2, "D"), None: (2, "D")}
