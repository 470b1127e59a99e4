"""Conversation repair against a search through all audits, a plain dynamic program, and on odd rows."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from fedloom.llm import dialogue
from fedloom.llm.dialogue import cheapest, repair_conversations, repaired_rows
from fedloom.llm.queries import op13

SF = "/root/testdata/sf0.001"
SPACE = " \t\n\x0b\x0c\r"


def outcomes(rows, audit):
    """Cost of an audit applied to (initial, must go, cut off) rows, or None where it is no repair."""
    i = cost = 0
    roles = ""
    for letter in audit:
        if letter == "I":
            cost, roles = cost + 3, roles + "?"
            continue
        if i == len(rows):
            return None
        initial, useless, cut = rows[i]
        i += 1
        if letter == "D":
            cost += 4
        elif useless:
            return None
        else:
            cost += 3 * cut + 3 * (letter == "R")
            roles += "?" if letter == "R" else initial or "x"
    if i < len(rows):
        return None
    wild = any(
        re.fullmatch("(s?(ua)+)?", "".join(next(chosen) if c == "?" else c for c in roles))
        for chosen in map(iter, itertools.product("ua", repeat=roles.count("?")))
    )
    return cost if wild else None


def test_cheapest_is_the_least_of_all_audits():
    r = random.Random(3)
    for _ in range(60):
        rows = [(r.choice(["s", "u", "u", "a", "a", "t", ""]), r.random() < 0.25, r.random() < 0.3) for _ in range(r.randint(0, 4))]
        audits = ("".join(a) for n in range(len(rows), len(rows) + 4) for a in itertools.product("DIKR", repeat=n))
        found = min((c, a) for a in audits if (c := outcomes(rows, a)) is not None)
        assert cheapest(rows) == found, rows


def least(rows):
    """Cheapest audit by states row after row; inserts are closed over at each place."""
    turn = {"": "u", "s": "u", "u": "a", "a": "u"}

    def closed(now):
        for _ in range(3):
            for s, (c, a) in list(now.items()):
                t = turn[s]
                now[t] = min(now.get(t, (c + 3, a + "I")), (c + 3, a + "I"))
        return now

    now = closed({"": (0, "")})
    for initial, useless, cut in rows:
        after = {}
        for s, (c, a) in now.items():
            ways = [(s, c + 4, "D")]
            if not useless:
                ways.append((turn[s], c + 3 + 3 * cut, "R"))
                if (s, initial) in {("", "s"), ("", "u"), ("s", "u"), ("a", "u"), ("u", "a")}:
                    ways.append((initial, c + 3 * cut, "K"))
            for t, cost, x in ways:
                after[t] = min(after.get(t, (cost, a + x)), (cost, a + x))
        now = closed(after)
    return min(now[s] for s in ("", "a") if s in now)


def brute(rows, damage=lambda conv, turn: None):
    convs = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = damage(conv, turn)
        held = convs.setdefault(conv, [])
        if kind == 1:
            text = ""
        elif kind == 2:
            text = re.sub("[.!?]", "", text)
        elif kind == 4:
            role = "user"
        held += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    for conv, held in convs.items():
        held.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))
        faults, seen = [], set()
        for _, role, text in held:
            body = text.rstrip(SPACE)
            faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
            seen.add((role, text))
        lattice = [(role[:1], f in ("blank", "duplicate"), f == "truncated") for (_, role, _), f in zip(held, faults, strict=True)]
        turns = {t for t, _, _ in held if t is not None}
        cost, audit = least(lattice)
        state, out, source = "", [], iter(held)
        for x in audit:
            role, text = ("", "") if x == "I" else next(source)[1:]
            if x == "D":
                continue
            if x != "K":
                role = "assistant" if state == "u" else "user"
            state = role[:1]
            out.append(f"{role}:{text}")
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(held))
        yield (
            conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"),
            illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest(),
        ), out


def told(rows):
    return sorted(map(str, (tuple(r) for r in rows)))


def crc(conv, turn):
    return zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20


def test_the_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert told(op13(spark, SF).collect()) == told(v for v, _ in brute(rows, crc))


def conversation(r, conv, n):
    texts = ["", " \n", "yes.", "no", "Really?", "é!\x0b", None, "a.b", " "]
    turn = 0
    for _ in range(n):
        turn += r.choice([0, 1, 1, 1, 1, 3])
        yield conv, r.choice([turn] * 9 + [None]), r.choice(["user", "user", "assistant", "assistant", "system", "tool", "", None]), r.choice(texts) if r.random() < 0.5 else f"t{r.randint(0, 10**6)}."


@pytest.fixture(scope="module")
def odd():
    r = random.Random(8)
    rows = [x for conv in range(150) for x in conversation(r, conv, r.randint(0, 14))]
    return rows + list(conversation(r, None, 9)) + list(conversation(r, 999, 700)) + [(1000, 1, "user", "Hi."), (1000, 1, "user", "Hi."), (1001, None, "user", "")]


@pytest.mark.parametrize("size", [256, 3, 1])
def test_odd_rows_and_segments_equal_brute_force(spark, odd, size, monkeypatch):
    monkeypatch.setattr(dialogue, "ROWS", size)
    if size < 256:  # the workers import the module anew, so short segments are tried here
        for conv in (7, 8, 9, 999):
            own = [x for x in odd if x[0] == conv]
            for (verdict, _) in brute(own):
                repair, seen = dialogue.Repair(), set()
                for turn, role, text in sorted(((t, " " if a is None else a, " " if b is None else b) for _, t, a, b in own), key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode())):
                    body = text.rstrip(SPACE)
                    repair.add(turn, role, text, not body, (role, text) in seen, body[-1:] not in ".!?")
                    seen.add((role, text))
                assert (conv, *repair.finish()) == verdict
        return
    df = spark.createDataFrame(odd, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(1) for c in ("conv", "live", "same", "blank", "again", "cost")})
    assert told(repair_conversations(df).collect()) == told(v for v, _ in brute(odd))
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    damage = F.crc32(key.cast("binary")) % 20
    assert told(repair_conversations(df, damage).collect()) == told(v for v, _ in brute(odd, crc))
    written = repaired_rows(df, damage).collect()
    expected = [(v[0], i, x) for v, out in brute(odd, crc) for i, x in enumerate(out)]
    assert told((r.conv_id, r.place, f"{r.role}:{r.text}") for r in written) == told(expected)


def test_empty_tables_and_a_single_shuffle(spark, odd):
    df = spark.createDataFrame(odd, "conv_id long, turn long, role string, text string")
    assert repair_conversations(df.limit(0)).collect() == [] and repaired_rows(df.limit(0)).collect() == []
    plan = repair_conversations(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
