"""Conversation repair against enumeration, long ties, folding, damage and odd tables."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from acrescope.llm import conversation_repair as C

SHAPE = re.compile("(s?(ua)+)?")
EMPTY = hashlib.sha256(b"").hexdigest()


def sha(rows):
    return hashlib.sha256("\n".join(f"{r}:{t}" for r, t in rows).encode()).hexdigest()


def faults(rows):
    """(role, text, first fault or '') of rows in order."""
    seen, out = set(), []
    for role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated"
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def enumerate_repairs(rows):
    """Cheapest (cost, audit, repaired rows) over all edits, with at most two inserted rows in a place."""
    rows = faults(rows)
    gaps = [("", [])] + [("I" * n, [(r, "") for r in roles]) for n in (1, 2) for roles in itertools.product(("user", "assistant"), repeat=n)]
    best = None
    choices = []
    for role, text, fault in rows:
        here = [("D", [], 2)]
        if fault not in ("blank", "duplicate"):
            extra = 5 * (fault == "truncated")
            here += [("K", [(role, text)], extra), ("R", [("user", text)], 1 + extra), ("R", [("assistant", text)], 1 + extra)]
        choices.append(here)
    for edits in itertools.product(*choices):
        for inserts in itertools.product(gaps, repeat=len(rows) + 1):
            cost = sum(e[2] for e in edits) + 5 * sum(len(i[0]) for i in inserts)
            if best and cost > best[0]:
                continue
            out, audit = list(inserts[0][1]), inserts[0][0]
            for e, i in zip(edits, inserts[1:]):
                out += e[1] + i[1]
                audit += e[0] + i[0]
            if SHAPE.fullmatch("".join(r[:1] for r, _ in out)) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, out)
    return best


def plain_best(rows):
    """The same for long conversations: whole strings kept for every state."""
    states = {"e": (0, "", ())}
    follows = {"e": "su", "s": "u", "u": "a", "a": "u"}
    full = {"s": "system", "u": "user", "a": "assistant"}

    def inserted(states):
        out = dict(states)
        for _ in range(2):
            for s, (cost, audit, kept) in list(out.items()):
                for to in follows[s].replace("s", ""):
                    new = (cost + 5, audit + "I", kept + ((full[to], ""),))
                    if to not in out or new[:2] < out[to][:2]:
                        out[to] = new
        return out

    for role, text, fault in faults(rows):
        new = {}
        for s, (cost, audit, kept) in inserted(states).items():
            moves = [(s, 2, "D", ())]
            if fault not in ("blank", "duplicate"):
                extra = 5 * (fault == "truncated")
                moves += [(to, extra, "K", ((role, text),)) for to in follows[s] if to == role[:1]]
                moves += [(to, 1 + extra, "R", ((full[to], text),)) for to in follows[s] if to != "s"]
            for to, more, e, add in moves:
                found = (cost + more, audit + e, kept + add)
                if to not in new or found[:2] < new[to][:2]:
                    new[to] = found
        states = new
    states = inserted(states)
    return min((states[s] for s in "ea" if s in states), key=lambda x: x[:2])


def run(rows):
    r, seen = C.Repair(), set()
    for role, text, fault in faults(rows):
        doomed = fault in ("blank", "duplicate")
        r.row(role, text, role[:1] if role[:1] in ("s", "u", "a") else "-", doomed, fault == "truncated")
    return r, r.finish()


def some_rows(rng, n, roles=("system", "user", "assistant", "tool", "usr")):
    texts = ["", " ", "One.", "two", "Three!", "four\n", "Five?\t"]
    return [(rng.choice(roles), rng.choice(texts) + (str(k) + rng.choice([".", ""]) if rng.random() < 0.7 else "")) for k in range(n)]


def test_small_conversations_against_all_edits():
    rng = random.Random(3)
    for n, times in ((0, 1), (1, 30), (2, 40), (3, 12)):
        for _ in range(times):
            rows = some_rows(rng, n)
            cost, audit, kept = enumerate_repairs(rows)
            assert run(rows)[1] == (cost, audit, sha(kept)), rows


def test_long_conversations_against_whole_strings(monkeypatch):
    rng = random.Random(4)
    for n in [*range(4, 30)] * 6 + [400]:
        rows = some_rows(rng, n, rng.choice([("system", "user", "assistant"), ("tool", "x"), ("user",), ("assistant", "tool"), ("user", "assistant")]))
        cost, audit, kept = plain_best(rows)
        want = (cost, audit, sha(kept))
        monkeypatch.setattr(C, "UNRESOLVED", 1 << 20)
        assert run(rows)[1] == want
        monkeypatch.setattr(C, "UNRESOLVED", rng.choice([3, 20, 60]))  # digests of the survivors' own, folded chains
        assert run(rows)[1] == want


def test_survivors_agree_soon_or_keep_whole_ties():
    good = [("user" if k % 2 == 0 else "assistant", f"Row {k}.") for k in range(5000)]
    r, (cost, audit, digest) = run(good)
    assert (cost, audit, digest) == (0, "K" * 5000, sha(good)) and r.most <= 12
    unknown = [("tool", f"Row {k}.") for k in range(5001)]  # which row goes stays open to the end: the first one reads least
    r, (cost, audit, _) = run(unknown)
    assert (cost, audit) == (5002, "D" + "R" * 5000) and r.most == 5001


def test_unresolved_texts_are_let_go(monkeypatch):
    monkeypatch.setattr(C, "UNRESOLVED", 1000)
    r = C.Repair()
    for k in range(2000):
        r.row("tool", "x" * 100 + ".", "-", False, False)
        nodes, seen = list(r.leaves), set()
        while nodes:
            n = nodes.pop()
            if n is not None and id(n) not in seen:
                seen.add(id(n))
                nodes.append(n.parent)
        assert len(seen) <= 60


SCHEMA = "conv_id long, turn long, role string, text string, conv string, hash string, times int, code string"


def spark_rows(spark, rows):
    return spark.createDataFrame([(*r, "c", "h", 9, "x") for r in rows], SCHEMA).repartition(3)


def expect(rows):
    """Result columns of one conversation's rows (turn, role, text)."""
    rows = sorted([(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows],
                  key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(f"{r[1]}:{r[2]}".encode()).digest()))
    turns = [t for t, _, _ in rows if t is not None]
    pairs = [(r, x) for _, r, x in rows]
    count = [f for _, _, f in faults(pairs)]
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(pairs, pairs[1:]))
    cost, audit, kept = plain_best(pairs)
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, count.count("blank"), count.count("duplicate"), count.count("truncated"), illegal, cost, audit, sha(kept))


def table(df):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect()}


def test_odd_rows(spark):
    long = "word " * 200_000
    rows = [(1, None, "user", "Hi."), (1, None, "user", "Hi."), (1, 2, None, None), (1, 2, "assistant", "Yes."), (1, 9, "assistant", "Yes."),
            (None, 1, "user", "a."), (None, 2, "assistant", ""), (2, None, None, None), (3, 5, "", "x."), (3, 6, "user", long), (3, 7, "assistant", long + "."),
            (4, -3, "system", "Be."), (4, 0, "user", "Q?"), (4, 4, "assistant", "A!"), (5, 1, "user", "ü. "), (5, 2, "assistant", " .")]
    df = spark_rows(spark, rows)
    got = table(C.repair(df))
    for conv in {r[0] for r in rows}:
        assert got[conv] == expect([r[1:] for r in rows if r[0] == conv]), conv
    assert len(got) == 6 and C.repair(df.limit(0)).count() == 0
    none = table(C.repair(df, times=F.when(F.col("conv_id") == 1, 0).otherwise(1)))
    assert none[1] == (0, 0, 0, 0, 0, 0, "", EMPTY) and none[4] == got[4]


def test_a_hot_conversation_and_hot_copies(spark):
    rng = random.Random(5)
    rows = [(7, k if rng.random() < 0.9 else None, *r) for k, r in enumerate(some_rows(rng, 1500))]
    rows += [(8, k, "user", "The same.") for k in range(1500)] + [(k + 100, 1, "user", "One.") for k in range(500)]
    got = table(C.repair(spark_rows(spark, rows)))
    assert got[7] == expect([r[1:] for r in rows if r[0] == 7]) and got[8] == expect([r[1:] for r in rows if r[0] == 8])
    assert got[8][2] == 1499 and got[8][6] == "D" * 1500 and len(got) == 502


@pytest.mark.parametrize("nulls", [False, True])
def test_damage_and_query(spark, sf_dir, tmp_path, nulls):
    from acrescope.llm import queries

    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    if nulls:
        rng = random.Random(6)
        rows = [tuple(None if rng.random() < 0.1 else v for v in r) for r in rows[:400]]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    groups = {}
    for conv, turn, role, text in rows:
        case = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        row = (turn, "user" if case == 4 else role, "" if case == 1 else re.sub("[.!?]", "", text) if case == 2 else text)
        groups.setdefault(conv, []).extend([row] * {0: 0, 3: 2}.get(case, 1))
    got = table(queries.op12_conversation_repair(spark, str(tmp_path)))
    assert got == {k: expect(v) for k, v in groups.items()}
