"""Conversation repair against a search over all edits."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest

from tessera.llm import repair


def slow_damage(rows):
    sp = lambda x: " " if x is None else str(x)
    out = []
    for conv, turn, role, text in rows:
        role, text = sp(role), sp(text)
        h = zlib.crc32(f"{sp(conv)}:{sp(turn)}".encode()) % 20
        if h == 0:
            continue
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        out += [(conv, turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    return out


def slow_repair(rows):
    """rows: (turn, role, text) in order. The cheapest edits by a programme over whole strings, states and rows."""
    faults, seen = [], set()
    for _, role, text in rows:
        blank = not re.search(r"[^\x20\x09-\x0D]", text)
        again = (role, text) in seen
        seen.add((role, text))
        faults.append("b" if blank else "d" if again else "t" if re.sub(r"[\x20\x09-\x0D]+\Z", "", text)[-1] not in ".!?" else "")
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    def inserts(best):
        for _ in range(4):
            for state in ("", "s", "u", "a"):
                if state in best:
                    cost, audit, lines = best[state]
                    new = "u" if state != "u" else "a"
                    cand = (cost + 3, audit + "I", [*lines, ("user:" if new == "u" else "assistant:")])
                    if new not in best or cand[:2] < best[new][:2]:
                        best[new] = cand
        return best

    best = inserts({"": (0, "", [])})
    for (_, role, text), fault in zip(rows, faults):
        new = {}

        def offer(state, cand):
            if state not in new or cand[:2] < new[state][:2]:
                new[state] = cand

        for state, (cost, audit, lines) in best.items():
            offer(state, (cost + 4, audit + "D", lines))
            if fault in ("b", "d"):
                continue
            more = 3 if fault == "t" else 0
            if (state, role[:1]) in step:
                offer(step[state, role[:1]], (cost + more, audit + "K", [*lines, f"{role}:{text}"]))
            for to, name in (("u", "user"), ("a", "assistant")):
                if (state, to) in step:
                    offer(to, (cost + more + 3, audit + "R", [*lines, f"{name}:{text}"]))
        best = inserts(new)
    cost, audit, lines = min((best[s] for s in ("", "a") if s in best), key=lambda x: x[:2])
    turns = [t for t, _, _ in rows if t is not None]
    roles = [r[:1] for _, r, _ in rows]
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in "bdt"),
        sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:])), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    )


def slow(rows):
    left = slow_damage(rows)
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted(((t, r, x) for c, t, r, x in left if c == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        out[conv] = slow_repair(own) if own else (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    return out


def table(spark, rows, extra=""):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    return df.selectExpr("*", *([extra] if extra else []))


def got(df):
    rows = df.collect()
    assert len({r["conv_id"] for r in rows}) == len(rows)
    return {r["conv_id"]: (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"], r["repaired_sha256"]) for r in rows}


def made(seed, convs, longest):
    rng, rows = random.Random(seed), []
    for c in range(convs):
        for t in range(rng.randint(1, longest)):
            role = rng.choice(("user", "assistant")) if rng.random() < 0.4 else ("user", "assistant")[t % 2]
            role = rng.choice(("system", "tool", None, "", "ua")) if rng.random() < 0.15 else "system" if t == 0 and rng.random() < 0.4 else role
            text = rng.choice(("Yes.", "No", " \n", None, "", f"So {t}? ", "A." + "b" * rng.randint(0, 3)))
            rows.append((c, None if rng.random() < 0.02 else t * rng.choice((1, 1, 1, 3)), role, text))
    return rows


def distinct_turns(rows):
    """One row to a conversation and turn: the order of ties isn't part of what is compared."""
    return list({(r[0], r[1]): r for r in rows}.values())


@pytest.mark.parametrize("bits", [1, 2, repair.PIECE_BITS])
def test_against_all_edits(spark, bits):
    rows = distinct_turns(made(bits, 120, 14))
    assert got(repair.damage_and_repair(table(spark, rows), bits)) == slow(rows)


def test_programme_alone():
    rng = random.Random(9)
    for _ in range(3000):
        codes = "".join(rng.choice("suaoSUAO1234uauaUA") for _ in range(rng.randint(0, 9)))
        roles = ["suao"[("suaoSUAO1234".index(c)) % 4] for c in codes]
        rows = [(i, r, " " if c in "1234" else f"{i}" + ("" if c in "SUAO" else ".")) for i, (c, r) in enumerate(zip(codes, roles))]
        want = slow_repair(rows)
        costs, nexts, firsts = repair.backwards(codes, repair.FINAL)
        audit, state = repair.forwards(codes, repair.START, nexts, firsts)
        assert (costs[0], audit + "I" * repair.TAIL[state]) == want[5:7], codes


def test_one_conversation_of_many_pieces(spark):
    rng = random.Random(4)
    rows = [(7, t, rng.choice(("user", "assistant", "assistant", "system")), rng.choice(("x.", f"{t} y.", f"{t} z", " "))) for t in range(1500)]
    rows += [(None, t, "user", "Hi.") for t in range(40)] + [(8, None, "user", "Hi.")]
    assert got(repair.damage_and_repair(table(spark, rows), 4)) == slow(rows)


def test_repaired_rows_alternate(spark):
    rows = distinct_turns(made(5, 40, 12))
    out = repair.Repair(table(spark, rows), piece_bits=2).repaired().orderBy("ckey", "piece", "at").collect()
    by = {}
    for r in out:
        by.setdefault(r["ckey"], []).append(r["role"][:1])
    assert by and all(re.fullmatch("s?(ua)+", "".join(v)) for v in by.values())


def test_odd_tables(spark):
    assert repair.damage_and_repair(table(spark, [])).collect() == []
    same = [(1, 5, "user", "One. ")] * 30 + [(1, 6, "assistant", "x" * 200_000 + "!")] + [(2, 1, None, None), (2, None, "assistant", "é?")]
    df = table(spark, same, "'x' AS ckey").selectExpr("*", "1 AS place", "2 AS rid", "'y' AS code")
    assert got(repair.damage_and_repair(df)) == slow(same)
