"""Repair of conversations against exhaustive search and a plain dynamic programme."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import pytest

from firmlens.llm import conversation as C

SCHEMA = "conv_id long, turn long, role string, text string, pos string, block string, cost string"
GRAMMAR = re.compile(r"(s?(ua)+)?\Z")


def frame(spark, rows):
    """Messages with columns whose names clash with those of the operator."""
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)


def exhaustive(roles, faults, most_inserts=3):
    """Cheapest (cost, audit) by trying every sequence of edits with few insertions."""
    best = None
    choices = [["D"] if f in "bd" else ["K", "Ru", "Ra", "D"] for f in faults]
    for pick in itertools.product(*choices):
        for n in range(most_inserts + 1):
            for where in itertools.combinations_with_replacement(range(len(roles) + 1), n):
                for what in itertools.product("ua", repeat=n):
                    out, audit, cost, ins = "", "", 2 * n, list(zip(where, what))
                    for k in range(len(roles) + 1):
                        for w, x in ins:
                            if w == k:
                                out, audit = out + x, audit + "I"
                        if k < len(roles):
                            p = pick[k]
                            audit += p[0]
                            out += roles[k] if p == "K" else p[1:]
                            cost += {"K": 0, "R": 2, "D": 3}[p[0]] + (faults[k] == "t" and p != "D")
                    if GRAMMAR.match(out) and (best is None or (cost, audit) < best):
                        best = cost, audit
    return best


def programme(roles, faults):
    """The same from the last row back, over (row, state): every state's best way to the end."""
    n = len(roles)
    best = [{} for _ in range(n + 1)]
    for k in range(n, -1, -1):
        now = {q: [(0, "")] if k == n and q in (0, 3) else [] for q in range(4)}
        if k < n:
            late = faults[k] == "t"
            for q in range(4):
                for letter, cost, symbols in [("D", 3, [None])] + ([] if faults[k] in "bd" else [("K", late, [roles[k]]), ("R", 2 + late, "ua")]):
                    for x in symbols:
                        to = q if x is None else C.STEP.get((q, x))
                        if to in best[k + 1]:
                            c, a = best[k + 1][to]
                            now[q].append((c + cost, letter + a))
        found = {q: min(v) for q, v in now.items() if v}
        for _ in range(4):
            for (q, x), to in C.STEP.items():
                if x in "ua" and to in found:
                    c, a = found[to]
                    found[q] = min(found.get(q, (10**9, "")), (c + 2, "I" + a))
        best[k] = found
    return best[0][0]


def test_agenda_against_exhaustive_search():
    r = random.Random(3)
    for _ in range(150):
        n = r.randint(0, 4)
        roles, faults = "".join(r.choice("suaat x") for _ in range(n)), "".join(r.choice("--tbd") for _ in range(n))
        (got,) = C.agenda(roles, faults, 0, C.FINAL).values()
        assert got == exhaustive(roles, faults) == programme(roles, faults), (roles, faults)


@pytest.mark.parametrize("size", [1, 2, 3, 7])
def test_blocks_chain_to_the_same_edits(size):
    r = random.Random(size)
    for _ in range(120):
        n = r.randint(0, 24)
        roles, faults = "".join(r.choice("suauax") for _ in range(n)), "".join(r.choice("----tbd") for _ in range(n))
        chain = C.Chain()
        for at in range(0, n, size):
            chain.extend({q: C.agenda(roles[at : at + size], faults[at : at + size], q, None) for q in range(4)})
        cost, audit, cuts = chain.goal()
        assert (cost, audit) == programme(roles, faults) and len(cuts) == -(-n // size)


def plain(rows, ids=None):
    """Report of conversations after damage, in plain Python; rows are (conv_id, turn, role, text)."""
    out = {}
    for conv in {r[0] for r in rows} | set(ids or []):
        mine = sorted(((t is not None, t or 0, r if r is not None else " ", x if x is not None else " ") for c, t, r, x in rows if c == conv))
        seen, faults = set(), ""
        for _, _, role, text in mine:
            core = text.strip(" \t\n\x0b\x0c\r")
            faults += "b" if not core else "d" if (role, text) in seen else "t" if core[-1] not in ".!?" else "-"
            seen.add((role, text))
        roles = "".join(m[2][:1] or " " for m in mine)
        cost, audit = programme(roles, faults)
        turns = [t for ok, t, _, _ in mine if ok]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        lines, k, state = [], 0, 0
        for letter in audit:
            role, text = (None, "") if letter == "I" else mine[k][2:]
            k += letter != "I"
            if letter == "D":
                continue
            if letter in "RI":
                role = "assistant" if state == 2 else "user"
            state = C.STEP[state, role[0]]
            lines.append(f"{role}:{text}")
        assert GRAMMAR.match("".join(x[0] for x in lines))
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:]))
        out[conv] = (gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def harm(rows):
    out = []
    for c, t, r, x in rows:
        r, x = " " if r is None else r, " " if x is None else x
        d = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if d:
            x = "" if d == 1 else re.sub("[.!?]", "", x) if d == 2 else x
            out += [(c, t, "user" if d == 4 else r, x)] * (2 if d == 3 else 1)
    return out


def report(frame_):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in frame_.collect()}


def test_whole_table(spark):
    convs = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    rows = [tuple(r) for r in convs.select("conv_id", "turn", "role", "text").collect()]
    got = report(C.repaired_report(convs, C.damage(convs)))
    assert got == plain(harm(rows), {r[0] for r in rows}) and sum(v[5] > 0 for v in got.values()) > 20


def test_odd_rows(spark):
    rows = [(1, None, None, None), (1, 3, "", "Hi."), (1, 3, "user", "Hi."), (None, 1, "user", "No id."), (None, None, "assistant", "x"), (2, 1, "system", " \t\x0b"), (3, 5, "user", "A?"), (3, 5, "user", "A?"), (3, 9, "assistant", "B!  \n"),
            (4, -2, "tool", "T."), (4, 4, "unknown", "U."), (5, 1, "user", "Zwölf 😀."), (5, 2, "assistant", "." + "y" * 300_000)] + [(6, k % 3, "user", "Same.") for k in range(9)]
    got = report(C.repaired_report(frame(spark, rows), C.damage(frame(spark, rows))))
    assert got == plain(harm(rows), {r[0] for r in rows})
    assert C.repaired_report(frame(spark, []), C.damage(frame(spark, []))).count() == 0
    told, messages = C.repair(frame(spark, [(7, 0, "user", "Hello."), (7, 1, "user", "Hello."), (7, 2, "user", "You?")]))
    assert [r.audit for r in told.collect()] == ["KDR"]
    assert [(r.edit, r.role, r.text) for r in messages.orderBy("block", "step").collect()] == [("K", "user", "Hello."), ("D", "user", "Hello."), ("R", "assistant", "You?")]


def test_no_row_left(spark):
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:1".encode()) % 20 == 0)
    rows = [(gone, 1, "user", "Hi.")]
    assert report(C.repaired_report(frame(spark, rows), C.damage(frame(spark, rows)))) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_a_conversation_of_many_blocks(spark):
    r = random.Random(9)
    rows = [(8, k, r.choice(["user", "assistant", "user", "assistant", "system"]), r.choice(["Yes.", "No", "", f"Line {k}.", f"Open {k}"])) for k in range(5000)] + [(9, 0, "user", "Hi."), (9, 1, "assistant", "Ho.")]
    told, messages = C.repair(frame(spark, rows))
    sums = {x.conv_id: (x.gaps, x.blank, x.duplicate, x.truncated, x.illegal, x.cost, x.audit) for x in told.collect()}
    shas = {x.conv_id: x.sha for x in C.digests(messages).collect()}
    want = plain(rows)
    assert {k: (*v, shas[k]) for k, v in sums.items()} == want and messages.select("block").distinct().count() > 4
