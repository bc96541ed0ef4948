"""Conversation repair against a plain shortest path over (cost, letters), and odd rows."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib

import pytest

from contractlake.llm import repair

NEXT = {"0": "u", "s": "u", "u": "a", "a": "u"}


def damage(rows):
    out = []
    for c, t, r, x in rows:
        d = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = (" " if r is None else r), (" " if x is None else x)
        if d:
            x = "" if d == 1 else re.sub("[.!?]", "", x) if d == 2 else x
            out += [(c, t, "user" if d == 4 else r, x)] * (2 if d == 3 else 1)
    return out


def ordered(rows):
    rows = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).hexdigest()))


def faults(rows):
    seen, out = set(), []
    for _, _, r, x in rows:
        body = x.rstrip(" \t\n\x0b\x0c\r")
        out.append("blank" if not body else "duplicate" if (r, x) in seen else "" if body[-1] in ".!?" else "truncated")
        seen.add((r, x))
    return out


def cheapest(kinds, found):
    """Least (cost, letters) over all edits."""
    heap, done = [(0, "", 0, "0")], set()
    while True:
        cost, audit, i, state = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(kinds) and state in "0a":
            return cost, audit
        moves = [("I", 2, i, NEXT[state])]
        if i < len(kinds):
            moves.append(("D", 3, i + 1, state))
            if found[i] not in ("blank", "duplicate"):
                more = int(found[i] == "truncated")
                moves.append(("R", 2 + more, i + 1, NEXT[state]))
                if kinds[i] == NEXT[state] or state == "0" and kinds[i] == "s":
                    moves.append(("K", more, i + 1, kinds[i]))
        for letter, more, j, to in moves:
            heapq.heappush(heap, (cost + more, audit + letter, j, to))


def replay(rows, audit):
    left, state, out = iter(rows), "0", []
    for edit in audit:
        row = None if edit == "I" else next(left)
        if edit == "D":
            continue
        state = row[2][0] if edit == "K" else NEXT[state]
        out.append((row[2] if edit == "K" else {"u": "user", "a": "assistant"}[state], row[3] if row else ""))
    return out


def plain(rows):
    """Expected row of a conversation, and its repaired turns."""
    rows = ordered(rows)
    found, turns, kinds = faults(rows), {r[1] for r in rows} - {None}, [r[2][:1] for r in rows]
    cost, audit = cheapest(kinds, found)
    fixed = replay(rows, audit)
    illegal = sum(x + y not in ("su", "ua", "au") for x, y in zip(kinds, kinds[1:]))
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(found.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit,
            hashlib.sha256("\n".join(f"{r}:{x}" for r, x in fixed).encode()).hexdigest()), fixed


@pytest.mark.parametrize("size", [1, 3, 8, 20, 60])
@pytest.mark.parametrize("letters", ["abcdefghijklmnop", "eimf", "ghkl", "ei", "a", "mn"])
def test_auction_finds_the_least_edits_of_the_cheapest(size, letters):
    rng = random.Random(size)
    for _ in range(40):
        text = "".join(rng.choices(letters, k=rng.randint(1, size)))
        found, state, cost = repair.trace(text, p := repair.prices(text, (0, 4, 2, 0)), repair.START)
        kinds = ["sua "[(ord(x) - 97) // 4] for x in text]
        want = cheapest(kinds, [("", "truncated", "blank", "duplicate")[(ord(x) - 97) % 4] for x in text])
        assert p[0][repair.START] == want[0] == cost + 2 * len(repair._CLOSE[state]) and found + repair._CLOSE[state] == want[1]


def conversations():
    rng = random.Random(5)
    rows = []
    for c in range(60):
        for t in range(rng.randint(1, 9)):
            rows.append((c, t * rng.choice([1, 1, 2]), rng.choice(["user", "assistant", "system", "tool", "", "ursula"]), rng.choice(["a.", "b", "", " \t", "so!", "open", "é…?", "x" * rng.randint(0, 30)])))
    rows += [(100, t, ("user", "assistant")[rng.random() < 0.5], rng.choice([f"t{t}.", f"t{t}", "again."])) for t in range(300)]
    rows += [(101, None, None, None), (101, None, "user", "q?"), (101, 4, "assistant", None), (102, None, "system", "s.")]
    rows += [(None, 1, "user", "no id."), (None, 2, "user", "x" * 3_000_000 + ".")]
    rows += [(103, 1, "user", "same.")] * 40 + [(104, 0, "system", "only.")]
    return rows


@pytest.mark.parametrize("bits", [1, 4, 8])
def test_repair_by_plain_paths(spark, monkeypatch, bits):
    monkeypatch.setattr(repair, "CHUNK_BITS", bits)
    rows = conversations()
    frame = spark.createDataFrame([(*r, "z", 1) for r in rows], "conv_id long, turn long, role string, text string, audit string, cost int").repartition(7)
    groups = {}
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    got = {r[0]: tuple(r)[1:] for r in repair.repair(frame).collect()}
    assert got == {c: plain(own)[0] for c, own in groups.items()}
    if bits == 4:
        texts = {}
        for r in sorted(repair.repaired_turns(frame).collect(), key=lambda r: (r["conv_id"] is None, r["conv_id"], r["place"])):
            texts.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
        assert texts == {c: fixed for c, own in groups.items() if (fixed := plain(own)[1])}


def test_damage_and_conversations_without_rows(spark):
    rows = [r for r in conversations() if r[0] != 100]
    lost = next(c for c in range(1000, 9999) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows.append((lost, 0, "user", "gone."))
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert sorted(map(tuple, repair.damaged(frame).collect()), key=repr) == sorted(damage(rows), key=repr)
    groups = {r[0]: [] for r in rows}
    for r in damage(rows):
        groups[r[0]].append(r)
    got = {r[0]: tuple(r)[1:] for r in repair.with_all(repair.repair(repair.damaged(frame)), frame).collect()}
    assert got == {c: plain(own)[0] for c, own in groups.items()} and got[lost] == (0,) * 6 + ("", hashlib.sha256().hexdigest())


def test_empty_table(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.with_all(repair.repair(repair.damaged(none)), none).collect() == [] and repair.repaired_turns(none).collect() == []
