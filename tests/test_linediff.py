"""Ordered line differences against a plain version of the same rule, and by replay."""

from __future__ import annotations

import random
from collections import Counter, deque

import pytest

from contractlake.operators import linediff


def longest(matches):
    """Longest growing run of (left, right): ends last, steps back to the latest."""
    matches, n = sorted(matches), []
    for k, (_, right) in enumerate(matches):
        n.append(1 + max((n[j] for j in range(k) if matches[j][1] < right), default=0))
    out, want = [], max(n, default=0)
    for k in range(len(matches) - 1, -1, -1):
        if want and n[k] == want and (not out or matches[k][0] < out[-1][0]):
            out.append(matches[k])
            want -= 1
    return out[::-1]


def matched(old, new):
    """Equal lines by anchors: once on both sides, then within the gaps, at last the n-th of equal ones."""
    def unique(a, b):
        x, y = Counter(old[i] for i in a), Counter(new[j] for j in b)
        left, right = {old[i]: i for i in a}, {new[j]: j for j in b}
        return [(left[t], right[t]) for t in left if x[t] == 1 and y[t] == 1]

    segments, found, open_ = [(list(range(len(old))), list(range(len(new))))], [], True
    while open_:
        open_, following = False, []
        for a, b in segments:
            anchors = longest(unique(a, b))
            if anchors:
                open_ = True
                found += anchors
                cuts = [(a[0] - 1, b[0] - 1), *anchors, (a[-1] + 1, b[-1] + 1)]
                following += [([i for i in a if p[0] < i < q[0]], [j for j in b if p[1] < j < q[1]]) for p, q in zip(cuts, cuts[1:])]
            else:
                following.append((a, b))
        segments = following
    for a, b in segments:
        seen, places = Counter(), {}
        for j in b:
            seen[new[j]] += 1
            places[new[j], seen[new[j]]] = j
        seen = Counter()
        pairs = []
        for i in a:
            seen[old[i]] += 1
            if (j := places.get((old[i], seen[old[i]]))) is not None:
                pairs.append((i, j))
        found += longest(pairs)
    return sorted(found)


def edits(old, new):
    same, waiting, out, i, j = matched(old, new), deque(), [], 0, 0
    for a, b in [*same, (len(old), len(new))]:
        waiting.extend(range(i, a))
        for r in range(j, b):
            if waiting:
                left = waiting.popleft()
                out.append(("change", left + 1, old[left], r + 1, new[r]))
            else:
                out.append(("add", None, None, r + 1, new[r]))
        if a < len(old):
            out.append(("same", a + 1, old[a], b + 1, new[b]))
        i, j = a + 1, b + 1
    return [(k, *row) for k, row in enumerate(out + [("remove", left + 1, old[left], None, None) for left in waiting], 1)]


def texts(seed):
    rng = random.Random(seed)
    out = []
    for k in range(40):
        words = [f"w{x}" for x in range(rng.choice([2, 5, 40]))] + [""]
        old = [rng.choice(words) for _ in range(rng.randint(0, 25))]
        new = list(old)
        for _ in range(rng.randint(0, 6)):
            at = rng.randint(0, len(new))
            edit = rng.choice(["insert", "cut", "move", "new"])
            if edit == "insert":
                new.insert(at, rng.choice(words))
            elif edit == "new":
                new.insert(at, f"new {at}")
            elif new:
                line = new.pop(min(at, len(new) - 1))
                if edit == "move":
                    new.insert(rng.randint(0, len(new)), line)
        out.append((f"k{k}", "\n".join(old), "\n".join(new)))
    return [*out, ("null old", None, "a\nb"), ("null new", "a\nb", None), ("nulls", None, None), ("empty", "", ""), ("end", "a\n", "a"), (None, "x", "y"), ("twice", "x\ny", "y"), ("twice", "x\ny", "y"),
            ("long", "\n".join(map(str, range(3000))), "\n".join(map(str, range(1, 3000, 2))))]


@pytest.mark.parametrize(("seed", "size"), [(1, 1_000_000), (2, 3), (3, 1)])
def test_edits_of_many_pairs(spark, seed, size):
    pairs = texts(seed)
    if size == 1:
        pairs = pairs[:-1]
    frame = spark.createDataFrame(pairs, "key string, old string, new string").repartition(3)
    got = {}
    for r in linediff.line_edits(frame, ["key"], size=size).collect():
        got.setdefault(r["key"], []).append(tuple(r)[1:])

    def split(text):
        return [] if text is None else text.split("\n")

    for key, old, new in pairs:
        rows = sorted(got.get(key, []), key=repr)
        want = edits(split(old), split(new)) * (2 if key == "twice" else 1)
        assert rows == sorted(want, key=repr), key
        if key != "twice":
            in_order = sorted(got.get(key, []))
            assert [r[5] for r in in_order if r[5] is not None] == split(new)
            assert sorted((r[2], r[3]) for r in in_order if r[2]) == list(enumerate(split(old), 1))
    assert set(got) == {key for key, old, new in pairs if old is not None or new is not None}


def test_no_pairs(spark):
    assert linediff.line_edits(spark.createDataFrame([], "key string, old string, new string"), ["key"]).collect() == []
