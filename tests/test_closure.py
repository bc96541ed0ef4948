"""Closures over strongly connected components against plain graph walks."""

from __future__ import annotations

import random

import pytest

from contractlake.operators import closure as module
from contractlake.operators import facts, impact
from contractlake.operators.closure import closure, condense, reachable
from tests.conftest import rows

EDGES, SEEDS = "scope string, src string, dst string", "scope string, origin string, node string"


def walked(edges, seeds, include):
    """(scope, origin, node) met from all seeds of an origin, one node at a time."""
    want = set()
    for scope, origin in {(s, o) for s, o, _ in seeds}:
        ring = {n for s, o, n in seeds if (s, o) == (scope, origin)}
        seen = set(ring) if include else set()
        while ring:
            ring = {d for s, x, d in edges if s == scope and x in ring and d is not None} - seen
            seen |= ring
        want |= {(scope, origin, n) for n in seen}
    return sorted(want, key=repr)


def frames(spark, edges, seeds):
    return spark.createDataFrame(edges, EDGES), spark.createDataFrame(seeds, SEEDS)


@pytest.mark.parametrize("seed, nodes, links, include", [(0, 12, 14, False), (1, 30, 40, True)])
def test_random_graphs(spark, monkeypatch, seed, nodes, links, include):
    monkeypatch.setattr(module, "MEMBERS", 3)  # components are dealt into several parts
    rnd = random.Random(seed)
    edges = [(rnd.choice("rs"), str(rnd.randrange(nodes)), str(rnd.randrange(nodes))) for _ in range(links)]
    seeds = [(rnd.choice("rst"), rnd.choice("abc"), str(rnd.randrange(nodes + 3))) for _ in range(6)]
    e, s = frames(spark, edges + edges[:5], seeds + seeds[:2])
    assert rows(closure(e, s, include, ["scope"]), "scope", "origin", "node") == walked(edges, seeds, include)


def test_components(spark):
    two = [(str(a), str((a + 1) % 40)) for a in range(40)] + [(f"x{a}", f"x{(a + 1) % 30}") for a in range(30)]
    chain = [("3", "c0"), ("x4", "c5"), ("c9", "c9")] + [(f"c{a}", f"c{a + 1}") for a in range(12)]
    members, between = condense(spark.createDataFrame(two + chain, "src string, dst string"))
    by_comp = {}
    for r in members.collect():
        by_comp.setdefault(r.comp, []).append((r.node, r.cyclic))
    assert sorted(len(v) for v in by_comp.values()) == [1] * 13 + [30, 40]
    assert {n for v in by_comp.values() for n, cyclic in v if len(v) == 1 and cyclic} == {"c9"}
    assert between.count() == len(chain) - 1 == between.distinct().count()
    assert between.where("src = dst").count() == 0


def test_a_long_ring_takes_few_rounds(spark, monkeypatch):
    written, rounds = module._written, []
    monkeypatch.setattr(module, "_written", lambda rows, **sums: rounds.extend(sums) or written(rows, **sums))
    names = random.Random(5).sample(range(1000), 400)
    members, _ = condense(spark.createDataFrame([(names[i - 1], names[i]) for i in range(400)], "src long, dst long"))
    assert members.select("comp").distinct().count() == 1
    assert rounds.count("moving") <= 16  # 400 hops by three would be 134


def test_odd_rows(spark):
    edges = [("r", "a", "b"), ("r", "b", None), ("r", None, "c"), (None, "a", "z"), ("r", "b", "b"), ("r", "", "a")]
    seeds = [("r", None, "a"), ("r", "o", ""), ("r", "p", None), ("r", "q", "nowhere")]
    e, s = frames(spark, edges, seeds)
    assert rows(closure(e, s, scope=["scope"])) == [("r", "o", "a"), ("r", "o", "b"), ("r", None, "b")]
    more = [("r", "o", ""), ("r", "p", None), ("r", "q", "nowhere"), ("r", None, "a")]
    assert rows(closure(e, s, True, ["scope"])) == sorted([("r", "o", "a"), ("r", "o", "b"), ("r", None, "b"), *more], key=repr)
    targets = spark.createDataFrame([("r", "b"), ("r", "nowhere"), ("s", "a")], "scope string, node string")
    assert rows(closure(e, s, True, ["scope"], targets)) == sorted([("r", "o", "b"), ("r", "q", "nowhere"), ("r", None, "b")], key=repr)
    none = e.where("false")
    assert rows(closure(none, s, True, ["scope"])) == sorted(more, key=repr)
    assert rows(closure(e, s.where("false"), True, ["scope"])) == []


def test_reasons_and_facts_of_cycles(spark):
    calls = spark.createDataFrame([("h1", "m"), ("m", "n"), ("n", "m"), ("h2", "n"), ("n", "deep")], "caller string, callee string")
    reasons = spark.createDataFrame([("deep", "changed: deep"), ("m", "changed: m")], "method string, reason string")
    handlers = spark.createDataFrame([("h1",), ("h2",), ("deep",)], "method string")
    reached = rows(impact.propagate_reasons(calls, reasons, handlers=handlers))
    assert reached == sorted([("deep", "changed: deep"), *[(h, f"changed: {m}") for h in ("h1", "h2") for m in ("deep", "m")]])
    down = calls.selectExpr("caller AS src", "callee AS dst")
    seeds = spark.createDataFrame([("e1", "h1"), ("e2", "deep")], "origin string, node string")
    known = spark.createDataFrame([("n", "database", "t1"), ("m", "database", "t1"), ("deep", "http", "u"), ("h1", "odd", "v")], "method string, kind string, item string")
    want = [("e1", "databases", "t1"), ("e1", "external_apis", "u"), ("e1", "other", "v"), ("e2", "external_apis", "u")]
    assert rows(facts.endpoint_facts(closure(down, seeds, True), known, ["item"])) == want
    assert rows(facts.endpoint_facts(reachable(down, seeds, True), known, ["item"]), "endpoint", "grp", "item", "depth")[0] == ("e1", "databases", "t1", 1)
