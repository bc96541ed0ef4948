"""Cheapest edits that give conversations a legal order of roles, by an auction algorithm for shortest paths on the lattice of edits.

Legal are no turns at all, or an optional system turn and then pairs of user and assistant. Only the first letter of a role counts. Edits: keep a turn (K, 0), give it
the role that fits, user or assistant (R, 2), delete it (D, 3; a must for blank and repeated turns), insert an empty turn of user or assistant anywhere (I, 2). Each
truncated turn that stays costs 1 more. Of equally cheap edits the ASCII-least string of letters is taken.

1. Turns are sorted by range and numbered, so one conversation may lie in many tasks; a turn becomes one letter for its role and fault. Faults, the first that holds:
   blank (nothing but white space), duplicate (role and text seen earlier in the conversation), truncated (the last character that is no white space is none of `.!?`).
2. The letters of a conversation are cut into chunks. Nodes of a chunk's lattice are (turn, state), states are start, after system, after user, after assistant. The
   auction keeps a price for each node, never above the cost of an arc plus the price of its end. A path grows along the cheapest arc while prices allow it; where they
   don't, the price of its last node rises and the path shrinks by that node. Blocks of a chunk are settled from its end, each on the final prices of the next.
3. A chunk's costs between its first and last states are one small matrix; a scan from the end of a conversation gives every chunk the prices behind it. At converged
   prices every cheapest path consists of tight arcs (price = cost + price of the end), so the least letters are traced over tight arcs that lead to the end, for
   each of the four first states; a scan from the front picks the one that holds. Chunks are worked on in parallel, only the two scans, a small row for each chunk,
   pass a conversation's rows in order.
4. Letters and texts are merged in a sorted stream: one turn is held at a time. A digest of a whole conversation is a sequential hash, so its texts pass one task.

Null role or text counts as one space, a null turn comes first, a null conversation id is a conversation of its own. Equal turns are ordered by role and MD5 of the text,
so repeated rows stand next to each other, the later ones are duplicates. Texts of any length are read whole. Other columns, whatever their names, are not read. An empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

# Turns in a chunk (a power of two) and in a block that the auction settles at once.
CHUNK_BITS = 8
BLOCK = 16
SPACES = " \t\n\x0b\x0c\r"
INSERT, REROLE, DELETE, TRUNCATED = 2, 2, 3, 1

START, SYSTEM, USER, ASSISTANT = range(4)
_INITIALS = "sua"
_FAULTS = ("", "truncated", "blank", "duplicate")
_NEXT = (USER, USER, ASSISTANT, USER)  # state after a turn of the role that fits
_FITS = {(START, 0): SYSTEM, (START, 1): USER, (SYSTEM, 1): USER, (USER, 2): ASSISTANT, (ASSISTANT, 1): USER}
_INF = float("inf")
# What must be inserted behind the last turn.
_CLOSE = ("", "II", "I", "")
_LEGAL = {(0, 1), (1, 2), (2, 1)}
_ROLES = {USER: "user", ASSISTANT: "assistant"}


def _letter(kind: int, fault: int) -> str:
    return chr(97 + 4 * kind + fault)


def _arcs(letter: str) -> list[tuple]:
    """For each state the arcs (edit, cost, turns ahead, next state) at a turn, in the order of the edits' letters."""
    kind, fault = divmod(ord(letter) - 97, 4)
    out = []
    for state in range(4):
        arcs = [("D", DELETE, 1, state), ("I", INSERT, 0, _NEXT[state])]
        if fault < 2:
            if (state, kind) in _FITS:
                arcs.append(("K", TRUNCATED * fault, 1, _FITS[state, kind]))
            arcs.append(("R", REROLE + TRUNCATED * fault, 1, _NEXT[state]))
        out.append(tuple(arcs))
    return out


ARCS = {_letter(k, f): _arcs(_letter(k, f)) for k in range(4) for f in range(4)}


def _auction(arcs: list, p: list, first: int, state: int, last: int) -> None:
    """Raise prices until a path from (first, state) reaches turn `last`; then the price of its first node is its cost."""
    if p[first][state] == _INF:
        return
    path = [(first, state)]
    while path[-1][0] < last:
        i, s = path[-1]
        best, _, ahead, to = min((cost + p[i + ahead][to], k, ahead, to) for k, (_, cost, ahead, to) in enumerate(arcs[i][s]))
        if p[i][s] < best:
            p[i][s] = best
            if len(path) > 1:
                path.pop()
        else:
            path.append((i + ahead, to))


def prices(letters: str, behind: tuple) -> list[list]:
    """Price of every (turn, state): below or equal to the cost to the end, and equal to it at each block's first turn. `behind`: costs from the states after the last turn."""
    n, arcs = len(letters), [ARCS[x] for x in letters]
    p = [[_INF] * 4 for _ in range(n)] + [list(behind)]
    for last in range(n, 0, -BLOCK):
        first = max(0, last - BLOCK)
        low = min(p[last])
        for i in range(last - 1, first - 1, -1):  # nodes from which no end can be reached have no price
            for _ in range(3):
                for s in range(4):
                    if any(p[i + ahead][to] < _INF for _, _, ahead, to in arcs[i][s]):
                        p[i][s] = low
        for s in range(4):
            _auction(arcs, p, first, s, last)
    return p


def trace(letters: str, p: list, state: int) -> tuple[str, int, int]:
    """ASCII-least edits of the cheapest ones from a first state, the state behind them, and their cost."""
    n, arcs = len(letters), [ARCS[x] for x in letters]
    leads = [[False] * 4 for _ in range(n)] + [[x < _INF for x in p[n]]]
    for i in range(n - 1, -1, -1):
        for _ in range(3):  # two insertions in a row at most
            for s in range(4):
                leads[i][s] = any(leads[i + ahead][to] and p[i][s] == cost + p[i + ahead][to] for _, cost, ahead, to in arcs[i][s])
    i, edits, total = 0, [], 0
    while i < n:
        edit, cost, ahead, to = next(a for a in arcs[i][state] if leads[i + a[2]][a[3]] and p[i][state] == a[1] + p[i + a[2]][a[3]])
        edits.append(edit)
        i, state, total = i + ahead, to, total + cost
    return "".join(edits), state, total


@lru_cache(50_000)
def _matrix(letters: str) -> list[int]:
    """Costs from each first state to each last state, row by row; -1: there is no way."""
    columns = [prices(letters, tuple(0 if s == last else _INF for s in range(4)))[0] for last in range(4)]
    return [-1 if columns[last][first] == _INF else columns[last][first] for first in range(4) for last in range(4)]


@lru_cache(50_000)
def _traces(letters: str, behind: tuple, closes: bool) -> tuple[list, list, list]:
    p = prices(letters, tuple(_INF if x < 0 else x for x in behind))
    edits, states, costs = [], [], []
    for first in range(4):
        if p[0][first] == _INF:
            found, state, cost = "", 0, 0
        else:
            found, state, cost = trace(letters, p, first)
            if closes:
                found, cost = found + _CLOSE[state], cost + INSERT * len(_CLOSE[state])
        edits.append(found)
        states.append(state)
        costs.append(cost)
    return edits, states, costs


def _mapped(df: DataFrame, more: str, work) -> DataFrame:
    """df with columns that work(rows as lists, column by column) gives; `work` is made anew in each task, so it may remember earlier rows."""
    schema = df.schema
    extra = df.sparkSession.createDataFrame([], more).schema
    both = schema.__class__([*schema.fields, *extra.fields])

    def run(batches):
        step = work()
        for batch in batches:
            if batch.num_rows:
                made = step({name: batch.column(k).to_pylist() for k, name in enumerate(batch.schema.names)})
                kinds = (pa.list_(pa.int32()), pa.list_(pa.string()), pa.int64(), pa.string(), pa.bool_())
                named = {"array<int>": kinds[0], "array<string>": kinds[1], "bigint": kinds[2], "string": kinds[3], "boolean": kinds[4]}
                arrays = [pa.array(values, named[kind]) for values, kind in zip(made, wanted)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=names)

    wanted, names = [f.dataType.simpleString() for f in extra.fields], both.names
    return df.mapInArrow(run, both)


def _last_character(text: Column) -> Column:
    return F.right(F.rtrim(text, F.lit(SPACES)), F.lit(1))


def _plain(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, mark): nulls replaced, mark orders equal turns."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    return turns.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), text.alias("text"), F.md5(text).alias("mark"))


def chunks(turns: DataFrame) -> DataFrame:
    """(conv_id, chunk, letters, turn, role, mark): the letters of neighbouring turns of a conversation, and the place of the first of them."""
    last = _last_character(F.col("text"))
    slim = (_plain(turns).withColumn("last", last)
            .select("conv_id", "turn", "role", "mark", F.when(F.col("last") == "", 2).when(F.col("last").isin(".", "!", "?"), 0).otherwise(1).alias("fault")))
    slim = cut_lineage(slim)
    order = ("conv_id", "turn", "role", "mark")
    placed = cut_lineage(slim.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.monotonically_increasing_id().alias("place")))
    again = (placed.groupBy("conv_id", "role", "mark").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1")
             .select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("mark").alias("m"), "first"))
    fault = F.when((F.col("fault") != 2) & (F.col("place") > F.col("first")), 3).otherwise(F.col("fault"))
    kind = F.coalesce(*[F.when(F.col("role").startswith(x), k) for k, x in enumerate(_INITIALS)], F.lit(3))
    lettered = (placed.join(again, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("mark") == F.col("m")), "left")
                .select("conv_id", "turn", "role", "mark", "place", F.char(F.lit(97) + 4 * kind + fault).alias("letter")))
    together = F.array_sort(F.collect_list(F.struct("place", "letter")))
    return (lettered.groupBy("conv_id", F.shiftright("place", CHUNK_BITS).alias("chunk"))
            .agg(F.array_join(F.transform(together, lambda x: x["letter"]), "").alias("letters"), F.min_by(F.struct("turn", "role", "mark"), "place").alias("head"))
            .select("conv_id", "chunk", "letters", "head.turn", "head.role", "head.mark"))


def _prices_behind():
    """Backward scan: the costs behind each chunk, lowered so that the least is 0, and whether it is the conversation's last."""
    now = ["none", None]

    def step(rows):
        behind, closes = [], []
        for conv, matrix in zip(rows["conv_id"], rows["matrix"]):
            ends = now[0] != (conv,)
            vector = tuple(INSERT * len(x) for x in _CLOSE) if ends else now[1]
            behind.append(list(vector))
            closes.append(ends)
            sums = [min((m + v for m, v in zip(matrix[4 * s:4 * s + 4], vector) if m >= 0 and v >= 0), default=-1) for s in range(4)]
            low = min(x for x in sums if x >= 0)
            now[:] = (conv,), tuple(x - low if x >= 0 else -1 for x in sums)
        return behind, closes
    return step


def _chosen():
    """Forward scan: the edits of each chunk from the state that the chunk before it ends in, and its counts."""
    now = ["none", START, None]

    def step(rows):
        out = [[] for _ in range(6)]
        for conv, letters, edits, states, costs in zip(rows["conv_id"], rows["letters"], rows["edits"], rows["states"], rows["costs"]):
            state, before = (now[1], now[2]) if now[0] == (conv,) else (START, None)
            kinds = [divmod(ord(x) - 97, 4) for x in letters]
            pairs = zip([before, *[k for k, _ in kinds[:-1]]], [k for k, _ in kinds])
            faults = [f for _, f in kinds]
            for values, value in zip(out, (edits[state], costs[state], faults.count(2), faults.count(3), faults.count(1), sum(a is not None and (a, b) not in _LEGAL for a, b in pairs))):
                values.append(value)
            now[:] = (conv,), states[state], kinds[-1][0]
        return out
    return step


def edits(turns: DataFrame) -> DataFrame:
    """(conv_id, chunk, turn, role, mark, audit, cost, blank, duplicate, truncated, illegal) of every chunk; (turn, role, mark) is the place of its first turn."""
    def parallel(column, work):
        return lambda: lambda rows: work(rows)

    with_costs = _mapped(chunks(turns), "matrix array<int>", parallel("letters", lambda rows: [[_matrix(x) for x in rows["letters"]]]))
    scanned = _mapped(with_costs.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("chunk")), "behind array<int>, closes boolean", _prices_behind)

    def all_traces(rows):
        found = [_traces(x, tuple(b), c) for x, b, c in zip(rows["letters"], rows["behind"], rows["closes"])]
        return [[f[k] for f in found] for k in range(3)]

    traced = _mapped(scanned.drop("matrix").repartition("conv_id", "chunk"), "edits array<string>, states array<int>, costs array<int>", parallel("letters", all_traces))
    picked = _mapped(traced.drop("behind", "closes").repartition("conv_id").sortWithinPartitions("conv_id", "chunk"),
                     "audit string, cost long, blank long, duplicate long, truncated long, illegal long", _chosen)
    return picked.select("conv_id", "chunk", "turn", "role", "mark", "audit", "cost", "blank", "duplicate", "truncated", "illegal")


_COUNTS = ("cost", "blank", "duplicate", "truncated", "illegal")


def _merged(turns: DataFrame) -> DataFrame:
    """Turns and edits in one stream: each chunk's edits stand before its first turn."""
    chosen = cut_lineage(edits(turns))
    no = [F.lit(None).cast("long").alias(x) for x in _COUNTS]
    rows = _plain(turns).select("conv_id", "turn", "role", "mark", F.lit(1).alias("kind"), F.lit(0).cast("long").alias("chunk"), "text", *no)
    steps = chosen.select("conv_id", "turn", "role", "mark", F.lit(0).alias("kind"), "chunk", F.col("audit").alias("text"), *_COUNTS)
    return (rows.unionByName(steps).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "mark", "kind", "chunk")
            .select("conv_id", "kind", "role", "text", *_COUNTS))


def _replay(batches) -> Iterator[tuple]:
    """(conversation, role, text) of each repaired turn, (conversation, edits, counts) where a chunk begins; a conversation is a tuple, as its id may be null."""
    now, waiting, at, state = None, "", 0, START

    def inserted():
        nonlocal at, state
        while at < len(waiting) and waiting[at] == "I":
            state = _NEXT[state]
            at += 1
            yield now, _ROLES[state], ""

    for batch in batches:
        for conv, kind, role, text, *counts in zip(*(column.to_pylist() for column in batch.columns)):
            if now != (conv,):
                yield from inserted()
                now, waiting, at, state = (conv,), "", 0, START
            if not kind:
                waiting, at = waiting[at:] + text, 0
                yield now, text, counts
                continue
            yield from inserted()
            edit = waiting[at]
            at += 1
            if edit == "K":
                state = _FITS[state, _INITIALS.index(role[0])]
                yield now, role, text
            elif edit == "R":
                state = _NEXT[state]
                yield now, _ROLES[state], text
    yield from inserted()


def repaired_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, place, role, text): the repaired conversations, places from 0."""
    kind = turns.schema["conv_id"].dataType

    def run(batches):
        arrow, rows, size, now, place = None, [], 0, None, 0

        def pack():
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], arrow), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string()),
                                               pa.array([r[3] for r in rows], pa.string())], names=["conv_id", "place", "role", "text"])

        def seen():
            nonlocal arrow
            for batch in batches:
                arrow = batch.schema.field(0).type
                yield batch

        for conv, role, text in _replay(seen()):
            if isinstance(text, list):
                continue
            if now != conv:
                now, place = conv, 0
            rows.append((conv[0], place, role, text))
            place += 1
            size += len(text) + 32
            if size > 4 << 20:
                yield pack()
                rows, size = [], 0
        if rows:
            yield pack()

    return _merged(turns).mapInArrow(run, turns.select("conv_id").schema.add("place", "long").add("role", "string").add("text", "string"))


def repair(turns: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation; gaps are turn numbers that are missing between the
    smallest and the largest."""
    def run(batches):
        arrow, out, now, audit, counts, sha, lines = None, [], None, [], [0] * 5, None, 0

        def seen():
            nonlocal arrow
            for batch in batches:
                arrow = batch.schema.field(0).type
                yield batch

        def pack():
            columns = list(zip(*out))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], arrow), *[pa.array(c, pa.int64()) for c in columns[1:6]], pa.array(columns[6], pa.string()), pa.array(columns[7], pa.string())],
                                              names=names)

        for conv, a, b in _replay(seen()):
            if now != conv:
                if now:
                    out.append((now[0], *counts, "".join(audit), sha.hexdigest()))
                    if len(out) >= 10_000:
                        yield pack()
                        out = []
                now, audit, counts, sha, lines = conv, [], [0] * 5, hashlib.sha256(), 0
            if isinstance(b, list):
                audit.append(a)
                counts = [x + y for x, y in zip(counts, b)]
            else:
                if lines:
                    sha.update(b"\n")
                sha.update(f"{a}:{b}".encode())
                lines += 1
        if now:
            out.append((now[0], *counts, "".join(audit), sha.hexdigest()))
        if out:
            yield pack()

    schema = turns.select("conv_id").schema
    for name in _COUNTS:
        schema = schema.add(name, "long")
    schema = schema.add("audit", "string").add("repaired_sha256", "string")
    names = schema.names
    found = _merged(turns).mapInArrow(run, schema)
    spans = (turns.groupBy("conv_id").agg(F.min("turn").alias("low"), F.max("turn").alias("high"), F.count_distinct("turn").alias("n"))
             .select(F.col("conv_id").alias("c"), F.coalesce(F.col("high") - F.col("low") + 1 - F.col("n"), F.lit(0)).cast("long").alias("gaps")))
    return (found.join(spans, F.col("conv_id").eqNullSafe(F.col("c")), "left")
            .select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"))


def damaged(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with planted faults: by CRC-32 of `conv_id:turn` modulo 20, 0 drops a row, 1 empties its text, 2 takes its `.!?` away, 3 repeats it, 4
    makes it the user's. Nulls count as one space."""
    def plain(name):
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    draw = F.crc32(F.concat(plain("conv_id"), F.lit(":"), plain("turn"))) % 20
    text = F.when(F.col("draw") == 1, "").when(F.col("draw") == 2, F.translate(plain("text"), ".!?", "")).otherwise(plain("text"))
    return (turns.withColumn("draw", draw).where("draw <> 0")
            .select("conv_id", "turn", F.when(F.col("draw") == 4, "user").otherwise(plain("role")).alias("role"), text.alias("text"),
                    F.explode(F.sequence(F.lit(0), (F.col("draw") == 3).cast("int"))).alias("copy")).drop("copy"))


def with_all(found: DataFrame, turns: DataFrame) -> DataFrame:
    """A row for every conversation of `turns`, also those that `found` doesn't know: zeros, no edits, the digest of nothing."""
    ids = turns.select(F.col("conv_id").alias("c")).distinct()
    nothing = {"audit": "", "repaired_sha256": hashlib.sha256().hexdigest()}
    return (ids.join(found, F.col("conv_id").eqNullSafe(F.col("c")), "left")
            .select(F.col("c").alias("conv_id"), *[F.coalesce(F.col(x), F.lit(nothing.get(x, 0))).alias(x) for x in found.columns if x != "conv_id"]))
