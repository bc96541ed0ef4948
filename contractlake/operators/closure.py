"""Reachability over graphs that may have cycles.

`WITH RECURSIVE` has no distinct union, so cyclic graphs never end there. A frontier loop joins
only the nodes found last, drops known ones, and writes each round to reliable storage: plans
stay short and a lost executor costs one round. The driver sees one row count per round.

`reachable` walks every node for every origin and knows the depths. `closure` does not: it first
finds the strongly connected components, walks the graph of components, and brings their members
back at the end, so what the rounds move does not grow with origins times members.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from ..session import cut_lineage, release, scratch_path, write_scratch


# hops in a round, the same at every size: fewer rounds against nodes met again within one
HOPS = 3


def reachable(edges: DataFrame, seeds: DataFrame, include_seeds: bool = False, max_depth: int | None = None, scope: Sequence[str] = ()) -> DataFrame:
    """(scope, origin, node, depth) of every node reachable from the seeds, at its smallest depth.

    edges(scope, src, dst), seeds(scope, origin, node); equal names in different scopes (say, repositories) are different nodes. A seed itself
    appears only when it lies on a cycle, unless `include_seeds` adds all of them at depth 0. Each round takes `HOPS` hops from the
    outermost nodes, keeps the smallest depth of what it meets, drops what was known before, and adds the rest to one table; the number of
    rows it wrote ends the loop.
    """
    spark, keys = edges.sparkSession, [*scope, "origin", "node"]
    links, links_path = write_scratch(edges.select(*scope, F.col("src").alias("node"), "dst").distinct())
    path = scratch_path(spark, "closure")
    schema = StructType([*seeds.select(*keys).schema, StructField("depth", IntegerType())])

    def add(rows: DataFrame, number: int) -> int:
        written = Observation()
        rows.observe(written, F.count(F.lit(1)).alias("n")).write.parquet(f"{path}/round={number}")
        return written.get["n"]

    known = lambda: spark.read.schema(schema).parquet(path).drop("round")
    hop = lambda ring: ring.join(links, [*scope, "node"]).select(*scope, "origin", F.col("dst").alias("node")).distinct()
    size, number, depth = add(seeds.select(*keys).distinct().withColumn("depth", F.lit(0)), 0), 0, 0
    first = 0 if include_seeds else 1
    while size and (max_depth is None or depth < max_depth):
        hops = HOPS if max_depth is None else min(HOPS, max_depth - depth)
        ring, rings = spark.read.schema(schema).parquet(f"{path}/round={number}").where(F.col("depth") == depth).select(*keys), []
        for k in range(1, hops + 1):
            ring = hop(ring)
            rings.append(ring.withColumn("depth", F.lit(depth + k)))
        met = reduce(DataFrame.unionByName, rings).groupBy(*keys).agg(F.min("depth").alias("depth"))
        new = met.join(known().where(F.col("depth") >= first).select(*keys), keys, "left_anti")
        number, depth = number + 1, depth + hops
        size = add(new, number)
    release(spark, links_path)
    return known().where(F.col("depth") >= first)


# ---------------------------------------------------------------- components

# members of a component that are joined back by one group; larger components are dealt into several
MEMBERS = 100_000
# a round of trimming that removes a smaller share of the links is the last one before labels are spread
TRIM_SHARE = 0.1


def _written(rows: DataFrame, **sums: Column) -> tuple[DataFrame, str, dict[str, int]]:
    """rows as a scratch table, its path, and sums over them taken while it was written."""
    seen = Observation()
    table, path = write_scratch(rows.observe(seen, *[F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(n) for n, c in sums.items()]))
    return table, path, seen.get


def _trim(links: DataFrame, path: str, size: int) -> tuple[DataFrame, str, int]:
    """links(s, d) without those that start where nothing arrives or arrive where nothing starts: no cycle uses them."""
    while size:
        starts, ends = links.select(F.col("s").alias("d")).distinct(), links.select(F.col("d").alias("s")).distinct()
        kept, kept_path, seen = _written(links.join(ends, "s", "left_semi").join(starts, "d", "left_semi").select("s", "d"), n=F.lit(1))
        release(links.sparkSession, path)
        links, path, before, size = kept, kept_path, size, seen["n"]
        if before - size < TRIM_SHARE * before:
            break
    return links, path, size


def _spread(links: DataFrame, mask: int) -> tuple[DataFrame, str]:
    """(id, f, b): the largest name that reaches a node and the largest name it reaches, itself included.

    A node's name is its id with the bits of `mask` turned. Each hop is one join and one maximum: a node hands `f` along its links,
    `b` against them and both to itself, so labels are read once a hop and keep their partitioning. Before the hops of a round a node takes over the
    label of the node it is labelled with (what reaches that one reaches it too), which shortens long ways to about the logarithm of their hops.
    """
    spark = links.sparkSession
    ends = links.select(F.explode(F.array("s", "d")).alias("id")).distinct()
    ways, ways_path = write_scratch(
        links.selectExpr("s AS id", "d AS to", "true AS along", "false AS against")
        .unionByName(links.selectExpr("d AS id", "s AS to", "false AS along", "true AS against"))
        .unionByName(ends.selectExpr("id", "id AS to", "true AS along", "true AS against")))
    name = F.col("id").bitwiseXOR(F.lit(mask).cast("long"))
    labels, path, moving = ends.select("id", name.alias("f"), name.alias("b")), None, 1
    while moving:
        spreading = labels.select("id", "f", "b", F.col("f").alias("f0"), F.col("b").alias("b0"))
        for label in ("f", "b") if path else ():
            better = labels.where(F.col(label) > name).select(name.alias(label), F.col(label).alias("far"))
            spreading = spreading.join(better, label, "left").withColumn(label, F.coalesce("far", label)).drop("far")
        for _ in range(HOPS):
            own = F.col("along") & F.col("against")
            spreading = (spreading.join(ways, "id").groupBy(F.col("to").alias("id"))
                         .agg(F.max(F.when(F.col("along"), F.col("f"))).alias("f"), F.max(F.when(F.col("against"), F.col("b"))).alias("b"),
                              F.max(F.when(own, F.col("f0"))).alias("f0"), F.max(F.when(own, F.col("b0"))).alias("b0")))
        last = path
        labels, path, seen = _written(spreading, moving=(F.col("f") != F.col("f0")) | (F.col("b") != F.col("b0")))
        labels, moving = labels.select("id", "f", "b"), seen["moving"]
        if last:
            release(spark, last)
    release(spark, ways_path)
    return labels, path


def _strong(links: DataFrame, path: str, size: int) -> DataFrame:
    """(id, comp) of the nodes that share a strongly connected component with others, and of some that don't.

    links(s, d) between long ids, no loops, `size` rows in a scratch table that is used up. The largest name that reaches a node and the
    largest it reaches are the same for all members of a component. Where both agree, the component is found and `comp` is that member's
    id. Links between nodes with different labels lie in no component and go; so does what was found. The rest goes on with other names, which
    other bits make the largest. Every set of nodes with equal
    labels gives up at least one component a round.
    """
    spark = links.sparkSession
    found, schema = scratch_path(spark, "components"), StructType([StructField("id", LongType()), StructField("comp", LongType())])
    spark.createDataFrame([], schema).write.parquet(f"{found}/round=0")
    number, mask = 0, 0
    links, path, size = _trim(links, path, size)
    while size:
        number += 1
        labels, labels_path = _spread(links, mask)
        labels.where("f = b").select("id", F.col("f").bitwiseXOR(F.lit(mask).cast("long")).alias("comp")).write.parquet(f"{found}/round={number}")
        rest = labels.where("f <> b")
        inside = (links.join(rest.selectExpr("id AS s", "f", "b"), "s").join(rest.selectExpr("id AS d", "f", "b"), ["d", "f", "b"]).select("s", "d"))
        kept, kept_path, seen = _written(inside, n=F.lit(1))
        release(spark, path)
        release(spark, labels_path)
        links, path, size = _trim(kept, kept_path, seen["n"])
        # other bits decide which name is the largest
        mask = (mask * 25214903917 + 11 + number) % (1 << 62)
    release(spark, path)
    return spark.read.schema(schema).parquet(found).drop("round")


def condense(edges: DataFrame, scope: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Strongly connected components: members (scope, node, comp, cyclic) and links (src, dst) between components.

    edges(scope, src, dst). `comp` is a number that holds for this result only; `cyclic` says that a member can reach itself, which a lone node
    does only by a link to itself. Links are distinct and free of cycles. An edge with a null end or scope leads nowhere and is left out.
    Nodes are numbered in the order of a hash first: the rounds move two numbers a row, and names that rise along a way would take a round for
    every few hops of it. The rows a round moves grow with the edges, not with origins.
    """
    keys, spark = [*scope, "node"], edges.sparkSession
    pairs, pairs_path = write_scratch(edges.select(*scope, "src", "dst").dropna().distinct())
    numbered, numbered_path = write_scratch(
        pairs.select(*scope, F.explode(F.array("src", "dst")).alias("node")).distinct()
        .sortWithinPartitions(F.xxhash64(*keys)).withColumn("id", F.monotonically_increasing_id()))
    id_of = lambda column, name: numbered.select(*scope, F.col("node").alias(column), F.col("id").alias(name))
    every, every_path = write_scratch(pairs.join(id_of("src", "s"), [*scope, "src"]).join(id_of("dst", "d"), [*scope, "dst"]).select("s", "d"))
    links, links_path, seen = _written(every.where("s <> d"), n=F.lit(1))
    strong = _strong(links, links_path, seen["n"])
    size = strong.groupBy("comp").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("comp", F.lit(True).alias("wide"))
    loops = every.where("s = d").select(F.col("s").alias("id"), F.lit(True).alias("loop"))
    members = cut_lineage(numbered.join(strong.join(size, "comp"), "id", "left").join(loops, "id", "left")
                          .select(*keys, "id", F.coalesce("comp", "id").alias("comp"), F.coalesce("wide", "loop", F.lit(False)).alias("cyclic")))
    comp_of = lambda column, name: members.select(F.col("id").alias(column), F.col("comp").alias(name))
    between = cut_lineage(every.join(comp_of("s", "src"), "s").join(comp_of("d", "dst"), "d").where("src <> dst").select("src", "dst").distinct())
    for path in (pairs_path, numbered_path, every_path):
        release(spark, path)
    return members.drop("id"), between


def closure(edges: DataFrame, seeds: DataFrame, include_seeds: bool = False, scope: Sequence[str] = (), targets: DataFrame | None = None) -> DataFrame:
    """(scope, origin, node) of every node reachable from the seeds, as `reachable` without depths.

    edges(scope, src, dst), seeds(scope, origin, node), targets(scope, node): only these nodes are wanted. The walk goes over components;
    members come back by (component, part), a component's members being dealt by a hash into parts of about `MEMBERS`. With `include_seeds` a
    seed that no edge knows, null among them, is given as it is (if it is a target). A null origin is an origin like any other.
    """
    keys = [*scope, "node"]
    members, between = condense(edges, scope)
    whole = F.struct(*scope, "origin").alias("origin")
    starts = cut_lineage(seeds.select(*scope, "origin", "node").distinct().join(members, keys, "left").select(whole, "node", "comp", "cyclic"))
    walked = reachable(between, starts.where("comp IS NOT NULL").select("origin", F.col("comp").alias("node"))).select("origin", F.col("node").alias("comp"))
    own = starts.where("comp IS NOT NULL" if include_seeds else "cyclic").select("origin", "comp")
    wanted = members if targets is None else members.join(targets.select(*keys).distinct(), keys, "left_semi")
    parts = wanted.groupBy("comp").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).cast("int").alias("parts"))
    dealt = wanted.join(parts, "comp").select("node", "comp", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"))
    met = walked.unionByName(own).distinct().join(parts, "comp").select("origin", "comp", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    rows = met.join(dealt, ["comp", "part"]).select("origin.*", "node")
    if not include_seeds:
        return rows
    alone = starts.where("comp IS NULL").select("origin.*", "node")
    return rows.unionByName(alone if targets is None else alone.join(targets.select(*keys).distinct(), keys, "left_semi"))


def call_tree(edges: DataFrame, roots: DataFrame, max_depth: int = 6, scope: Sequence[str] = ()) -> DataFrame:
    """Call paths down to `max_depth`: (scope, root, path, node, depth). A node already on its path is shown, not expanded.

    edges(scope, src, dst), roots(scope, node). The depth bound is part of the feature; paths to it are all kept.
    """
    links = cut_lineage(edges.select(*scope, F.col("src").alias("node"), "dst").distinct())
    level = roots.select(*scope, F.col("node").alias("root"), F.array("node").alias("path"), "node").distinct()
    levels = []
    for depth in range(1, max_depth + 1):
        open_paths = level if depth == 1 else level.where(~F.array_contains(F.slice("path", 1, depth - 1), F.col("node")))
        level = cut_lineage(open_paths.join(links, [*scope, "node"])
                            .select(*scope, "root", F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("node")))
        levels.append(level.withColumn("depth", F.lit(depth)))
    return reduce(DataFrame.unionByName, levels)
