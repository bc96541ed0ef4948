"""Joins over a symbol table: type resolution, inheritance, field lookup and call dispatch.

The symbol table is an input: types, methods, fields, imports and calls as rows. Lookups meet
unique keys only, so a name shared by a third of all types never multiplies with its references.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .closure import reachable

# How a simple name is looked up, nearest meaning first.
NESTED, IMPORTED, SAME_PACKAGE, WILDCARD, SAME_MODULE, ANYWHERE = range(6)


def _lookup(types: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """(scope, key, type): each way a type can be found, reduced to the first type by position."""
    key = lambda kind, *parts: F.struct(F.concat(F.lit(f"{kind}:"), *parts).alias("key"))
    name, dot = F.col("name"), F.lit(".")
    keys = F.filter(F.array(
        key("q", F.col("type")),
        F.when(F.col("outer").isNotNull(), key("n", F.col("outer"), dot, name)),
        F.when(F.col("outer").isNull(), key("p", F.col("package"), dot, name)),
        key("m", F.col("module"), F.lit("/"), name),
        key("s", name)), lambda k: k.isNotNull())
    rows = types.select(*scope, "type", "pos", F.explode(keys).alias("k"))
    return rows.groupBy(*scope, F.col("k.key").alias("key")).agg(F.min_by("type", F.struct("pos", "type")).alias("type"))


def resolve_type(refs: DataFrame, contexts: DataFrame, types: DataFrame, imports: DataFrame, keys: Sequence[str] = ("ref",),
                 scope: Sequence[str] = ()) -> DataFrame:
    """Adds `resolved`: the type a simple or dotted name means, seen from its context.

    With a `scope`, such as the repository, all tables carry it, and a name only means types of its own scope; `keys` then tell refs apart within a scope.

    refs(keys, name, context), contexts(context, package, module, scopes ARRAY nearest first, wildcards ARRAY), imports(context, name, qualified),
    types(type, name, package, outer, module, pos). Each reference lists the lookup keys it may mean with
    their rank, meets them in one equality join and keeps the best. Imports are a long table that is met by context and name.
    """
    keys = [*dict.fromkeys([*scope, *keys])]
    imported = imports.groupBy(*scope, "context", F.col("name").alias("_simple")).agg(F.min("qualified").alias("_imported"))
    r = (refs.join(contexts, [*scope, "context"], "left").withColumn("_simple", F.substring_index("name", ".", -1)).join(imported, [*scope, "context", "_simple"], "left"))
    simple = F.col("_simple")
    entry = lambda rank, sub, key: F.struct(F.lit(rank).alias("rank"), sub.alias("sub"), key.alias("key"))
    zero = F.lit(0)
    none = F.array().cast("array<struct<rank:int,sub:int,key:string>>")
    nested = F.transform(F.col("scopes"), lambda s, i: entry(NESTED, i, F.concat(F.lit("n:"), s, F.lit("."), simple)))
    wild = F.transform(F.col("wildcards"), lambda p, i: entry(WILDCARD, i, F.concat(F.lit("q:"), p, F.lit("."), simple)))
    single = F.array(
        F.when(F.col("name").contains("."), entry(-1, zero, F.concat(F.lit("q:"), "name"))),
        F.when(F.col("_imported").isNotNull(), entry(IMPORTED, zero, F.concat(F.lit("q:"), "_imported"))),
        F.when(F.col("package").isNotNull(), entry(SAME_PACKAGE, zero, F.concat(F.lit("p:"), "package", F.lit("."), simple))),
        F.when(F.col("module").isNotNull(), entry(SAME_MODULE, zero, F.concat(F.lit("m:"), "module", F.lit("/"), simple))),
        entry(ANYWHERE, zero, F.concat(F.lit("s:"), simple)))
    asked = F.concat(F.filter(single, lambda k: k.isNotNull()), F.coalesce(nested, none), F.coalesce(wild, none))
    rows = r.select(*keys, F.explode(asked).alias("a")).select(*keys, "a.*").join(_lookup(types, scope), [*scope, "key"])
    best = rows.groupBy(*keys).agg(F.min_by("type", F.struct("rank", "sub")).alias("resolved"))
    return refs.join(best, keys, "left")


def supertypes(parents: DataFrame, types: DataFrame | None = None, scope: Sequence[str] = ()) -> DataFrame:
    """(scope, type, ancestor, depth) over extends / implements edges (scope, type, parent), nearest depth."""
    seeds = (types if types is not None else parents).select(*scope, F.col("type").alias("origin"), F.col("type").alias("node")).distinct()
    closed = reachable(parents.select(*scope, F.col("type").alias("src"), F.col("parent").alias("dst")), seeds, scope=scope)
    return closed.where("origin <> node").select(*scope, F.col("origin").alias("type"), F.col("node").alias("ancestor"), "depth")


def subtypes(parents: DataFrame, types: DataFrame | None = None, scope: Sequence[str] = ()) -> DataFrame:
    """(scope, type, subtype, depth), the same closure read downwards."""
    down = supertypes(parents, None if types is None else types, scope)
    return down.select(*scope, F.col("ancestor").alias("type"), F.col("type").alias("subtype"), "depth")


def is_subtype(types: DataFrame, references: DataFrame, supers: DataFrame, name: str) -> DataFrame:
    """Types that have the name or inherit a reference of that name, indexed or not.

    types(type, name), references(type, ref_name) as written, supers(type, ancestor).
    """
    named = references.where(F.col("ref_name") == name).select(F.col("type").alias("owner")).distinct()
    own = types.where(F.col("name") == name).select("type")
    direct = types.select("type").join(named.withColumnRenamed("owner", "type"), "type", "left_semi")
    inherited = supers.join(named.withColumnRenamed("owner", "ancestor"), "ancestor", "left_semi").select("type")
    return own.unionByName(direct).unionByName(inherited).distinct()


def owner_chain(types: DataFrame, supers: DataFrame, scopes: DataFrame) -> DataFrame:
    """(type, owner, scope_depth, ancestor_depth): where a member of a type is searched.

    scopes(type, scope, scope_depth) holds the type itself at 0 and its enclosing types.
    """
    every = types.select(F.col("type").alias("scope"), F.col("type").alias("owner"), F.lit(0).alias("ancestor_depth")).unionByName(
        supers.select(F.col("type").alias("scope"), F.col("ancestor").alias("owner"), F.col("depth").alias("ancestor_depth")))
    return scopes.join(every, "scope").select("type", "owner", "scope_depth", "ancestor_depth")


def find_field(refs: DataFrame, fields: DataFrame, owners: DataFrame, keys: Sequence[str] = ("ref",), scope: Sequence[str] = ()) -> DataFrame:
    """First field of a name in the type, its ancestors, then the enclosing types. refs(keys, type, name), fields(owner, name, field_type).

    With a `scope`, such as the repository, all tables carry it, and only names of one scope meet.
    """
    keys = [*dict.fromkeys([*scope, *keys])]
    found = refs.join(owners, [*scope, "type"]).join(fields, [*scope, "owner", "name"])
    best = found.groupBy(*keys).agg(F.min_by(F.struct("owner", "field_type"), F.struct("scope_depth", "ancestor_depth", "owner")).alias("f"))
    return best.select(*keys, "f.owner", "f.field_type")


def _fits(argc: Column) -> Column:
    return (F.col("n_params") == argc) | (F.col("varargs") & (argc >= F.col("n_params") - 1))


def virtual_dispatch(calls: DataFrame, methods: DataFrame, supers: DataFrame, keys: Sequence[str] = ("call",), scope: Sequence[str] = ()) -> DataFrame:
    """(keys, method, inherited): methods a call may run.

    calls(keys, type, name, argc NULL when unknown), methods(method, owner, name, n_params, varargs, abstract, pos), supers(type, ancestor, depth); with a
    `scope`, such as the repository, all three carry it, and only names of one scope meet. The nearest owner with the name counts; when there is none, or only
    abstract ones, concrete overrides of the subtypes join in. Each distinct (type, name, argc) is worked out once, so a hot base type is met once per
    signature, not once per call.
    """
    keys = [*dict.fromkeys([*scope, *keys])]
    signed = _signed(calls, scope)
    found = _dispatch(signed.select("_signature", *scope, "type", "name", "argc").distinct(), methods, supers, scope)
    return signed.select(*keys, "_signature").join(found, "_signature").drop("_signature", "alone")


def _signed(calls: DataFrame, scope: Sequence[str]) -> DataFrame:
    unknown = F.coalesce(F.col("argc").cast("string"), F.lit("?"))
    return calls.withColumn("_signature", F.concat_ws("\u0001", *[F.col(c).cast("string") for c in (*scope, "type")], "name", unknown))


def _overloads(methods: DataFrame, scope: Sequence[str]) -> DataFrame:
    """(scope, owner, name): the concrete methods of that name, and what tells whether any of the name, abstract or not, fits an argument count."""
    count = F.col("n_params").cast("long")
    # the overloads of one name in one type are few; an unknown count fits every call, unknown varargs count as varargs
    return methods.repartition(*scope, "owner").groupBy(*scope, "owner", "name").agg(
        F.collect_set(count).alias("_counts"), F.bool_or(count.isNull()).alias("_unknown"), F.min(F.when(F.coalesce("varargs", F.lit(True)), count - 1)).alias("_least"),
        F.collect_list(F.when(~F.col("abstract"), F.struct("method", "pos", "n_params", "varargs"))).alias("_concrete"))


def _dispatch(calls: DataFrame, methods: DataFrame, supers: DataFrame, scope: Sequence[str]) -> DataFrame:
    """(_signature, method, pos, inherited, alone) of distinct signatures; `alone` marks overrides of signatures that nobody above has a method for.

    A signature meets the methods of its name along its line, so its groups are small. Downwards a type meets each subtype once, with all its open
    signatures, and a subtype's overloads are judged within that row: the pairs of signatures and overrides are made last and not shuffled.
    """
    fit = F.coalesce(_fits(F.col("argc")), F.lit(True))
    columns = ["_signature", *scope, "name", "argc"]
    line = calls.select(*columns, F.col("type").alias("owner"), F.lit(0).alias("depth")).unionByName(
        calls.join(supers, [*scope, "type"]).select(*columns, F.col("ancestor").alias("owner"), "depth"))
    w = Window.partitionBy("_signature")
    # the nearest owner, of its methods those that fit the argument count, or all when none does
    near = (line.join(methods, [*scope, "owner", "name"]).withColumn("_near", F.min(F.struct("depth", "owner")).over(w)).where(F.struct("depth", "owner") == F.col("_near"))
            .withColumn("_fit", fit).withColumn("_any", F.max("_fit").over(w)).where("_fit OR NOT _any"))
    own = cut_lineage(near.select("_signature", "method", "abstract", "pos"))
    settled = own.groupBy("_signature").agg(F.bool_or(F.coalesce(~F.col("abstract"), F.lit(False))).alias("_concrete"))
    open_calls = calls.join(settled, "_signature", "left").where("NOT coalesce(_concrete, false)").withColumn("alone", F.col("_concrete").isNull())
    # what is open of a type: name -> argument counts. The counts are plain numbers, as the map goes along to every subtype
    counts = F.transform(F.collect_list(F.struct("argc")), lambda a: a["argc"])
    opened = (open_calls.where("name IS NOT NULL").groupBy(*scope, "type", "alone", "name").agg(counts.alias("_asked"))
              .groupBy(*scope, "type", "alone").agg(F.map_from_entries(F.collect_list(F.struct("name", "_asked"))).alias("_names")))
    below = supers.select(*scope, F.col("ancestor").alias("type"), F.col("type").alias("owner"))
    down = opened.join(below.hint("merge"), [*scope, "type"]).join(_overloads(methods, scope).hint("merge"), [*scope, "owner"])
    down = down.select(*scope, "type", "name", "alone", "_counts", "_unknown", "_least", "_concrete", F.explode(F.try_element_at("_names", F.col("name"))).alias("argc"))
    argc = F.col("argc").cast("long")
    some = argc.isNull() | F.col("_unknown") | F.coalesce(F.array_contains("_counts", argc), F.lit(False)) | F.coalesce(argc >= F.col("_least"), F.lit(False))
    down = down.select(*scope, "type", "name", "argc", "alone", some.alias("_any"), F.explode("_concrete").alias("_m"))
    impls = down.select(*scope, "type", "name", "argc", "alone", "_any", "_m.*").where(fit | ~F.col("_any"))
    return (own.select("_signature", "method", "pos", F.lit(True).alias("inherited"), F.lit(False).alias("alone"))
            .unionByName(_signed(impls, scope).select("_signature", "method", "pos", F.lit(False).alias("inherited"), "alone")))


def resolve_calls(chains: DataFrame, methods: DataFrame, supers: DataFrame, listeners: DataFrame | None = None,
                  published: DataFrame | None = None, skip_owners: DataFrame | None = None, scope: Sequence[str] = ()) -> DataFrame:
    """Call edges (scope, caller, callee) from call chains, plus publisher -> listener edges.

    chains(chain, caller, root_type, step, name, argc): step i + 1 resolves on the return type of step i.
    methods also carry return_type; skip_owners(owner) lists data types that get no edges. With a `scope` all tables carry it, and names meet within it only.
    The loop runs once per step of the longest chain, a code-length bound. Signatures are settled once: a step only works out those that no earlier step met.
    """
    scope = list(scope)
    methods, supers, chains = cut_lineage(methods), cut_lineage(supers), cut_lineage(chains.select(*scope, "chain", "caller", "root_type", "step", "name", "argc"))
    longest = chains.agg(F.max("step")).first()[0] or 0
    state = chains.where("step = 1").select(*scope, "chain", F.col("root_type").alias("type"))
    asks, known, memo = [], None, None
    returns = methods.where("return_type IS NOT NULL").select(*scope, "method", F.col("return_type").alias("_returns"))
    for step in range(1, longest + 1):
        asked = _signed(chains.where(F.col("step") == step).join(state, [*scope, "chain"]).select(*scope, "chain", "caller", "type", "name", "argc"), scope)
        asked = cut_lineage(asked)
        wanted = asked.select("_signature", *scope, "type", "name", "argc").distinct()
        fresh = wanted if known is None else wanted.join(known, "_signature", "left_anti")
        settled = cut_lineage(_dispatch(fresh, methods, supers, scope))
        memo = settled if memo is None else memo.unionByName(settled)
        known = wanted.select("_signature") if known is None else known.unionByName(wanted.select("_signature"))
        asks.append(asked.select(*scope, "caller", "_signature"))
        if step == longest:
            break
        # the chain goes on with the return type of the first candidate: inherited ones come first, so overrides count only where there is none
        first = memo.where("inherited OR alone").groupBy("_signature").agg(F.min_by("method", F.struct(~F.col("inherited"), "pos", "method")).alias("method"))
        state = (asked.select(*scope, "chain", "_signature").join(first, "_signature").join(returns, [*scope, "method"])
                 .select(*scope, "chain", F.col("_returns").alias("type")))
    if asks:
        # what the steps ask meets the settled signatures once
        out = reduce(DataFrame.unionByName, asks).distinct().join(memo.hint("merge"), "_signature").select(*scope, "caller", F.col("method").alias("callee"))
    else:
        out = chains.select(*scope, "caller", F.col("caller").alias("callee")).where("false")
    out = out.where("caller <> callee")
    if skip_owners is not None:
        data = methods.join(skip_owners, [*scope, "owner"], "left_semi").select(*scope, F.col("method").alias("callee"))
        out = out.join(data, [*scope, "callee"], "left_anti")
    if listeners is not None and published is not None:
        events = published.join(listeners, [*scope, "event_type"]).select(*scope, F.col("method").alias("caller"), F.col("listener").alias("callee"))
        out = out.unionByName(events.select(*out.columns))
    return out.select(*scope, "caller", "callee").distinct()


def component_dependencies(types: DataFrame, fields: DataFrame, constructors: DataFrame, setters: DataFrame,
                           targets: DataFrame) -> DataFrame:
    """Injected dependencies: (type, field, target_type, injection, target, implementations).

    types(type, lombok), fields(type, field, field_type, static, final, has_init, injected), constructors(type, ctor, autowired, param,
    param_type, is_value), setters(type, param, param_type), targets(field_type, target, implementation).
    """
    on_type = fields.join(types, "type").where("NOT static")
    by_field = on_type.where("injected").select("type", "field", F.col("field_type").alias("target_type"), F.lit("field").alias("injection"))
    by_lombok = on_type.where("NOT injected AND final AND lombok AND NOT has_init").select(
        "type", "field", F.col("field_type").alias("target_type"), F.lit("constructor").alias("injection"))
    chosen = constructors.groupBy("type").agg(F.count_distinct("ctor").alias("_n"), F.bool_or("autowired").alias("_auto"))
    active = chosen.join(types.select("type", "lombok"), "type").where("_n = 1 OR _auto OR lombok").select("type")
    taken = by_field.unionByName(by_lombok)
    by_ctor = (constructors.where("NOT is_value").join(active, "type", "left_semi")
               .select("type", F.col("param").alias("field"), F.col("param_type").alias("target_type"), F.lit("constructor").alias("injection"))
               .join(taken.select("type", "field"), ["type", "field"], "left_anti"))
    by_setter = setters.select("type", F.col("param").alias("field"), F.col("param_type").alias("target_type"), F.lit("setter").alias("injection"))
    deps = taken.unionByName(by_ctor).unionByName(by_setter).distinct()
    return deps.join(targets.withColumnRenamed("field_type", "target_type"), "target_type", "left")


def expand_schema(roots: DataFrame, fields: DataFrame, max_depth: int = 4) -> DataFrame:
    """Field tree of model types as flat rows: (root, path, type, kind, ref, depth).

    roots(root, type), fields(type, name, field_type, kind in simple / enum / object / array / map, target NULL unless it descends).
    The depth bound and the cycle mark (`ref`) are the feature; each level is one equality join.
    """
    out = []
    level = roots.select("root", "type", F.lit("").alias("prefix"), F.array("type").alias("seen"))
    for depth in range(0, max_depth + 1):
        rows = level.join(fields, "type")
        again = F.array_contains("seen", F.col("target"))
        ref = F.col("target").isNotNull() & (again | F.lit(depth >= max_depth))
        rows = cut_lineage(rows.select(
            "root", F.concat("prefix", "name").alias("path"), F.col("field_type").alias("type"), "kind", F.coalesce(ref, F.lit(False)).alias("ref"),
            F.lit(depth).alias("depth"), "target", "seen"))
        out.append(rows.drop("target", "seen"))
        if depth == max_depth:
            break
        open_rows = rows.where("target IS NOT NULL AND NOT ref AND kind <> 'map'")
        level = open_rows.select("root", F.col("target").alias("type"), F.concat("path", F.lit(".")).alias("prefix"),
                                 F.concat("seen", F.array("target")).alias("seen"))
    return reduce(DataFrame.unionByName, out)


def effective_fields(fields: DataFrame, supers: DataFrame) -> DataFrame:
    """Own and inherited fields per type; the nearest owner overrides. fields(owner, name, ...)."""
    values = [c for c in fields.columns if c not in ("owner", "name")]
    own = fields.withColumn("type", F.col("owner")).withColumn("_depth", F.lit(0))
    inherited = supers.select("type", F.col("ancestor").alias("owner"), F.col("depth").alias("_depth")).join(fields.hint("merge"), "owner")
    # a type meets its owners in different tasks, so combining there would sort and keep every row: they are dealt out by type first
    rows = own.unionByName(inherited.select(*own.columns)).repartition("type", "name")
    best = rows.groupBy("type", "name").agg(F.min_by(F.struct("owner", *values), F.struct("_depth", "owner")).alias("f"))
    return best.select("type", "name", *[F.col(f"f.{v}").alias(v) for v in values])
