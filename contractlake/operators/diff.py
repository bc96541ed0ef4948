"""Contract differences of two snapshots, one function per change family.

Every function returns the long change table: endpoint keys, type, severity, item, detail.
`both` holds the endpoint keys present on both sides; only those have a contract to compare.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import is_true, keep_first_per_key, non_empty, shown
from .snapshots import pair_items, pair_keys, within

KEYS = ("repo", "api")
NOT_PARAMETERS = ("body", "model")


def _changes(df: DataFrame, keys: Sequence[str], kind: str, severity: str, item: Column, detail: Column) -> DataFrame:
    return df.select(*keys, F.lit(kind).alias("type"), F.lit(severity).alias("severity"),
                     item.cast("string").alias("item"), detail.alias("detail"))


Candidate = tuple[Column, Column, Column, Column, Column]
# Columns a change is told in. Who only counts changes asks for their severity: texts of items and details are not made then.
TOLD = ("type", "severity", "item", "detail")
# Who counts changes by type and also reads downstream items: only those are named, by group and name.
TOLD_DELTA = ("type", "severity", "grp", "name")


def _made(candidate: Candidate, told: Sequence[str] = TOLD) -> Column:
    cond, kind, severity, item, detail = candidate
    columns = {"type": kind, "severity": severity, "item": item.cast("string"), "detail": detail}
    return F.when(cond, F.struct(*[columns[c].alias(c) for c in told]))


def _emitted(df: DataFrame, keys: Sequence[str], made: Column) -> DataFrame:
    # nulls are dropped after they were exploded: a filter of the array is interpreted, and with it all that makes the array
    return df.select(*keys, F.explode(made).alias("c")).where("c IS NOT NULL").select(*keys, "c.*")


def _first(df: DataFrame, keys: Sequence[str], candidates: Sequence[Candidate], told: Sequence[str]) -> DataFrame:
    """Of each row the first change that applies; rows without one go."""
    def pick(i: int) -> Column:
        out = F
        for candidate in candidates:
            out = out.when(candidate[0], candidate[i])
        return out

    columns = {c: pick(i) for i, c in enumerate(TOLD, 1)}
    found = df.where(reduce(Column.__or__, [c[0] for c in candidates]))
    return found.select(*keys, *[columns[c].alias(c) if c in columns else F.col(c) for c in told])


def _exploded(df: DataFrame, keys: Sequence[str], candidates: Sequence[Candidate], told: Sequence[str] = TOLD) -> DataFrame:
    """Emit zero or more changes per paired row in one pass over the pairing."""
    return _emitted(df, keys, F.array(*[_made(c, told) for c in candidates]))


def _side(name: str):
    return lambda c: F.col(f"{name}.{c}")


# ---------------------------------------------------------------- endpoint

def pair_routes(base: DataFrame, head: DataFrame, keys: Sequence[str] = KEYS,
                values: Sequence[str] = ("method", "path", "body_type", "response_type")) -> DataFrame:
    return pair_items(base, head, keys, values, keep_equal=True)


def route_changes(pairs: DataFrame, keys: Sequence[str] = KEYS, told: Sequence[str] = TOLD) -> DataFrame:
    """ENDPOINT_CHANGED, REQUEST_BODY_CHANGED and RESPONSE_TYPE_CHANGED of paired routes."""
    both = pairs.where("in_base AND in_head")
    b, h = lambda c: F.col(f"base.{c}"), lambda c: F.col(f"head.{c}")
    differ = lambda c: ~b(c).eqNullSafe(h(c))
    line = lambda side: F.concat(shown(side("method")), F.lit(" "), shown(side("path")))
    arrow = lambda c: F.concat(shown(b(c)), F.lit(" → "), shown(h(c)))
    none = F.lit("")
    return _exploded(both, keys, [
        (differ("method") | differ("path"), F.lit("ENDPOINT_CHANGED"), F.lit("breaking"), none,
         F.concat(line(b), F.lit(" → "), line(h))),
        (differ("body_type"), F.lit("REQUEST_BODY_CHANGED"), F.lit("breaking"), none,
         F.concat(F.lit("request body "), arrow("body_type"))),
        (differ("response_type") & (non_empty(b("response_type")).isNotNull() | non_empty(h("response_type")).isNotNull()),
         F.lit("RESPONSE_TYPE_CHANGED"), F.lit("breaking"), none, arrow("response_type")),
    ], told)


def endpoint_presence(pairs: DataFrame, keys: Sequence[str] = KEYS, complete: bool = True) -> DataFrame:
    """ENDPOINT_ADDED, and ENDPOINT_REMOVED when both scans covered everything."""
    line = lambda side: F.concat(shown(F.col(f"{side}.method")), F.lit(" "), shown(F.col(f"{side}.path")))
    gone = ~F.col("in_head") & F.lit(complete)
    return _exploded(pairs.where("NOT (in_base AND in_head)"), keys, [
        (~F.col("in_base"), F.lit("ENDPOINT_ADDED"), F.lit("additive"), F.lit(""), line("head")),
        (gone, F.lit("ENDPOINT_REMOVED"), F.lit("breaking"), F.lit(""), line("base")),
    ])


# ---------------------------------------------------------------- parameters

def contract_params(params: DataFrame, keys: Sequence[str] = KEYS, pos: str = "pos") -> DataFrame:
    """Parameters by (location, name) without body and model ones; the last duplicate wins."""
    kept = params.where(F.col("loc").isNull() | ~F.col("loc").isin(*NOT_PARAMETERS))
    return keep_first_per_key(kept, [*keys, "loc", "name"], [pos], last=True)


def param_changes(base: DataFrame, head: DataFrame, both: DataFrame | None = None,
                  keys: Sequence[str] = KEYS, pos: str | None = "pos") -> DataFrame:
    """PARAM_ADDED, PARAM_TYPE_CHANGED, PARAM_NOW_REQUIRED, PARAM_REMOVED from one pairing."""
    is_param = F.col("loc").isNull() | ~F.col("loc").isin(*NOT_PARAMETERS)
    pairs = pair_items(base.where(is_param), head.where(is_param), [*keys, "loc", "name"], ["type", "required"], pos)
    return _exploded(within(pairs, both, keys), keys, _param_candidates(F.col("loc"), F.col("name"), _side("base"), _side("head")))


def _param_candidates(loc: Column, name: Column, b, h) -> list[Candidate]:
    kept = F.col("in_base") & F.col("in_head")
    where = F.concat(shown(loc), F.lit(" parameter `"), name, F.lit("`"))
    item = F.concat(F.coalesce(loc, F.lit("")), F.lit(":"), name)
    now = is_true(h("required"))
    return [
        (~F.col("in_base"), F.lit("PARAM_ADDED"), F.when(now, "breaking").otherwise("additive"), item,
         F.concat(where, F.lit(" ("), shown(h("type")), F.lit(")"), F.when(now, " is required").otherwise(" (optional)"))),
        (kept & ~b("type").eqNullSafe(h("type")), F.lit("PARAM_TYPE_CHANGED"), F.lit("breaking"), item,
         F.concat(where, F.lit(": "), shown(b("type")), F.lit(" → "), shown(h("type")))),
        (kept & now & ~is_true(b("required")), F.lit("PARAM_NOW_REQUIRED"), F.lit("breaking"), item,
         F.concat(where, F.lit(" became required"))),
        (~F.col("in_head"), F.lit("PARAM_REMOVED"),
         F.when(loc == "path", "breaking").otherwise("minor"), item, F.concat(where, F.lit(" removed"))),
    ]


# ---------------------------------------------------------------- request and response fields

def _rule_delta(b: Column, h: Column) -> Column:
    """Rules of both sides as an array of (rule, old, new), sorted by rule."""
    empty = F.create_map().cast("map<string,string>")
    zipped = F.map_zip_with(F.coalesce(b, empty), F.coalesce(h, empty), lambda k, o, n: F.struct(o.alias("old"), n.alias("new")))
    return F.map_entries(zipped)


def _rules_json(df: DataFrame) -> DataFrame:
    # maps cannot be aggregated or compared, so the pairing carries them as sorted JSON
    rules = F.to_json(F.map_from_entries(F.sort_array(F.map_entries(F.coalesce("rules", F.create_map().cast("map<string,string>"))))))
    return df.withColumn("rules_json", rules)


def pair_fields(base: DataFrame, head: DataFrame, both: DataFrame | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """Request fields that differ. Fields: keys, path, type, rules MAP, required."""
    return within(pair_items(_rules_json(base), _rules_json(head), [*keys, "path"], ["type", "required", "rules_json"]), both, keys)


def request_changes(pairs: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Field and validation changes of paired request fields, in one pass over the pairs."""
    return request_field_changes(pairs, keys).unionByName(validation_changes(pairs, keys))


def request_field_changes(pairs: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Added, removed and retyped request fields."""
    return _exploded(pairs, keys, _request_candidates(F.col("path"), _side("base"), _side("head")))


def _request_candidates(path: Column, b, h) -> list[Candidate]:
    name = F.concat(F.lit("`"), path, F.lit("`"))
    now = is_true(h("required"))
    kept = F.col("in_base") & F.col("in_head")
    return [
        (~F.col("in_base"), F.lit("REQUEST_FIELD_ADDED"), F.when(now, "breaking").otherwise("additive"), path,
         F.concat(name, F.lit(" ("), shown(h("type")), F.lit(")"), F.when(now, " is required").otherwise(" (optional)"))),
        (kept & ~b("type").eqNullSafe(h("type")), F.lit("REQUEST_FIELD_TYPE_CHANGED"), F.lit("breaking"), path,
         F.concat(name, F.lit(": "), shown(b("type")), F.lit(" → "), shown(h("type")))),
        (~F.col("in_head"), F.lit("REQUEST_FIELD_REMOVED"), F.lit("minor"), path,
         F.concat(name, F.lit(" is no longer read"))),
    ]


def validation_changes(pairs: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """VALIDATION_ADDED / CHANGED / REMOVED on fields that exist on both sides."""
    pairs = pairs.where("in_base AND in_head AND base.rules_json <> head.rules_json")
    return _emitted(pairs, keys, _rule_changes(F.col("path"), F.col("base.rules_json"), F.col("head.rules_json")))


def _rule_changes(path: Column, base: Column, head: Column, told: Sequence[str] = TOLD) -> Column:
    """Changes of a field's rules, given as sorted JSON; equal rules leave nulls."""
    as_map = lambda c: F.from_json(c, "map<string,string>")
    return F.flatten(F.transform(_rule_delta(as_map(base), as_map(head)), lambda r: F.array(*[
        _made(c, told) for c in _rule_candidates(path, r["key"], r["value"]["old"], r["value"]["new"])])))


def _rule_candidates(path: Column, rule: Column, old: Column, new: Column) -> list[Candidate]:
    name = F.concat(F.lit("`"), path, F.lit("`"))
    item = F.concat(path, F.lit(":"), rule)
    return [
        (old.isNull(), F.lit("VALIDATION_ADDED"), F.lit("breaking"), item,
         F.concat(name, F.lit(" now validated: "), rule, F.lit("="), new)),
        (old.isNotNull() & new.isNotNull() & (old != new), F.lit("VALIDATION_CHANGED"), F.lit("breaking"), item,
         F.concat(name, F.lit(" "), rule, F.lit(": "), old, F.lit(" → "), new)),
        (new.isNull(), F.lit("VALIDATION_REMOVED"), F.lit("minor"), item,
         F.concat(name, F.lit(" no longer validated: "), rule)),
    ]


def response_field_changes(base: DataFrame, head: DataFrame, both: DataFrame | None = None,
                           keys: Sequence[str] = KEYS) -> DataFrame:
    """Removed and retyped response fields break clients; added ones never do."""
    pairs = within(pair_items(base, head, [*keys, "path"], ["type"]), both, keys)
    return _exploded(pairs, keys, _response_candidates(F.col("path"), F.col("base.type"), F.col("head.type")))


def _response_candidates(path: Column, bt: Column, ht: Column) -> list[Candidate]:
    name = F.concat(F.lit("`"), path, F.lit("`"))
    return [
        (~F.col("in_head"), F.lit("RESPONSE_FIELD_REMOVED"), F.lit("breaking"), path,
         F.concat(name, F.lit(" is no longer returned"))),
        (F.col("in_base") & F.col("in_head") & ~bt.eqNullSafe(ht), F.lit("RESPONSE_FIELD_TYPE_CHANGED"), F.lit("breaking"),
         path, F.concat(name, F.lit(": "), shown(bt), F.lit(" → "), shown(ht))),
        (~F.col("in_base"), F.lit("RESPONSE_FIELD_ADDED"), F.lit("additive"), path,
         F.concat(name, F.lit(" ("), shown(ht), F.lit(")"))),
    ]


# ---------------------------------------------------------------- status codes and access

def status_changes(base: DataFrame, head: DataFrame, both: DataFrame | None = None,
                   keys: Sequence[str] = KEYS) -> DataFrame:
    """ERROR_STATUS_ADDED / REMOVED per code, SUCCESS_STATUS_CHANGED per endpoint."""
    pairs = within(pair_keys(base.where("code IS NOT NULL"), head.where("code IS NOT NULL"), [*keys, "code"]), both, keys)
    return error_status_changes(pairs, keys).unionByName(success_status_changes(pairs, keys))


def error_status_changes(pairs: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return _exploded(pairs.where("code >= 400"), keys, _error_candidates(F.col("code").cast("string")))


def _error_candidates(code: Column) -> list[Candidate]:
    return [
        (~F.col("in_base"), F.lit("ERROR_STATUS_ADDED"), F.lit("minor"), code, F.concat(F.lit("may now return "), code)),
        (~F.col("in_head"), F.lit("ERROR_STATUS_REMOVED"), F.lit("additive"), code, F.concat(F.lit("no longer returns "), code)),
    ]


def success_status_changes(pairs: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    # a set of status codes below 300 is bounded by the HTTP code space
    codes = lambda flag: F.array_sort(F.collect_set(F.when(F.col(flag), F.col("code"))))
    sets = (pairs.where("code < 300 AND code <> 0").groupBy(*keys)
            .agg(codes("in_base").alias("old"), codes("in_head").alias("new"))
            .where("size(old) > 0 AND size(new) > 0 AND old <> new"))
    text = lambda c: F.concat(F.lit("["), F.array_join(F.col(c).cast("array<string>"), ", "), F.lit("]"))
    return _changes(sets, keys, "SUCCESS_STATUS_CHANGED", "breaking", F.lit(""), F.concat(text("old"), F.lit(" → "), text("new")))


def security_changes(base: DataFrame, head: DataFrame, both: DataFrame | None = None,
                     keys: Sequence[str] = KEYS) -> DataFrame:
    """SECURITY_CHANGED when the annotation set or the URL rule differs.

    Rows: keys, annotation, expression, access, roles; one row per annotation of an endpoint.
    The fingerprint lists are declared per endpoint in source code, so they stay short.
    """
    return security_fingerprint_changes(security_fingerprint(base, keys), security_fingerprint(head, keys), both, keys)


def security_fingerprint(rows: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Sorted `annotation:expression` list plus the URL rule per endpoint."""
    entry = F.when(F.col("annotation").isNotNull(), F.concat(F.col("annotation"), F.lit(":"), shown("expression")))
    return rows.groupBy(*keys).agg(
        F.array_sort(F.collect_list(entry)).alias("annotations"),
        F.max("access").alias("access"), F.max("roles").alias("roles"))


def security_fingerprint_changes(base: DataFrame, head: DataFrame, both: DataFrame | None = None,
                                 keys: Sequence[str] = KEYS) -> DataFrame:
    pairs = within(pair_items(base, head, keys, ["annotations", "access", "roles"]), both, keys)
    # an endpoint without any access row equals one with an empty fingerprint
    none = F.array().cast("array<string>")
    b = F.struct(F.coalesce(F.col("base.annotations"), none), F.col("base.access"), F.col("base.roles"))
    h = F.struct(F.coalesce(F.col("head.annotations"), none), F.col("head.access"), F.col("head.roles"))
    text = lambda c: F.when(F.size(c) > 0, F.array_join(c, ", "))
    return pairs.where(~b.eqNullSafe(h)).select(
        *keys, F.lit("SECURITY_CHANGED").alias("type"), F.lit("breaking").alias("severity"), F.lit("").alias("item"),
        F.lit("access rules changed").alias("detail"),
        text(F.col("base.annotations")).alias("old"), text(F.col("head.annotations")).alias("new"))


# ---------------------------------------------------------------- downstream systems

def downstream_delta(base: DataFrame, head: DataFrame, both: DataFrame | None = None,
                     keys: Sequence[str] = KEYS) -> DataFrame:
    """Added and removed downstream items, one row per item: keys, grp, item, change."""
    pairs = within(pair_keys(base, head, [*keys, "grp", "item"]).where("NOT (in_base AND in_head)"), both, keys)
    return pairs.select(*keys, "grp", "item", F.when(F.col("in_head"), "added").otherwise("removed").alias("change"))


def dependency_items(base: DataFrame | None, head: DataFrame, keys: Sequence[str] = KEYS,
                     both: DataFrame | None = None) -> DataFrame:
    """Items of the new version marked same or new, and removed ones of the old version."""
    if base is None:
        return head.select(*keys, "grp", "item").distinct().withColumn("status", F.lit("same"))
    pairs = within(pair_keys(base, head, [*keys, "grp", "item"]), both, keys)
    status = F.when(~F.col("in_head"), "removed").when(~F.col("in_base"), "new").otherwise("same")
    return pairs.select(*keys, "grp", "item", status.alias("status"))


# ---------------------------------------------------------------- model types

def model_field_changes(base: DataFrame, head: DataFrame, keys: Sequence[str] = ("dto",)) -> DataFrame:
    """Type-level diff of data model fields: keys, type, field, old, new, required."""
    pairs = pair_items(_rules_json(base), _rules_json(head), [*keys, "path"], ["type", "required", "rules_json"])
    kept = F.col("in_base") & F.col("in_head")
    as_map = lambda side: F.from_json(F.col(f"{side}.rules_json"), "map<string,string>")
    make = lambda kind, rule, old, new, required: F.struct(
        F.lit(kind).alias("type") if isinstance(kind, str) else kind.alias("type"), rule.alias("rule"),
        old.alias("old"), new.alias("new"), required.alias("required"))
    nil, no = F.lit(None).cast("string"), F.lit(False)
    fields = F.filter(F.array(
        F.when(~F.col("in_head"), make("FIELD_REMOVED", nil, F.col("base.type"), nil, no)),
        F.when(~F.col("in_base"), make("FIELD_ADDED", nil, nil, F.col("head.type"), is_true(F.col("head.required")))),
        F.when(kept & ~F.col("base.type").eqNullSafe(F.col("head.type")),
               make("TYPE_CHANGED", nil, F.col("base.type"), F.col("head.type"), no)),
    ), lambda c: c.isNotNull())

    def rule_row(r):
        old, new = r["value"]["old"], r["value"]["new"]
        kind = F.when(old.isNull(), "VALIDATION_ADDED").when(new.isNull(), "VALIDATION_REMOVED").otherwise("VALIDATION_CHANGED")
        changed = old.isNotNull() & new.isNotNull()
        return make(kind, r["key"], F.when(changed, old), F.when(changed, new), no)

    delta = F.filter(_rule_delta(as_map("base"), as_map("head")), lambda r: ~r["value"]["old"].eqNullSafe(r["value"]["new"]))
    rules = F.when(kept & (F.col("base.rules_json") != F.col("head.rules_json")), F.transform(delta, rule_row)).otherwise(
        F.slice(fields, 1, 0))
    return (pairs.select(*keys, F.col("path").alias("field"), F.explode(F.concat(fields, rules)).alias("c"))
            .select(*keys, "field", "c.*"))


# ---------------------------------------------------------------- everything

# Columns every family is told in: two parts of an item's name and up to three values.
ITEM_COLUMNS = ("family", "n1", "n2", "v1", "v2", "v3")
# Families whose items are names without values: one that only one side has is a change as it is and needs no pairing.
NAMED = ("error", "downstream")


def _items(side: dict[str, DataFrame], other: dict[str, DataFrame], keys: Sequence[str], pos: str | None) -> tuple[DataFrame | None, DataFrame | None]:
    """Rows of all families of a snapshot that both sides have: items with values in ITEM_COLUMNS, and the families of NAMED in their names alone.

    Success codes and access rules count as a whole per endpoint, so they are one item each.
    """
    nil, no = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    text = lambda c: F.col(c).cast("string")
    flag = lambda c: F.col(c).cast("boolean")
    have = lambda name: name in side and name in other
    parts, named = [], []

    def add(df, family, n1=nil, n2=nil, v1=nil, v2=no, v3=nil):
        columns = [c.alias(n) for n, c in zip(ITEM_COLUMNS, (F.lit(family), n1, n2, v1, v2, v3))]
        (named if family in NAMED else parts).append(df.select(*keys, *(columns[:3] if family in NAMED else columns)))

    if have("params"):
        params = side["params"].where(F.col("loc").isNull() | ~F.col("loc").isin(*NOT_PARAMETERS))
        if pos:
            params = keep_first_per_key(params.select(*keys, "loc", "name", "type", "required", pos), [*keys, "loc", "name"], [pos], last=True)
        add(params, "param", text("loc"), text("name"), text("type"), flag("required"))
    if have("request_fields"):
        add(_rules_json(side["request_fields"]), "request", text("path"), v1=text("type"), v2=flag("required"), v3=F.col("rules_json"))
    if have("response_fields"):
        add(side["response_fields"], "response", text("path"), v1=text("type"))
    if have("statuses"):
        codes = side["statuses"]
        add(codes.where("code >= 400"), "error", text("code"))
        # a set of status codes below 300 is bounded by the HTTP code space
        success = codes.where("code < 300 AND code <> 0").groupBy(*keys).agg(F.array_sort(F.collect_set("code")).alias("codes"))
        add(success, "success", v1=F.concat(F.lit("["), F.array_join(F.col("codes").cast("array<string>"), ", "), F.lit("]")))
    if have("security"):
        rules = F.struct(F.coalesce("annotations", F.array().cast("array<string>")).alias("annotations"), "access", "roles")
        prints = security_fingerprint(side["security"], keys).withColumn("print", F.to_json(rules))
        add(prints.where("size(annotations) > 0 OR access IS NOT NULL OR roles IS NOT NULL"), "access", v1=F.col("print"))
    if have("downstream"):
        add(side["downstream"], "downstream", text("grp"), text("item"))
    return tuple(reduce(DataFrame.unionByName, p) if p else None for p in (parts, named))


def unscoped_changes(base: dict[str, DataFrame], head: dict[str, DataFrame], pairs: DataFrame,
                     keys: Sequence[str] = KEYS, pos: str | None = None, told: Sequence[str] = TOLD) -> DataFrame:
    """Changes of all families, not yet limited to endpoints present on both sides, in the columns `told`.

    The items of all families with values are one long table a side, so everything equal cancels in a single aggregate, whatever the number of
    families; what differs is paired once and judged in one pass. Items that are names alone are another such table: what does not cancel there is a
    change. Downstream items have severity `delta`, their group as item and their name as detail; `grp` and `name` tell the same for them alone.
    """
    (base_items, base_named), (head_items, head_named) = _items(base, head, keys, pos), _items(head, base, keys, pos)
    told_all = [c for c in told if c in TOLD]
    n1, n2, none, nil = F.col("n1"), F.col("n2"), F.lit(""), F.lit(None).cast("string")
    whole = lambda df: df.select(*keys, *[c if c in told_all else nil.alias(c) for c in told])
    found = [whole(route_changes(pairs, keys, told_all))]
    if base_items is not None:
        differ = pair_items(base_items, head_items, [*keys, *ITEM_COLUMNS[:3]], ITEM_COLUMNS[3:])
        names = {"type": "v1", "required": "v2"}
        b, h = (lambda c, side=side: F.col(f"{side}.{names[c]}") for side in ("base", "head"))
        kept = F.col("in_base") & F.col("in_head")
        both = F.array(*[F.when(kept, x) for x in (F.col("base.v1"), F.col("head.v1"))])
        of = lambda candidates: F.array(*[_made(c, told_all) for c in candidates])
        rules = F.when(kept & (F.col("base.v3") != F.col("head.v3")), _rule_changes(n1, F.col("base.v3"), F.col("head.v3"), told_all))
        request = of(_request_candidates(n1, b, h))
        families = {
            "param": of(_param_candidates(n1, n2, b, h)),
            "request": F.when(rules.isNull(), request).otherwise(F.concat(request, rules)),
            "response": of(_response_candidates(n1, b("type"), h("type"))),
            "success": of([(kept, F.lit("SUCCESS_STATUS_CHANGED"), F.lit("breaking"), none, F.array_join(both, " → "))]),
            "access": of([(F.lit(True), F.lit("SECURITY_CHANGED"), F.lit("breaking"), none, F.lit("access rules changed"))]),
        }
        made = None
        for family, changes in families.items():
            made = F.when(F.col("family") == family, changes) if made is None else made.when(F.col("family") == family, changes)
        found.append(whole(_emitted(differ, keys, made)))
    if base_named is not None:
        names = ITEM_COLUMNS[:3]
        alone = pair_keys(base_named, head_named, [*keys, *names], dealt=True).where("NOT (in_base AND in_head)")
        delta = F.col("family") == "downstream"
        alone = alone.withColumns({"grp": F.when(delta, n1), "name": F.when(delta, n2)})
        found.append(_first(alone, keys, [
            (delta, F.when(F.col("in_head"), "DOWNSTREAM_ADDED").otherwise("DOWNSTREAM_REMOVED"), F.lit("delta"), n1, n2), *_error_candidates(n1)], told))
    return reduce(DataFrame.unionByName, found)


def delta_of(changes: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The rows of `downstream_delta` among `unscoped_changes`, told in TOLD or TOLD_DELTA."""
    group, name = ("grp", "name") if "grp" in changes.columns else ("item", "detail")
    return changes.where("severity = 'delta'").select(
        *keys, F.col(group).alias("grp"), F.col(name).alias("item"), F.when(F.col("type") == "DOWNSTREAM_ADDED", "added").otherwise("removed").alias("change"))


def contract_changes(base: dict[str, DataFrame], head: dict[str, DataFrame], keys: Sequence[str] = KEYS,
                     pos: str | None = None, pairs: DataFrame | None = None, downstream: bool = False, told: Sequence[str] = TOLD) -> DataFrame:
    """All changes of endpoints present on both sides, in the columns `told`: one semi join after the union.

    `base` and `head` map routes, params, request_fields, response_fields, statuses, security
    to their tables; missing parts are skipped. `downstream` adds the rows that `delta_of` reads.
    """
    pairs = pairs if pairs is not None else pair_routes(base["routes"], head["routes"], keys)
    both = pairs.where("in_base AND in_head").select(*keys)
    found = unscoped_changes({k: v for k, v in base.items() if k != "downstream"} if not downstream else base, head, pairs, keys, pos, told)
    return within(found, both, keys)
