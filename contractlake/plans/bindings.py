"""Snapshot, version and graph relations derived from the driver tables.

The driver tables hold no scan reports, so each relation is a deterministic view over whole
tables, written in the SQL that Spark and DuckDB share. The two snapshots differ by values of
the data: a brand that only one side knows, or the smallest tax over other order lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .registry import Source, with_relations

API = "'part-' || l_partkey"
LOC = "CASE l_linenumber WHEN 1 THEN 'path' WHEN 2 THEN 'query' WHEN 3 THEN 'header' WHEN 4 THEN 'cookie' END"
TAX = "CAST(round(l_tax * 100) AS INT)"
CODE = ("CASE l_linenumber WHEN 1 THEN 200 WHEN 2 THEN 201 WHEN 3 THEN 404 WHEN 4 THEN 409 "
        "WHEN 5 THEN 500 WHEN 6 THEN 503 ELSE 422 END")


def _params(side: str) -> str:
    lines, seen = ("l_linenumber <> 5", "true") if side == "base" else ("l_linenumber NOT IN (3, 6)", "l_discount < 0.09")
    return (f"SELECT {API} AS api, {LOC} AS loc, 'p' || l_linenumber AS name, "
            f"'T' || min(CASE WHEN {seen} THEN {TAX} END) AS type, "
            f"bool_and(CASE WHEN {seen} THEN l_returnflag <> 'A' END) AS required "
            f"FROM lineitem WHERE {lines} GROUP BY l_partkey, l_linenumber")


def _fields(side: str) -> str:
    gone, pattern, seen = ("4", "6", "true") if side == "base" else ("7", "5", "l_discount < 0.09")
    return (f"SELECT {API} AS api, 'f' || {TAX} AS path, "
            f"'S' || min(CASE WHEN {seen} THEN CASE l_linestatus WHEN 'F' THEN 0 ELSE 1 END END) AS type, "
            f"bool_and(CASE WHEN {seen} THEN l_returnflag = 'R' END) AS required, "
            f"CAST(CAST(min(CASE WHEN {seen} THEN l_quantity END) AS INT) AS VARCHAR(10)) AS rule_min, "
            f"CASE WHEN {TAX} = {pattern} THEN '[a-z]+' END AS rule_pattern "
            f"FROM lineitem WHERE {TAX} <> {gone} GROUP BY l_partkey, {TAX}")


RELATIONS: dict[str, str] = {
    "R_base": ("SELECT 'part-' || p_partkey AS api, p_type AS method, '/' || p_brand || '/' || p_partkey AS path, "
               "p_brand AS body_type, p_name AS response_type FROM part WHERE p_brand <> 'Brand#7'"),
    "R_head": ("SELECT 'part-' || p_partkey AS api, CASE WHEN p_size = 13 THEN 'X' ELSE p_type END AS method, "
               "'/' || p_brand || '/' || p_partkey AS path, "
               "CASE WHEN p_size = 17 THEN p_brand || '2' ELSE p_brand END AS body_type, "
               "CASE WHEN p_size = 19 THEN NULL ELSE p_name END AS response_type FROM part WHERE p_brand <> 'Brand#11'"),
    "R_both": "SELECT api FROM R_base INTERSECT SELECT api FROM R_head",
    "P_base": _params("base"),
    "P_head": _params("head"),
    "F_base": _fields("base"),
    "F_head": _fields("head"),
    "S_base": f"SELECT DISTINCT {API} AS api, {CODE} AS code FROM lineitem WHERE l_linestatus = 'F'",
    "S_head": f"SELECT DISTINCT {API} AS api, {CODE} AS code FROM lineitem WHERE l_linestatus = 'O'",
    "D_base": (f"SELECT DISTINCT {API} AS api, CASE l_returnflag WHEN 'A' THEN 'databases' WHEN 'N' THEN 'caches' "
               "ELSE 'external_apis' END AS grp, 'sys-' || l_suppkey AS item FROM lineitem WHERE l_linestatus = 'F'"),
    "D_head": (f"SELECT DISTINCT {API} AS api, CASE l_returnflag WHEN 'A' THEN 'databases' WHEN 'N' THEN 'caches' "
               "ELSE 'external_apis' END AS grp, 'sys-' || l_suppkey AS item FROM lineitem WHERE l_linestatus = 'O'"),
    # access rows: one annotation per part, some parts without
    "A_base": "SELECT 'part-' || p_partkey AS api, 'PreAuthorize' AS annotation, 'role-' || p_size AS expression FROM part WHERE p_size <> 31",
    "A_head": ("SELECT 'part-' || p_partkey AS api, 'PreAuthorize' AS annotation, CASE WHEN p_size = 23 THEN 'admin' ELSE 'role-' || p_size END AS expression "
               "FROM part WHERE p_size <> 37"),
    # response fields, one per order line that is a parameter too
    "O_base": "SELECT api, 'r' || substr(name, 2, 9) AS path, type FROM P_base",
    "O_head": "SELECT api, 'r' || substr(name, 2, 9) AS path, type FROM P_head",
    # version events: a signature per upload
    "V": ("SELECT 'repo-' || substr(event_type, 1, 1) AS repo, 'user-' || user_id AS api, "
          "CASE WHEN value < 20 THEN 'low' WHEN value < 60 THEN 'mid' ELSE 'high' END AS signature, "
          "'c' || event_id AS commit_id, event_id AS pos, ts FROM events"),
    # module graph and its nodes
    "N": ("SELECT 'nation-' || n_nationkey AS id, n_name AS name, 'region-' || n_regionkey AS module, "
          "CASE n_regionkey WHEN 0 THEN 'component' WHEN 1 THEN 'component' WHEN 2 THEN 'datastore' WHEN 3 THEN 'broker' "
          "ELSE 'external_service' END AS type FROM nation"),
    "E": ("SELECT 'nation-' || c_nationkey AS src, 'nation-' || s_nationkey AS dst, "
          "CASE l_returnflag WHEN 'A' THEN 'http' WHEN 'N' THEN 'publishes' ELSE 'calls' END AS kind, "
          "o_orderpriority || '/' || l_linenumber AS detail, o_orderkey * 10 + l_linenumber AS pos "
          "FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey "
          "JOIN supplier ON l_suppkey = s_suppkey"),
    # call graph with cycles: halving edges and an affine edge
    "G": ("SELECT p_partkey AS caller, CAST(floor(p_partkey / 2) AS BIGINT) AS callee FROM part UNION "
          "SELECT p_partkey AS caller, (3 * p_partkey + 1) % (SELECT count(*) FROM part) AS callee FROM part"),
    # the first method of each brand starts every closure
    "SEEDS": "SELECT p_brand AS origin, min(p_partkey) AS node FROM part GROUP BY p_brand",
    "M": ("SELECT p_partkey AS id, p_brand AS file, 10 * p_partkey AS line_start, 10 * p_partkey + p_size AS line_end FROM part"),
    "H": ("SELECT o_orderkey AS hunk, 'Brand#' || (1 + o_custkey % 25) AS file, o_orderkey AS h_start, o_orderkey + 3 AS h_end "
          "FROM orders"),
}


# What both snapshots say of a part, by its lines, by its taxes and by its codes. Lines are read once for each; the relations P, F and S of both
# sides are columns and rows of these: what a side leaves out it leaves out by whole groups, or under a condition inside the aggregate.
_SIDES = {"base": "true", "head": "l_discount < 0.09"}
_OF_LINES = "SELECT l_partkey, l_linenumber, " + ", ".join(
    f"min(CASE WHEN {seen} THEN {TAX} END) AS {side}_tax, bool_and(CASE WHEN {seen} THEN l_returnflag <> 'A' END) AS {side}_required"
    for side, seen in _SIDES.items()) + " FROM lineitem GROUP BY l_partkey, l_linenumber"
_OF_TAXES = f"SELECT l_partkey, {TAX} AS tax, " + ", ".join(
    f"min(CASE WHEN {seen} THEN CASE l_linestatus WHEN 'F' THEN 0 ELSE 1 END END) AS {side}_status, bool_and(CASE WHEN {seen} THEN l_returnflag = 'R' END) AS {side}_required, "
    f"CAST(min(CASE WHEN {seen} THEN l_quantity END) AS INT) AS {side}_min" for side, seen in _SIDES.items()) + f" FROM lineitem GROUP BY l_partkey, {TAX}"
_OF_CODES = (f"SELECT l_partkey, {CODE} AS code, bool_or(l_linestatus = 'F') AS in_base, bool_or(l_linestatus = 'O') AS in_head FROM lineitem "
             f"WHERE l_linestatus IN ('F', 'O') GROUP BY l_partkey, {CODE}")


def side_params(src: Source, side: str) -> DataFrame:
    """P relation of a side."""
    lines = "l_linenumber <> 5" if side == "base" else "l_linenumber NOT IN (3, 6)"
    return src.written(_OF_LINES).where(lines).selectExpr(
        f"{API} AS api", f"{LOC} AS loc", "'p' || l_linenumber AS name", f"'T' || {side}_tax AS type", f"{side}_required AS required")


def side_fields(src: Source, side: str) -> DataFrame:
    """F relation of a side with its rules as a map."""
    gone, pattern = ("4", "6") if side == "base" else ("7", "5")
    return with_rules(src.written(_OF_TAXES).where(f"tax <> {gone}").selectExpr(
        f"{API} AS api", "'f' || tax AS path", f"'S' || {side}_status AS type", f"{side}_required AS required", f"CAST({side}_min AS STRING) AS rule_min",
        f"CASE WHEN tax = {pattern} THEN '[a-z]+' END AS rule_pattern"))


def side_statuses(src: Source, side: str) -> DataFrame:
    """S relation of a side."""
    return src.written(_OF_CODES).where(f"in_{side}").selectExpr(f"{API} AS api", "code")


def side_downstream(src: Source, side: str) -> DataFrame:
    """D relation of a side; numbers are made distinct, and texts of what is left."""
    status = "F" if side == "base" else "O"
    return src.sql(f"SELECT {API} AS api, grp, 'sys-' || l_suppkey AS item FROM (SELECT DISTINCT l_partkey, CASE l_returnflag WHEN 'A' THEN 'databases' WHEN 'N' THEN 'caches' "
                   f"ELSE 'external_apis' END AS grp, l_suppkey FROM lineitem WHERE l_linestatus = '{status}')")


def relation(src: Source, name: str) -> DataFrame:
    return src.sql(with_relations(RELATIONS, f"SELECT * FROM {name}"))


def oracle(body: str) -> str:
    return with_relations(RELATIONS, body)


def fields(src: Source, side: str) -> DataFrame:
    """F relation with its rules as a map."""
    return with_rules(relation(src, f"F_{side}"))


def with_rules(df: DataFrame) -> DataFrame:
    rules = F.map_filter(F.create_map(F.lit("min"), F.col("rule_min"), F.lit("pattern"), F.col("rule_pattern")),
                         lambda k, v: v.isNotNull())
    return df.select("api", "path", "type", "required", rules.alias("rules"))


def access(src: Source, side: str) -> DataFrame:
    df = relation(src, f"A_{side}")
    none = F.lit(None)
    return df.select("*", none.cast("string").alias("access"), none.cast("array<string>").alias("roles"))


def snapshot(src: Source, side: str) -> dict[str, DataFrame]:
    """Everything `compare_snapshots` reads, keyed by `api`. The comparison reads each family once."""
    params = side_params(src, side)
    return {
        "routes": relation(src, f"R_{side}"), "params": params, "request_fields": side_fields(src, side),
        "response_fields": params.selectExpr("api", "'r' || substr(name, 2, 9) AS path", "type"),
        "statuses": side_statuses(src, side), "security": access(src, side), "downstream": side_downstream(src, side),
    }
