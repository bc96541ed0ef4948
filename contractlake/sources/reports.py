"""Scan reports as tables: reading, naming, and one row per route, parameter, status and integration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.core import first_non_empty, non_blank

PARAM = "struct<name:string,type:string,`in`:string,required:boolean,`default`:string,validation:map<string,string>,schema:string>"
STATUS = "struct<code:int,source:string,reason:string,detail:string>"
ROUTE = (
    "struct<doc_name:string,handler:string,function:string,function_name:string,controller:string,module:string,file:string,line:int,"
    "method:string,path:string,context_path:string,summary:string,description:string,deprecated:boolean,"
    f"params:array<{PARAM}>,parameters:array<{PARAM}>,request_body:struct<type:string,schema:string>,"
    "response:struct<type:string,body_type:string,schema:string>,"
    f"errors:array<string>,status_codes:array<{STATUS}>,"
    "security:struct<annotations:array<struct<annotation:string,expression:string,level:string>>,url_rule:struct<patterns:array<string>,access:string,roles:array<string>>>,"
    "integrations:string,calls:array<string>,referenced_types:array<string>,change_reasons:array<string>>"
)
REPORT = (
    "scanner_version string, project string, repository string, commit string, branch string, scan_mode string, framework string, "
    f"frameworks array<string>, dirty boolean, scanned_at string, routes array<{ROUTE}>, architecture string"
)


def parse_reports(df: DataFrame, column: str = "report") -> DataFrame:
    """Adds the parsed report `r` and `is_report`: an object that has a routes field."""
    parsed = F.from_json(column, REPORT, {"mode": "PERMISSIVE"})
    return df.withColumn("r", parsed).withColumn("is_report", F.coalesce(F.col("r.routes").isNotNull(), F.lit(False)))


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """Report files of a folder: file, report text, parsed `r`, `is_report`. Bad files stay as error rows."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("report"))
    return parse_reports(files)


def repository_name(project: Column, repository: Column, default: str = "default") -> Column:
    """Project when the report has one, else the repository; blank means the default."""
    named = F.when(project.isNotNull(), non_blank(project)).otherwise(non_blank(repository))
    return F.coalesce(named, F.lit(default))


def scan_label(commit: Column, scanned_at: Column) -> Column:
    """Commit, else a local stamp of the scan time."""
    return F.coalesce(non_blank(commit), F.concat(F.lit("local-"), F.date_format(scanned_at, "yyyyMMdd-HHmmss")))


def report_repository(project: Column, remote: Column, folder: Column) -> Column:
    """Name a scanned folder gets: the given project, else the name of its remote, else the folder."""
    return F.coalesce(non_blank(project), non_blank(remote), folder)


def routes_of(reports: DataFrame, keys: Sequence[str] = ("repo", "commit")) -> DataFrame:
    """One row per route with its position; older field names are merged into the new ones."""
    rows = reports.select(*keys, F.posexplode("r.routes").alias("pos", "t"))
    params = F.when(F.size("parameters") > 0, F.col("parameters")).otherwise(F.coalesce("params", F.array().cast(f"array<{PARAM}>")))
    merged = rows.select(*keys, "pos", "t.*").withColumn("params", params).drop("parameters")
    return merged.withColumn("api", route_key(merged)).withColumn("function", first_non_empty("function_name", "function")).drop("function_name")


def route_key(routes: DataFrame) -> Column:
    """Stable endpoint name: doc name, handler, function, else `METHOD path`."""
    have = [c for c in ("doc_name", "handler", "function") if c in routes.columns]
    return first_non_empty(*have, F.concat(F.coalesce("method", F.lit("None")), F.lit(" "), F.coalesce("path", F.lit("None"))))


def last_routes(routes: DataFrame, keys: Sequence[str] = ("repo", "commit")) -> DataFrame:
    """Of routes with the same endpoint name in one report the last one stays."""
    top = routes.groupBy(*keys, "api").agg(F.max("pos").alias("pos"))
    return routes.join(top, [*keys, "api", "pos"], "left_semi")


def snapshot_tables(routes: DataFrame, keys: Sequence[str] = ("repo", "commit")) -> dict[str, DataFrame]:
    """The tables `compare_snapshots` reads, exploded from route rows without any shuffle."""
    from ..operators.normalize import downstream_entries, flatten_schema, response_fields
    k = [*keys, "api"]
    return {
        "routes": routes.select(*k, "method", "path", F.col("request_body.type").alias("body_type"), F.col("response.body_type").alias("response_type")),
        "params": routes.select(*k, F.posexplode("params").alias("pos", "p")).select(
            *k, "pos", F.col("p.in").alias("loc"), "p.name", "p.type", "p.required"),
        "request_fields": flatten_schema(routes.withColumn("_s", F.col("request_body.schema")), k, "_s"),
        "response_fields": response_fields(routes.withColumn("_s", F.col("response.schema")), k, "_s"),
        "statuses": routes.select(*k, F.explode("status_codes.code").alias("code")).distinct(),
        "security": routes.where("security IS NOT NULL").select(
            *k, F.explode_outer("security.annotations").alias("a"), F.col("security.url_rule.access").alias("access"), F.col("security.url_rule.roles").alias("roles"))
        .select(*k, "a.annotation", "a.expression", "access", "roles"),
        "downstream": downstream_entries(routes, k).select(*k, "grp", "item"),
    }
