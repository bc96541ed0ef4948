"""Source trees as rows: file selection, framework detection, diffs and imported documentation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.core import any_of, non_empty

# Folders that hold no sources of the project, and test source sets.
SKIP_DIRS = (
    ".git", ".hg", ".svn",
    "venv", ".venv", "env", ".env", "site-packages", "__pycache__",
    ".tox", ".nox", ".mypy_cache", ".pytest_cache",
    "node_modules", "target", "build", "dist", ".gradle", ".mvn", ".idea",
)
TEST_SOURCES = ("test", "it", "integrationTest", "testFixtures")
BUILD_FILES = ("pom.xml", "build.gradle", "build.gradle.kts")

# Fixed values: (framework, file extension, case-insensitive, markers) of a framework's sources.
FRAMEWORK_MARKERS = (
    ("spring", ".java", False, ("@RestController", "@Controller", "@RequestMapping", "@GetMapping", "@PostMapping")),
    ("fastapi", ".py", True, ("fastapi",)),
)


def read_tree(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files below a folder with their content; size guards are filters on `length` before the content is used."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
            .select("path", "length", F.decode("content", "UTF-8").alias("content")))


def in_skipped_dir(path: Column) -> Column:
    parts = F.split(path, "/")
    dirs = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.arrays_overlap(dirs, F.array(*[F.lit(d) for d in SKIP_DIRS]))


def is_test_source(path: Column) -> Column:
    """A `src` folder directly followed by one of the test source sets."""
    return path.rlike("(^|/)src/(" + "|".join(TEST_SOURCES) + ")(/|$)")


def source_files(files: DataFrame, extension: str, path: str = "path", tests: bool = False) -> DataFrame:
    """Files of an extension outside skipped folders and (unless asked for) test sources."""
    kept = files.where(F.col(path).endswith(extension) & ~in_skipped_dir(F.col(path)))
    return kept if tests else kept.where(~is_test_source(F.col(path)))


def detect_frameworks(files: DataFrame, keys: Sequence[str] = ("repo",), markers=FRAMEWORK_MARKERS) -> DataFrame:
    """(keys, framework) found in any source file; a distinct of flags, the contents are never shuffled."""
    content = F.col("content")
    hits = []
    for framework, extension, fold, words in markers:
        text = F.lower(content) if fold else content
        hits.append(F.when(F.col("path").endswith(extension) & any_of(text, words), F.lit(framework)))
    kept = files.where(~in_skipped_dir(F.col("path")))
    return kept.select(*keys, F.explode(F.filter(F.array(*hits), lambda h: h.isNotNull())).alias("framework")).distinct()


def changed_files(committed: DataFrame, working: DataFrame, tracked: DataFrame, has_parent: DataFrame, extensions: Sequence[str],
                  keys: Sequence[str] = ("repo",)) -> DataFrame:
    """Distinct changed files of the wanted extensions; every tracked file where there is no parent commit."""
    wanted = F.lit(False)
    for e in extensions:
        wanted = wanted | F.col("file").endswith(e)
    # repositories may be many: with the hint their list is not sent to every task
    parents = has_parent.select(*keys).hint("merge")
    changed = committed.select(*keys, "file").unionByName(working.select(*keys, "file")).join(parents, list(keys), "left_semi")
    whole = tracked.select(*keys, "file").join(parents, list(keys), "left_anti")
    return changed.unionByName(whole).where(wanted).distinct()


def parse_diff_hunks(diffs: DataFrame, keys: Sequence[str], text: str = "diff") -> DataFrame:
    """(keys, file, h_start, h_end) from unified diff texts, row by row: no ordering step and no shuffle.

    A text is cut at its `+++ ` lines; the part after each names the file and holds its hunks. A
    missing length means one line, removed files (/dev/null) give nothing.
    """
    sections = F.split(F.concat(F.lit("\n"), F.col(text)), r"\r?\n\+\+\+ ")
    rows = diffs.select(*keys, F.explode(F.slice(sections, 2, F.size(sections))).alias("s"))
    name = F.regexp_replace(F.regexp_extract("s", r"^([^\r\n]*)", 1), r"\s+$", "")
    files = rows.withColumn("file", name).where(F.col("file").startswith("b/")).withColumn("file", F.substr(F.col("file"), F.lit(3)))
    hunk = r"(?m)^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@"
    zipped = F.arrays_zip(F.regexp_extract_all("s", F.lit(hunk), F.lit(1)).alias("a"), F.regexp_extract_all("s", F.lit(hunk), F.lit(2)).alias("n"))
    hunks = files.select(*keys, "file", F.explode(zipped).alias("h"))
    start = F.col("h.a").cast("long")
    count = F.coalesce(non_empty("h.n").cast("long"), F.lit(1))
    return hunks.select(*keys, "file", start.alias("h_start"), (start + F.greatest(count, F.lit(1)) - 1).alias("h_end"))


def find_modules(files: DataFrame, path: str = "path", keys: Sequence[str] = ()) -> DataFrame:
    """Distinct folders ('' is the root) that hold a build file and do not lie below `src` or a skipped folder."""
    name = F.substring_index(path, "/", -1)
    folder = F.when(F.col(path).contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")
    kept = files.where(name.isin(*BUILD_FILES) & ~in_skipped_dir(F.col(path)) & ~F.col(path).rlike("(^|/)src/"))
    return kept.select(*keys, folder.alias("dir")).distinct()


# ---------------------------------------------------------------- names and imported trees

def safe_name(name: Column) -> Column:
    """Usable as a path part: 1 to 200 characters, not . or .., no separators."""
    ok = (F.length(name) > 0) & (F.length(name) <= 200) & ~name.isin(".", "..") & ~name.contains("/") & ~name.contains("\\")
    return F.coalesce(ok, F.lit(False))


DOC_PATH = r"(?:^|/)([^/]+)/([^/]+)/v(\d+)\.md$"


def import_doc_tree(files: DataFrame, existing: DataFrame, metadata: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new version rows, counts) of a `<repo>/<api>/v<N>.md` tree; stored versions are kept.

    files(path, content), existing(repo, api, version), metadata(repo, api, version, signature, commit_id, title).
    """
    key = ["repo", "api", "version"]
    parsed = files.where(F.col("path").rlike(DOC_PATH)).select(
        F.regexp_extract("path", DOC_PATH, 1).alias("repo"), F.regexp_extract("path", DOC_PATH, 2).alias("api"),
        F.regexp_extract("path", DOC_PATH, 3).cast("long").alias("version"), "content").where(safe_name(F.col("repo")) & ~F.col("repo").startswith(".") & ~F.col("api").startswith("."))
    new = parsed.join(existing.select(*key), key, "left_anti").join(metadata, key, "left").withColumn(
        "signature", F.coalesce(non_empty("signature"), F.concat(F.lit("imported-v"), "version")))
    stored = existing.select(*key, F.lit(True).alias("_stored")).dropDuplicates(key)
    counts = parsed.select(*key).join(stored, key, "left").groupBy(F.when(F.col("_stored"), "skipped").otherwise("versions").alias("kind")).agg(F.count("*").alias("n"))
    return new, counts
