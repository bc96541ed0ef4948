"""Test coverage scores, execution checklists and test templates per API."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import any_of, keep_first_per_key

# Categories with the test count that scores 100 and the weight in the total.
CATEGORIES = (
    ("happy_path", 3, 0.2),
    ("error_cases", 5, 0.3),
    ("security_tests", 4, 0.25),
    ("edge_cases", 4, 0.15),
    ("performance_tests", 2, 0.1),
)

# The plan of an API without generated cases.
TEMPLATE_CASES = {
    "happy_path": (
        "Create valid request with all required parameters",
        "Verify successful response with correct status code (200/201)",
        "Validate all response fields are present",
        "Confirm data persisted in database",
    ),
    "edge_cases": (
        "Submit request with null/empty optional fields",
        "Test with boundary values (min/max lengths)",
        "Concurrent requests to same resource",
        "Large payload handling",
    ),
    "error_cases": (
        "Missing required field → 400 Bad Request",
        "Invalid data type → 400 Bad Request",
        "Invalid authentication token → 401 Unauthorized",
        "Resource not found → 404 Not Found",
        "Duplicate entry attempt → 409 Conflict",
        "Server error handling → 500 Internal Server Error",
    ),
    "security_tests": (
        "SQL injection in string parameters",
        "XSS attack in text fields",
        "Missing authentication on protected endpoint",
        "Authorization bypass attempt",
        "Rate limiting enforcement",
    ),
    "performance_tests": (
        "Response time < 500ms under normal load",
        "Handle 100+ concurrent requests",
        "Memory usage stable over time",
        "Database query optimization",
    ),
}

# Predefined templates by name, with category and cases.
PREDEFINED_TEMPLATES = {
    "Happy Path - REST Standard": ("happy_path", (
        "Create valid resource with all required fields",
        "Verify successful response with correct status code (200/201)",
        "Validate response contains all expected fields",
        "Confirm resource is persisted correctly",
        "Update existing resource successfully",
        "Delete resource and verify removal")),
    "Happy Path - Data Flow": ("happy_path", (
        "Input valid data through entire pipeline",
        "Verify data transformation at each step",
        "Confirm output matches expected format",
        "Validate all side effects are applied")),
    "HTTP Error Codes": ("error_cases", (
        "Missing required field → 400 Bad Request",
        "Invalid data type → 400 Bad Request",
        "Missing authentication → 401 Unauthorized",
        "Insufficient permissions → 403 Forbidden",
        "Resource not found → 404 Not Found",
        "Duplicate entry → 409 Conflict",
        "Rate limit exceeded → 429 Too Many Requests",
        "Server error → 500 Internal Server Error")),
    "Business Logic Errors": ("error_cases", (
        "Invalid state transition attempt",
        "Business rule violation",
        "Insufficient inventory/resources",
        "Transaction failure handling")),
    "OWASP Top 10": ("security_tests", (
        "SQL injection in string parameters",
        "XSS attack in text/HTML fields",
        "Path traversal in file operations",
        "CSRF token validation",
        "Broken authentication check",
        "Sensitive data exposure",
        "XML External Entity (XXE) injection",
        "Broken access control")),
    "Authentication & Authorization": ("security_tests", (
        "Endpoint accessible without token",
        "Using expired token",
        "Using token from different user",
        "Privilege escalation attempt",
        "Token refresh flow security")),
    "Load Testing Basics": ("performance_tests", (
        "Response time < 500ms under normal load",
        "Response time < 2s under peak load",
        "Handle 100+ concurrent requests",
        "Handle 1000+ concurrent requests",
        "Memory usage remains stable")),
    "Stress Testing": ("performance_tests", (
        "System stability under extreme load",
        "Graceful degradation when overloaded",
        "Recovery after high load subsides",
        "No memory leaks after sustained load")),
    "Boundary Value Testing": ("edge_cases", (
        "Empty string input",
        "Null/None values",
        "Maximum length input",
        "Minimum length input",
        "Negative numbers where applicable",
        "Zero values",
        "Special characters and Unicode")),
    "Concurrency Testing": ("edge_cases", (
        "Simultaneous updates to same resource",
        "Concurrent deletions",
        "Race condition in state transitions",
        "Deadlock prevention")),
}

# Templates everybody gets, and those an API name asks for.
ALWAYS_RECOMMENDED = ("Happy Path - REST Standard", "HTTP Error Codes", "OWASP Top 10")
RECOMMENDED_BY_NAME = (
    (("user", "auth", "login", "account", "profile"), "Authentication & Authorization"),
    (("payment", "order", "transaction", "billing"), "Load Testing Basics"),
    (("search", "query", "filter", "list"), "Boundary Value Testing"),
)


def case_counts(cases: DataFrame, keys: Sequence[str], category: str = "category") -> DataFrame:
    """Test cases per API and category as columns; a fixed pivot with map-side combine."""
    return cases.groupBy(*keys).agg(*[F.count_if(F.col(category) == name).alias(name) for name, _, _ in CATEGORIES])


def _score(name: str, target: int) -> Column:
    return F.least(F.lit(100.0), F.col(name) / F.lit(target) * 100)


def qa_coverage(counts: DataFrame) -> DataFrame:
    """Scores per category, weighted total and advice from category counts."""
    n = lambda c: F.col(c).cast("string")
    total = sum((F.col(name) for name, _, _ in CATEGORIES[1:]), F.col(CATEGORIES[0][0]))
    overall = sum((_score(name, target) * weight for name, target, weight in CATEGORIES[1:]),
                  _score(CATEGORIES[0][0], CATEGORIES[0][1]) * CATEGORIES[0][2])
    advice = F.filter(F.array(
        F.when(F.col("error_cases") < 4, F.concat(F.lit("⚠️ Add more error case tests ("), n("error_cases"), F.lit("/5 minimum)"))),
        F.when(F.col("security_tests") < 3, F.concat(F.lit("⚠️ Add more security tests ("), n("security_tests"), F.lit("/4 recommended)"))),
        F.when(F.col("edge_cases") < 3, F.concat(F.lit("⚠️ Add more edge case tests ("), n("edge_cases"), F.lit("/4 recommended)"))),
        F.when(F.col("performance_tests") == 0, F.lit("⚠️ Add performance/load testing scenarios")),
    ), lambda a: a.isNotNull())
    fine = F.array(F.lit("✅ Comprehensive test coverage - ready for QA execution"))
    out = counts.withColumn("total_test_count", total)
    for name, target, _ in CATEGORIES:
        out = out.withColumn(f"{name}_score", F.round(_score(name, target), 1))
    return (out.withColumn("overall_score", F.round(overall, 1))
            .withColumn("recommendations", F.when(F.size(advice) > 0, advice).otherwise(fine)))


def qa_checklist(counts: DataFrame) -> DataFrame:
    """Checklist lines (category: item) and the testing hours, from category counts."""
    n = lambda c: F.col(c).cast("string")
    core, sec, perf, reg, sign = ("Core Functionality: ☐ ", "Security Testing: ☐ ", "Performance Testing: ☐ ",
                                  "Regression Testing (Breaking Changes): ☐ ", "Sign-Off: ☐ ")
    broken = F.col("breaking_changes") if "breaking_changes" in counts.columns else F.lit(0)
    lines = F.array(
        F.concat(F.lit(core + "Run "), n("happy_path"), F.lit(" happy path tests - all must pass")),
        F.concat(F.lit(core + "Run "), n("error_cases"), F.lit(" error handling tests - all must pass")),
        F.lit(core + "Verify response format matches documentation"),
        F.when(F.col("security_tests") > 0, F.concat(F.lit(sec + "Run "), n("security_tests"), F.lit(" security tests - all must pass"))),
        F.when(F.col("security_tests") > 0, F.lit(sec + "Security review: No new vulnerabilities")),
        F.when(F.col("security_tests") > 0, F.lit(sec + "Verify authentication/authorization enforced")),
        F.when(F.col("performance_tests") > 0, F.concat(F.lit(perf + "Run "), n("performance_tests"), F.lit(" performance tests"))),
        F.when(F.col("performance_tests") > 0, F.lit(perf + "No regression > 10% from baseline")),
        F.when(F.col("performance_tests") > 0, F.lit(perf + "Load test passed (100+ concurrent)")),
        F.when(broken > 0, F.concat(F.lit(reg), broken.cast("string"), F.lit(" breaking changes identified"))),
        F.when(broken > 0, F.lit(reg + "Backward compatibility tests passed")),
        F.when(broken > 0, F.lit(reg + "Migration guide reviewed with stakeholders")),
        F.when(broken > 0, F.lit(reg + "Dependent services identified and tested")),
        F.lit(sign + "All test categories passed"),
        F.lit(sign + "No critical/high severity bugs open"),
        F.lit(sign + "Documentation updated"),
        F.lit(sign + "QA lead approval"),
        F.lit(sign + "Ready for production deployment"),
    )
    scenarios = F.col("happy_path") + F.col("error_cases")
    return (counts.withColumn("total_test_scenarios", scenarios)
            .withColumn("checklist", F.filter(lines, lambda x: x.isNotNull()))
            .withColumn("estimated_testing_hours", F.greatest(F.lit(2.0), scenarios / 10)))


def template_plan(apis: DataFrame, cases: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The constant plan, as one row per case, for every API that has no cases of its own."""
    fixed = F.array(*[F.struct(F.lit(category).alias("category"), F.lit(i).alias("pos"), F.lit(text).alias("test_case"))
                      for category, texts in TEMPLATE_CASES.items() for i, text in enumerate(texts, start=1)])
    bare = apis.select(*keys).distinct().join(cases.select(*keys), list(keys), "left_anti")
    return bare.select(*keys, F.explode(fixed).alias("c")).select(*keys, "c.*")


def recommend_templates(apis: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Names of the templates that fit an API name, in order."""
    lower = F.lower(F.col(name))
    picks = [F.lit(t) for t in ALWAYS_RECOMMENDED] + [F.when(any_of(lower, words), F.lit(t)) for words, t in RECOMMENDED_BY_NAME]
    return (apis.select(*keys, F.posexplode(F.filter(F.array(*picks), lambda t: t.isNotNull())).alias("pos", "template")))


def template_key(name: Column) -> Column:
    return F.translate(F.lower(F.regexp_replace(name, r"^\s+|\s+$", "")), " -", "__")


def list_templates(templates: DataFrame, category: str | None = None) -> DataFrame:
    """Templates by normalised key (the newest of a key stays), newest first, with their case count."""
    keyed = templates.withColumn("key", template_key(F.col("name")))
    latest = keep_first_per_key(keyed, ["repo", "key"], ["created_at"], last=True)
    if category is not None:
        latest = latest.where(F.col("category") == category)
    return latest.withColumn("test_count", F.coalesce(F.size("test_cases"), F.lit(0))).orderBy(F.col("created_at").desc())


def apply_templates(cases: DataFrame, templates: DataFrame, selected: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Cases of the selected templates appended behind the generated ones, in selection order.

    Rows carry (source, pos), so the final order needs no per-category collection.
    """
    order = F.array_position(F.array(*[F.lit(s) for s in selected]), F.col("name"))
    chosen = templates.where(F.col("name").isin(*selected)).select(
        *keys, F.coalesce("category", F.lit("custom")).alias("category"), order.cast("int").alias("source"),
        F.posexplode("test_cases").alias("pos", "test_case"))
    own = cases.select(*keys, "category", F.lit(0).alias("source"), "pos", "test_case")
    return own.unionByName(chosen)
