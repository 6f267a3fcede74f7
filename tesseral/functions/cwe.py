"""Weakness ids, languages, severities and the dimension tables about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import col

# The weaknesses' descriptions, parents, and yearly score medians.
DESCRIPTIONS = {
    "CWE-787": "out-of-bounds write", "CWE-119": "memory boundary error", "CWE-125": "out-of-bounds read", "CWE-416": "use after free", "CWE-476": "NULL pointer dereference",
    "CWE-190": "integer overflow", "CWE-20": "improper input validation", "CWE-89": "SQL injection", "CWE-78": "OS command injection", "CWE-79": "cross-site scripting",
    "CWE-94": "code injection", "CWE-327": "broken or risky cryptographic algorithm", "CWE-328": "weak hash", "CWE-326": "inadequate cryptographic strength", "CWE-798": "use of hard-coded credentials",
    "CWE-502": "deserialization of untrusted data", "CWE-22": "path traversal", "CWE-306": "missing authentication for critical function", "CWE-862": "missing authorization",
}
PARENTS = {
    "CWE-787": "CWE-119", "CWE-125": "CWE-119", "CWE-416": "CWE-119", "CWE-476": "CWE-119", "CWE-119": "CWE-118", "CWE-190": "CWE-682", "CWE-20": "CWE-707",
    "CWE-78": "CWE-77", "CWE-77": "CWE-74", "CWE-79": "CWE-74", "CWE-89": "CWE-74", "CWE-94": "CWE-74", "CWE-74": "CWE-707", "CWE-22": "CWE-706", "CWE-326": "CWE-693",
    "CWE-327": "CWE-693", "CWE-328": "CWE-327", "CWE-502": "CWE-915", "CWE-798": "CWE-1391", "CWE-306": "CWE-287", "CWE-862": "CWE-284",
}
MEDIANS = {
    "CWE-787": 7.8, "CWE-119": 8.2, "CWE-125": 6.8, "CWE-416": 7.8, "CWE-476": 5.5, "CWE-190": 7.5, "CWE-20": 7.5, "CWE-89": 7.3, "CWE-78": 8.8, "CWE-79": 5.9,
    "CWE-94": 7.5, "CWE-327": 6.5, "CWE-328": 3.65, "CWE-326": 6.5, "CWE-798": 8.1, "CWE-502": 8.5, "CWE-22": 7.5, "CWE-306": 7.5, "CWE-862": 5.5,
}
# Language aliases.
LANGUAGES = {"python": "python", "py": "python", "python3": "python", "c": "c", "cpp": "cpp", "c++": "cpp", "cxx": "cpp"}
TRILINGUAL = ("CWE-22", "CWE-78", "CWE-20")
C_FAMILY = ("CWE-787", "CWE-119", "CWE-125", "CWE-416", "CWE-476", "CWE-190")
PYTHON_ONLY = ("CWE-89", "CWE-79", "CWE-94", "CWE-502")
FLOORS = {"critical": 0.6, "high": 0.5, "medium": 0.4, "low": 0.3}
MIDPOINTS = {"critical": 9.5, "high": 7.95, "medium": 5.45, "low": 2.0}


def mapping(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def normalize_cwe(raw) -> Column:
    """CWE-n from the common spellings, leading zeros kept; null where it cannot be read."""
    s = F.trim(col(raw).cast("string"))
    return F.when(s.rlike(r"^CWE-[0-9]+$"), s).when(s.rlike(r"^(?i)CWE-[0-9]+$"), F.concat(F.lit("CWE-"), F.regexp_extract(s, "([0-9]+)$", 1))).when(s.rlike("^[0-9]+$"), F.concat(F.lit("CWE-"), s))


def strict_cwe(raw) -> Column:
    return F.coalesce(normalize_cwe(raw), F.raise_error(F.concat(F.lit("not a weakness id: "), col(raw).cast("string"))))


def coerce_cwe(raw) -> Column:
    """Digits behind any run of the letters and signs that prefix them."""
    digits = F.regexp_replace(F.upper(F.trim(col(raw).cast("string"))), "^[CWE_-]+", "")
    return F.when(digits.rlike("^[0-9]+$"), F.concat(F.lit("CWE-"), digits))


def normalize_language(raw) -> Column:
    return F.element_at(mapping(LANGUAGES), F.lower(F.trim(col(raw).cast("string"))))


def short_description(cwe) -> Column:
    return F.coalesce(F.element_at(mapping(DESCRIPTIONS), col(cwe)), F.lit("vulnerability"))


def tier(severity) -> Column:
    """Bands of a 0 to 10 score; medium where it is unknown."""
    s = col(severity)
    return F.when(s >= 9, "critical").when(s >= 7, "high").when(s >= 4, "medium").when(s.isNotNull(), "low").otherwise("medium")


def severity_bin(median) -> Column:
    m = col(median)
    return F.when(m >= 7, "high").when(m >= 4, "medium").when(m.isNotNull(), "low")


def coerce_confidence(raw, default: float = 0.5) -> Column:
    """A level's name, a share, a percentage or a truth value, each a VARIANT, as a number from 0 to 1.

    A text that is no level's name says nothing, even if it holds digits.
    """
    v = col(raw)
    kind = F.schema_of_variant(v)
    s, n = F.lower(F.try_variant_get(v, "$", "string")), F.try_variant_get(v, "$", "double")
    named = F.when(s == "error", 0.8).when(s == "warning", 0.5).when(s == "note", 0.3)
    number = F.when(n.between(0, 1), n).when(n.between(1, 100), n / 100).when(n > 100, 1.0).when(n < 0, 0.0)
    return F.coalesce(F.when(kind == "STRING", named).when(~kind.isin("VOID") & ~kind.startswith("OBJECT") & ~kind.startswith("ARRAY"), number), F.lit(default))


def parents_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(PARENTS.items()), "child string, parent string")


def medians_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(MEDIANS.items()), "cwe string, median double")


def closure(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(descendant, ancestor, depth): the least number of steps. No shortest way is longer than there are children, which ends cycles too.

    A hierarchy deeper than spark.sql.cteRecursionLevelLimit is an error, not a shorter result.
    """
    edges.createOrReplaceTempView("_closure_edges")
    children = edges.select("child").distinct().count()
    return spark.sql(
        f"""WITH RECURSIVE up(descendant, ancestor, depth) AS (
             SELECT child, parent, 1 FROM _closure_edges
             UNION ALL
             SELECT up.descendant, e.parent, up.depth + 1 FROM up JOIN _closure_edges e ON e.child = up.ancestor WHERE up.depth < {children})
           SELECT descendant, ancestor, min(depth) AS depth FROM up WHERE descendant <> ancestor GROUP BY descendant, ancestor"""
    )


def languages_in_scope(cwe) -> Column:
    c = col(cwe)
    return F.when(c.isin(*TRILINGUAL), F.array(F.lit("python"), F.lit("c"), F.lit("cpp"))).when(c.isin(*C_FAMILY), F.array(F.lit("c"), F.lit("cpp"))).when(c.isin(*PYTHON_ONLY, "CWE-306"), F.array(F.lit("python"))).when(c == "CWE-862", F.array(F.lit("python"), F.lit("c"))).otherwise(F.array().cast("array<string>"))
