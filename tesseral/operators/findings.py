"""Findings: reading SARIF, resolving weaknesses, merging over tools, severities, collapsing related ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cwe

BOOST, MAX_CONFIDENCE = 0.15, 1.0

_LOCATION = "physicalLocation STRUCT<artifactLocation: STRUCT<uri: STRING>, region: STRUCT<startLine: INT, startColumn: INT, endLine: INT, endColumn: INT>>"
_PROPERTIES = "properties: STRUCT<tags: ARRAY<STRING>, cwe: STRING, confidence: VARIANT, `security-severity`: STRING>"
_RULE = f"STRUCT<id: STRING, relationships: ARRAY<STRUCT<target: STRUCT<id: STRING, toolComponent: STRUCT<name: STRING>>>>, {_PROPERTIES}>"
SARIF = f"runs ARRAY<STRUCT<tool: STRUCT<driver: STRUCT<name: STRING, rules: ARRAY<{_RULE}>>>, results: ARRAY<STRUCT<ruleId: STRING, rule: STRUCT<id: STRING>, level: VARIANT, message: VARIANT, {_PROPERTIES}, locations: ARRAY<STRUCT<{_LOCATION.replace('physicalLocation ', 'physicalLocation: ')}>>>>>>"

# Rules of two tools that name no weakness, and the weakness that their documentation cites.
BANDIT = {
    "B101": "CWE-703", "B102": "CWE-78", "B103": "CWE-732", "B104": "CWE-605", "B105": "CWE-259", "B106": "CWE-259", "B107": "CWE-259", "B108": "CWE-377", "B110": "CWE-703", "B112": "CWE-703",
    "B201": "CWE-94", "B202": "CWE-22", "B301": "CWE-502", "B302": "CWE-502", "B303": "CWE-327", "B304": "CWE-327", "B305": "CWE-327", "B306": "CWE-377", "B307": "CWE-78", "B308": "CWE-79",
    "B309": "CWE-295", "B310": "CWE-22", "B311": "CWE-330", "B312": "CWE-319", "B313": "CWE-20", "B314": "CWE-20", "B315": "CWE-20", "B316": "CWE-20", "B317": "CWE-20", "B318": "CWE-20",
    "B319": "CWE-20", "B320": "CWE-20", "B321": "CWE-319", "B322": "CWE-20", "B323": "CWE-295", "B324": "CWE-327", "B325": "CWE-377", "B401": "CWE-319", "B402": "CWE-319", "B403": "CWE-502",
    "B404": "CWE-78", "B405": "CWE-20", "B406": "CWE-20", "B407": "CWE-20", "B408": "CWE-20", "B409": "CWE-20", "B410": "CWE-20", "B411": "CWE-319", "B412": "CWE-319", "B413": "CWE-327",
    "B414": "CWE-327", "B501": "CWE-295", "B502": "CWE-327", "B503": "CWE-327", "B504": "CWE-327", "B505": "CWE-326", "B506": "CWE-20", "B507": "CWE-295", "B508": "CWE-319", "B509": "CWE-327",
    "B601": "CWE-78", "B602": "CWE-78", "B603": "CWE-78", "B604": "CWE-78", "B605": "CWE-78", "B606": "CWE-78", "B607": "CWE-78", "B608": "CWE-89", "B609": "CWE-78", "B610": "CWE-89",
    "B611": "CWE-89", "B612": "CWE-20", "B701": "CWE-79", "B702": "CWE-79", "B703": "CWE-79", "B704": "CWE-79",
}
CPPCHECK = {
    "arrayIndexOutOfBounds": "CWE-119", "arrayIndexOutOfBoundsCond": "CWE-119", "bufferAccessOutOfBounds": "CWE-119", "negativeIndex": "CWE-786", "negativeMemoryAllocationSize": "CWE-131",
    "objectIndex": "CWE-758", "outOfBounds": "CWE-788", "pointerOutOfBounds": "CWE-823", "pointerOutOfBoundsCond": "CWE-823", "stringIndexOutOfBounds": "CWE-119", "memleak": "CWE-401",
    "memleakOnRealloc": "CWE-401", "resourceLeak": "CWE-775", "doubleFree": "CWE-415", "deallocuse": "CWE-416", "uninitvar": "CWE-457", "uninitdata": "CWE-457", "uninitMemberVar": "CWE-908",
    "uninitstring": "CWE-457", "uninitStructMember": "CWE-457", "mismatchAllocDealloc": "CWE-762", "leakReturnValNotUsed": "CWE-771", "nullPointer": "CWE-476", "nullPointerArithmetic": "CWE-682",
    "nullPointerDefaultArg": "CWE-476", "nullPointerRedundantCheck": "CWE-476", "integerOverflow": "CWE-190", "signConversion": "CWE-195", "shiftNegative": "CWE-758", "shiftNegativeLHS": "CWE-758",
    "shiftTooManyBits": "CWE-758", "shiftTooManyBitsSigned": "CWE-758", "zerodiv": "CWE-369", "zerodivcond": "CWE-369", "invalidPrintfArgType_s": "CWE-686", "invalidPrintfArgType_int": "CWE-686",
    "invalidPrintfArgType_uint": "CWE-686", "invalidPrintfArgType_sint": "CWE-686", "invalidPrintfArgType_float": "CWE-686", "invalidScanfArgType_int": "CWE-686", "invalidScanfArgType_s": "CWE-686",
    "invalidScanfArgType_float": "CWE-686", "wrongPrintfScanfArgNum": "CWE-685", "wrongPrintfScanfParameterPositionError": "CWE-685", "scanfFormatStringWidth": "CWE-687",
    "IOWithoutPositioning": "CWE-664", "useClosedFile": "CWE-910", "writeReadOnlyFile": "CWE-664", "bufferAccessOutOfBoundsCond": "CWE-119", "danglingTemporaryLifetime": "CWE-562",
    "danglingLifetime": "CWE-562", "danglingReference": "CWE-562", "deallocret": "CWE-672", "deallocuseuninit": "CWE-457", "sprintfOverlappingData": "CWE-628", "unsafeClassDivZero": "CWE-369",
    "virtualCallInConstructor": "CWE-1037", "pureVirtualCall": "CWE-664", "duplInheritedMember": "CWE-694", "noConstructor": "CWE-665", "noExplicitConstructor": "CWE-665", "uninitMember": "CWE-908",
    "invalidPointerCast": "CWE-704", "invalidFunctionArg": "CWE-628", "invalidFunctionArgBool": "CWE-628", "invalidFunctionArgStr": "CWE-628", "uselessAssignmentArg": "CWE-563",
    "uselessAssignmentPtrArg": "CWE-563", "unreadVariable": "CWE-563", "syntaxError": "CWE-758",
}


def _id(text: Column, pattern: str = r"(?i)cwe-0*([0-9]+)") -> Column:
    n = F.regexp_extract(text, pattern, 1)
    return F.when(n != "", F.concat(F.lit("CWE-"), n))


def _taxon(target: Column) -> Column:
    """The weakness that a relation's target names: digits, with or without the prefix; another id with the prefix as it is."""
    own = F.upper(F.trim(target["id"]))
    named = F.coalesce(_id(own, r"^(?:CWE-)?0*([0-9]+)$"), F.when(own.startswith("CWE-"), own))
    return F.when(F.upper(target["toolComponent"]["name"]) == "CWE", named)


def resolve_cwe(tool: Column, rule_id: Column, rule: Column) -> Column:
    """From the rule's relations, then its tags, its property, the tool's table, and its own name."""
    taxa = F.filter(F.transform(rule["relationships"], lambda r: _taxon(r["target"])), lambda x: x.isNotNull())
    tags = F.filter(F.transform(rule["properties"]["tags"], lambda t: _id(t)), lambda x: x.isNotNull())
    own = F.when(F.lower(tool) == "bandit", F.element_at(cwe.mapping(BANDIT), rule_id)).when(F.lower(tool) == "cppcheck", F.element_at(cwe.mapping(CPPCHECK), rule_id))
    return F.coalesce(F.try_element_at(taxa, F.lit(1)), F.try_element_at(tags, F.lit(1)), _id(rule["properties"]["cwe"]), _id(rule["properties"]["cwe"], r"^\s*0*([0-9]+)\s*$"), own, _id(rule_id))


def parse_sarif(documents: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """One row per usable result: id, tool, rule_id, cwe, severity, tier, confidence, file, the region's bounds, message.

    The rule is named by ruleId or by rule.id; of rules with one id the last counts. A message is a text or an object with
    one. Results without a weakness or a place, or with a confidence below their tier's floor, are left out.
    """
    runs = documents.select(id_col, F.explode(F.from_json(json_col, SARIF)["runs"]).alias("run"))
    rows = runs.select(id_col, F.col("run.tool.driver.name").alias("tool"), F.col("run.tool.driver.rules").alias("rules"), F.explode("run.results").alias("r"))
    rows = rows.withColumn("rule_id", F.coalesce(F.when(F.col("r.ruleId") != "", F.col("r.ruleId")), F.when(F.col("r.rule.id") != "", F.col("r.rule.id"))))
    rule = F.try_element_at(F.filter("rules", lambda x: x["id"] == F.col("rule_id")), F.lit(-1))
    rows = rows.withColumn("rule", rule).withColumn("cwe", resolve_cwe(F.col("tool"), F.col("rule_id"), F.col("rule")))
    severity = F.coalesce(F.col("rule.properties.`security-severity`").try_cast("double"), F.col("r.properties.`security-severity`").try_cast("double"))
    rows = rows.withColumn("severity", severity).withColumn("tier", cwe.tier("severity"))
    ladder = F.when(F.col("severity") >= 7, 0.8).when(F.col("severity") >= 4, 0.5).when(F.col("severity").isNotNull(), 0.3).otherwise(0.5)
    given = lambda c: F.col(c).isNotNull() & ~F.is_variant_null(c)
    named = F.when(given("r.level"), cwe.coerce_confidence("r.level")).when(given("r.properties.confidence"), cwe.coerce_confidence("r.properties.confidence")).otherwise(ladder)
    raised = F.when(F.col("severity") >= 7, F.greatest(named, F.lit(0.8))).when(F.col("severity") >= 4, F.greatest(named, F.lit(0.5))).otherwise(named)
    place = F.try_element_at(F.filter("r.locations", lambda x: x["physicalLocation"]["artifactLocation"]["uri"].isNotNull() & x["physicalLocation"]["region"]["startLine"].isNotNull()), F.lit(1))["physicalLocation"]
    rows = rows.withColumn("confidence", raised).withColumn("place", place)
    usable = rows.where(F.col("cwe").isNotNull() & F.col("place").isNotNull() & (F.col("confidence") >= F.element_at(cwe.mapping(cwe.FLOORS), F.col("tier"))))
    region = [F.col(f"place.region.{n}").alias(a) for n, a in (("startLine", "start_line"), ("startColumn", "start_column"), ("endLine", "end_line"), ("endColumn", "end_column"))]
    kind = F.schema_of_variant("r.message")
    said = F.when(kind.startswith("OBJECT"), F.try_variant_get("r.message", "$.text", "string")).when(kind != "VOID", F.col("r.message").cast("string"))
    return usable.select(id_col, "tool", "rule_id", "cwe", "severity", "tier", "confidence", F.col("place.artifactLocation.uri").alias("file"), *region, F.coalesce(said, F.lit("")).alias("message"))


def merge(findings: DataFrame, keys: list[str], carried: list[str], order: list[str]) -> DataFrame:
    """One finding per key: the rest from the most confident member (the first of equals by order), the greatest severity,
    confidence raised by 0.15 for each further member up to 1, and all tools."""
    first = F.struct(F.col("confidence"), *[-F.col(o) for o in order])
    out = findings.groupBy(*keys).agg(F.max_by(F.struct(*carried), first).alias("_m"), F.max("severity").alias("severity"), F.max("confidence").alias("_c"), F.count("*").alias("members"), F.array_sort(F.collect_set("tool")).alias("tools"))
    return out.select(*keys, "_m.*", "severity", F.least(F.lit(MAX_CONFIDENCE), F.col("_c") + F.lit(BOOST) * (F.col("members") - 1)).alias("confidence"), "members", "tools")


def source_severity(findings: DataFrame, medians: DataFrame, key: str = "cwe") -> DataFrame:
    """Adds sourced and severity_source: the tool's number, else the weakness's median, else the tier's middle."""
    j = findings.join(medians.withColumnRenamed("median", "_median"), key, "left")
    middle = F.element_at(cwe.mapping(cwe.MIDPOINTS), F.col("tier"))
    return j.withColumn("sourced", F.coalesce("severity", "_median", middle)).withColumn("severity_source", F.when(F.col("severity").isNotNull(), "tool").when(F.col("_median").isNotNull(), "median").otherwise("tier")).drop("_median")


def collapse_related(findings: DataFrame, closure: DataFrame, place: list[str]) -> DataFrame:
    """Adds final_cwe: at one place, weaknesses that the closure relates become the most specific of them.

    A place has at most as many weaknesses as the hierarchy; what is related there is found over arrays, by widening each
    one's set with the sets that it touches, once more than the number of weaknesses can be halved: then nothing moves.
    """
    related = closure.select(F.col("descendant").alias("cwe"), F.col("ancestor").alias("other")).unionAll(closure.select(F.col("ancestor").alias("cwe"), F.col("descendant").alias("other")))
    at = findings.select(*place, "cwe").distinct()
    linked = at.join(related, "cwe").join(at.withColumnRenamed("cwe", "other"), [*place, "other"])
    sets = at.join(linked.groupBy(*place, "cwe").agg(F.collect_set("other").alias("o")), [*place, "cwe"], "left").select(*place, "cwe", F.array_union(F.array("cwe"), F.coalesce("o", F.array().cast("array<string>"))).alias("s"))
    widened = lambda every, s: F.aggregate(every, s, lambda a, x: F.when(F.arrays_overlap(a, x), F.array_union(a, x)).otherwise(a))
    turns = F.sequence(F.lit(0), F.ceil(F.log2(F.size("all"))).cast("int"))
    settled = F.aggregate(turns, F.col("all"), lambda every, _: F.transform(every, lambda s: widened(every, s)))
    at_place = sets.groupBy(*place).agg(F.collect_list("cwe").alias("cwes"), F.collect_list("s").alias("all"))
    sets = at_place.withColumn("sets", settled).select(*place, F.explode(F.arrays_zip("cwes", "sets")).alias("x")).select(*place, F.col("x.cwes").alias("cwe"), F.array_sort("x.sets").alias("s"))
    up = closure.groupBy("ancestor").agg(F.collect_set("descendant").alias("below"))
    each = sets.select(*place, "cwe", F.explode("s").alias("m"), "s").join(up, F.col("m") == F.col("ancestor"), "left")
    specific = each.where(F.col("below").isNull() | ~F.arrays_overlap("below", "s")).groupBy(*place, "cwe").agg(F.min("m").alias("final_cwe"))
    return findings.join(specific, [*place, "cwe"], "left")
