"""Supply, quotas, manifests and prompt assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cwe import languages_in_scope
from ..functions.text import col, well_formed_prompt


def supply(rows: DataFrame, cell: list[str], key: Column) -> DataFrame:
    """Per cell: distinct contents and rows."""
    return rows.withColumn("_key", key).groupBy(*cell).agg(F.countDistinct("_key").alias("patterns"), F.count("*").alias("n_rows"))


def quota(cells: DataFrame, real: str, synth: str, cap: int = 200, floor: int = 20) -> DataFrame:
    """Adds take_real, take_synth (a tenth of the whole at most), total, deficit and val."""
    out = cells.withColumn("take_real", F.least(F.col(real), F.lit(cap)))
    out = out.withColumn("take_synth", F.least(F.col(synth), F.floor(F.col("take_real") * F.lit(0.1) / F.lit(0.9))))
    out = out.withColumn("total", F.col("take_real") + F.col("take_synth")).withColumn("deficit", F.greatest(F.lit(0), F.lit(floor) - F.col("total")))
    return out.withColumn("val", F.floor(F.col("total") * F.lit(0.05) + F.lit(0.5)))


def floor_status(total: Column, floor: int = 20) -> Column:
    return F.when(total >= floor, F.lit("ok")).when(total > 0, F.format_string("short by %d", F.lit(floor) - total)).otherwise("empty")


# The notes in a prompt's metadata, and the version of the canonical form.
NOTES = ("prompt_text_pre_normalize", "prompt_normalize_applied", "prompt_normalize_version")
NORMALIZER = "1.0.0"


def scoped_pairs(pairs: DataFrame) -> DataFrame:
    """Exemplar pairs of a weakness and language in scope."""
    return pairs.where(F.array_contains(languages_in_scope("cwe"), F.col("language")))


def normalized_prompts(prompts: DataFrame, skip_well_formed: bool = True, record_original: bool = True, record_applied: bool = True) -> DataFrame:
    """Prompts in canonical form; their metadata say whether the text was changed, and what a changed one was before, if asked for."""
    none = F.create_map().cast("map<string,string>")
    wrapped = canonical_prompt("prompt_text", "task_signature", "language", "target_cwe", skip_well_formed)
    changed = F.coalesce(~well_formed_prompt("prompt_text"), F.lit(True)) if skip_well_formed else F.lit(True)
    own = F.coalesce("metadata", none) if "metadata" in prompts.columns else none
    own = F.map_filter(own, lambda k, _: ~k.isin(*NOTES))
    before = F.when(changed, F.create_map(F.lit(NOTES[0]), F.col("prompt_text"))).otherwise(none) if record_original else none
    said = F.create_map(F.lit(NOTES[1]), changed.cast("string"), F.lit(NOTES[2]), F.lit(NORMALIZER)) if record_applied else none
    return prompts.withColumn("metadata", F.map_concat(own, before, said)).withColumn("prompt_text", wrapped)


def canonical_prompt(text, signature, language, cwe, skip_well_formed: bool = True) -> Column:
    """An instruction and a body: well-formed prompts stay as they are, unless that is not wanted."""
    text, signature = F.trim(col(text)), F.trim(F.coalesce(col(signature), F.lit("")))
    label = F.when(col(language) == "python", "Python").when(col(language) == "c", "C").when(col(language) == "cpp", "C++").otherwise("code")
    fence = F.coalesce(F.when(col(language).isin("python", "c", "cpp"), col(language)), F.lit(""))
    clause = F.when(col(cwe) != "", F.concat(F.lit(" The implementation must be free of "), col(cwe), F.lit("."))).otherwise("")
    what = F.when(signature != "", F.concat(F.lit("Complete the following "), label, F.lit(" function."), clause, F.lit(" Return ONLY the complete function body"))).otherwise(F.concat(F.lit("Implement the following "), label, F.lit(" task."), clause, F.lit(" Return ONLY the complete code")))
    head = F.concat(what, F.lit(" wrapped in a ```"), fence, F.lit(" ... ``` block. No commentary, no explanation."))
    block = F.concat(F.lit("Signature:\n```"), fence, F.lit("\n"), signature, F.lit("\n```"))
    body = F.when((signature != "") & ((text == signature) | (text == "")), block).when((signature != "") & F.contains(text, signature), text).when(signature != "", F.concat(block, F.lit("\n\nDescription:\n"), text)).otherwise(text)
    return F.when(F.lit(skip_well_formed) & well_formed_prompt(text), text).otherwise(F.concat(head, F.lit("\n\n"), body))


def distribution(rows: DataFrame, outer: str, inner: str) -> DataFrame:
    """Per outer value the JSON of counts by inner value, keys sorted."""
    counts = rows.groupBy(outer, inner).agg(F.count("*").alias("n"))
    entries = F.array_sort(F.collect_list(F.struct(inner, "n")))
    return counts.groupBy(outer).agg(F.to_json(F.map_from_entries(entries)).alias("by_" + inner), F.sum("n").alias("n"))
