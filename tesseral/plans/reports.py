"""Assembled plans: a corpus build in steps that are kept, and an evaluation report, a lazy plan over its operators."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.code import ast_normal
from ..functions.text import string_normalize
from ..operators import corpus, dedup, metrics, sampling
from ..sources.readers import in_scope
from ..sources.tables import stored

CELL = ["target_cwe", "language"]


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def pattern_key(text: str, language: str) -> Column:
    """Hash of the parsed form of Python, else of the text without comments, blanks and case."""
    return F.sha2(F.coalesce(F.when(F.col(language) == "python", ast_normal(text)), string_normalize(text)), 256)


def text_key(text: str, language: str) -> Column:
    """Hash of the text without comments, blanks and case, whatever its language."""
    return F.sha2(string_normalize(text), 256)


def _disjoint(rows: DataFrame, texts: list[str], held: DataFrame, pattern: Callable[[str, str], Column]) -> DataFrame:
    """The rows none of whose texts has a key of the evaluation side: the text's, or its pattern's."""
    seen = {"text": held.select("_text").withColumnRenamed("_text", "key"), "form": held.select("_form").withColumnRenamed("_form", "key")}
    for t in texts:
        rows = dedup.flag_overlap(rows, {"text": text_key(t, "language"), "form": pattern(t, "language")}, seen)
        rows = rows.where(~F.col("in_text") & ~F.col("in_form")).drop("in_text", "in_form")
    return rows


def build_corpus(
    sources: list[DataFrame], evaluation: list[DataFrame], caps: Column | int, seed: str, val: float = 0.05, pairs: list[DataFrame] = (), synthetic: DataFrame | None = None, synthetic_caps: Column | int = 0,
    near: float | None = 0.85, leak: float | None = 0.85, keep: Callable[[DataFrame, str], DataFrame] | None = None,
    pattern: Callable[[str, str], Column] = pattern_key,
) -> dict[str, DataFrame]:
    """train, val and eval prompts, exemplar pairs, and the manifest: the rows after each step.

    Prompts: scope; equal patterns by cell; near-duplicates by cell; caps by cell; disjointness from the evaluation side by
    text and by pattern; the split; validation rows close to a training row of their cell go. Pairs: scope; caps for
    synthetic ones; disjointness of both sides. Texts get their canonical form last. keep holds each step's rows for the
    next ones: by default in tables of the shared folder, so no step's plan holds those before it. pattern gives the key
    of a pattern from the columns of text and language; text_key goes without parsing, so that texts of one name each, as
    prose of one word is, stay apart.
    """
    keep = keep or stored(evaluation[0].sparkSession)
    steps: list[tuple[str, DataFrame]] = []

    def step(name: str, df: DataFrame) -> DataFrame:
        steps.append((name, keep(df, name)))
        return steps[-1][1]

    held = step("eval", _union(list(evaluation)).withColumn("_text", text_key("prompt_text", "language")).withColumn("_form", pattern("prompt_text", "language")))
    train = step("scope", in_scope(_union(list(sources))))
    train = step("exact", dedup.first_wins(train.withColumn("_h", pattern("prompt_text", "language")), [*CELL, "_h"], ["id"]).drop("_h"))
    if near is not None:
        train = step("near", dedup.near_in_cell(train, CELL, "id", "prompt_text", near).where("near_of IS NULL").drop("near_of"))
    train = step("cap", sampling.cap_per_cell(train, CELL, "id", caps, seed))
    train = step("disjoint", _disjoint(train, ["prompt_text"], held, pattern))
    split = sampling.split_fraction(train, CELL, "id", val)
    kept = {"train": step("train", split.where("split = 'train'").drop("split")), "val": step("val", split.where("split = 'val'").drop("split"))}
    if leak is not None:
        kept["val"] = step("val_without_leaks", dedup.leaks_in_cell(kept["val"], kept["train"], CELL, "id", "prompt_text", leak).where("leak_of IS NULL").drop("leak_of"))
    out = {name: corpus.normalized_prompts(df) for name, df in kept.items()} | {"eval": corpus.normalized_prompts(held.drop("_text", "_form"))}
    found = list(pairs)
    if synthetic is not None:
        named = corpus.scoped_pairs(synthetic).withColumn("_id", F.sha2(F.concat_ws("|", "e_neg", "e_pos"), 256))
        found.append(step("synthetic_cap", sampling.cap_per_cell(named, ["cwe", "language"], "_id", synthetic_caps, seed).drop("_id")))
    if found:
        out["pairs"] = step("pairs", _disjoint(corpus.scoped_pairs(_union(found)), ["e_pos", "e_neg"], held, pattern))
    counts = [df.agg(F.lit(i).alias("place"), F.lit(name).alias("step"), F.count("*").alias("n")) for i, (name, df) in enumerate(steps)]
    return out | {"manifest": _union(counts)}


def evaluation_report(records: DataFrame, stub: Column, severity: Column) -> dict[str, DataFrame]:
    """One frame a grain: rates over all, by weakness, by weakness and language; and the diagnostics of all records."""
    rates = metrics.conditional_rates(records, metrics.record_predicates(stub, severity), [[], ["target_cwe"], ["target_cwe", "language"]])
    tools = [F.coalesce(F.sum(F.size(c)), F.lit(0)).alias(f"{c}_n") for c in ("sast_crashed_tools", "sast_timed_out_tools") if c in records.columns]
    return {"rates": rates, "diagnostics": records.agg(F.count("*").alias("n"), F.avg(F.col("refusal").cast("int")).alias("refusal_rate"), F.avg(F.col("crashed").cast("int")).alias("crash_rate"), *tools)}
