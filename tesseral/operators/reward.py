"""Rewards from signals, findings and retrieval, as column arithmetic."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col


@dataclass(frozen=True)
class RewardConfig:
    alpha: float = 0.3
    compiles: float = 0.2
    runs: float = 0.2
    output: float = 0.2
    functional: float = 0.4
    stub: float = 1.5
    retrieval: float = 0.1
    copied: float = 0.95


DEFAULT = RewardConfig()


def reliability(compiles, runs, output, passed, total, c: RewardConfig = DEFAULT) -> Column:
    """The weighted signals; without tests the first three are scaled to the whole."""
    flags = F.lit(c.compiles) * col(compiles).cast("int") + F.lit(c.runs) * col(runs).cast("int") + F.lit(c.output) * col(output).cast("int")
    three = c.compiles + c.runs + c.output
    return F.when(col(total) > 0, flags + F.lit(c.functional) * col(passed) / col(total)).otherwise(flags * F.lit((three + c.functional) / three))


def summed(value: Column) -> Column:
    """The sum of a few doubles from the greatest down, the same in whatever order the rows come; null without any.

    In some orders a sum of doubles is above 1, and then clipped, in others it is 1.
    """
    found = F.reverse(F.array_sort(F.collect_list(value)))
    return F.when(F.size(found) > 0, F.aggregate(found, F.lit(0.0), lambda t, x: t + x))


def penalties(findings: DataFrame, key: str) -> DataFrame:
    """Per completion the sum of severity / 10 * confidence, and the number of findings."""
    return findings.groupBy(key).agg(summed(F.col("severity") / 10 * F.col("confidence")).alias("penalty"), F.count("*").alias("n_findings"))


def security(compiles, penalty) -> Column:
    return F.when(col(compiles), F.greatest(F.lit(0.0), 1 - F.coalesce(col(penalty), F.lit(0.0)))).otherwise(0.0)


def retrieval(sim_pos, sim_neg=None, c: RewardConfig = DEFAULT) -> Column:
    """A share of the likeness to the good exemplar, or all of it where that is the nearer one; nothing for copies."""
    paid = F.lit(c.retrieval) * col(sim_pos) if sim_neg is None else F.when(col(sim_pos) > col(sim_neg), F.lit(c.retrieval)).otherwise(0.0)
    return F.when(col(sim_pos) > c.copied, 0.0).otherwise(F.coalesce(paid, F.lit(0.0)))


def total(r_security, r_reliability, r_rag, stub, c: RewardConfig = DEFAULT) -> Column:
    return F.lit(c.alpha) * col(r_security) + F.lit(1 - c.alpha) * col(r_reliability) + col(r_rag) - F.lit(c.stub) * col(stub).cast("int")


def compose(rows: DataFrame, findings: DataFrame, key: str, c: RewardConfig = DEFAULT) -> DataFrame:
    """rows with flags compiles, runs, output, refused, stub, numbers passed and total, and sim_pos (null: none retrieved).

    Refusals keep their signals but have neither findings nor retrieval; stubs have nothing but the deduction.
    """
    j = rows.join(penalties(findings, key), key, "left").withColumn("penalty", F.when(F.col("refused"), 0.0).otherwise(F.coalesce("penalty", F.lit(0.0))))
    j = j.withColumn("r_reliability", F.when(F.col("stub"), 0.0).otherwise(reliability("compiles", "runs", "output", "passed", "total", c)))
    j = j.withColumn("r_security", F.when(F.col("stub"), 0.0).otherwise(security("compiles", "penalty")))
    j = j.withColumn("r_rag", F.when(F.col("stub") | F.col("refused") | F.col("sim_pos").isNull(), 0.0).otherwise(retrieval("sim_pos", None, c)))
    return j.withColumn("clipped", F.col("penalty") > 1).withColumn("r_total", F.bround(total("r_security", "r_reliability", "r_rag", F.col("stub"), c), 6))
