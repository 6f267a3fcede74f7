"""Group-relative statistics, policy terms, schedules and stopping rules as window functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS, ZERO_STD, SIGMA_FLOOR = 1e-8, 1e-6, 0.05
CLIP, KL = 0.2, 0.05


def group_advantage(rows: DataFrame, group: str, reward: str) -> DataFrame:
    """Adds mean, std (of the population), active and advantage (r - mean) / (max(std, floor) + eps); 0 in flat groups."""
    w = Window.partitionBy(group)
    out = rows.withColumn("mean", F.avg(reward).over(w)).withColumn("std", F.stddev_pop(reward).over(w)).withColumn("active", F.col("std") >= ZERO_STD)
    value = (F.col(reward) - F.col("mean")) / (F.greatest("std", F.lit(SIGMA_FLOOR)) + EPS)
    return out.withColumn("advantage", F.when(F.col("active"), value).otherwise(0.0))


def leave_one_out(rows: DataFrame, group: str, reward: str) -> DataFrame:
    """Adds advantage: r less the mean of the group's others; r itself in a group of one."""
    w = Window.partitionBy(group)
    n, total = F.count("*").over(w), F.sum(reward).over(w)
    return rows.withColumn("advantage", F.when(n > 1, F.col(reward) - (total - F.col(reward)) / (n - 1)).otherwise(F.col(reward).cast("double")))


def top_k_mask(rows: DataFrame, group: str, reward: str, id_col: str, k: int) -> DataFrame:
    """Adds selected: exactly k rows a group, ties by id."""
    return rows.withColumn("selected", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(reward), id_col)) <= k)


def value_advantage(rows: DataFrame, reward: str, value: str) -> DataFrame:
    return rows.withColumn("advantage", F.col(reward) - F.coalesce(F.col(value), F.lit(0.0)))


def inverse_frequency(rows: DataFrame, cell: str, alpha: float = 0.5) -> DataFrame:
    """Adds weight (cells / rows of the cell) ** alpha, over the mean of the batch.

    The counts are one small aggregation; rows only meet it in a join.
    """
    if not 0 <= alpha <= 1:
        raise ValueError("alpha is a number from 0 to 1")
    cells = rows.groupBy(cell).agg(F.count("*").alias("_n"))
    k = cells.count()
    cells = cells.withColumn("_w", F.pow(F.lit(float(k)) / F.col("_n"), F.lit(alpha)))
    mean = cells.agg((F.sum(F.col("_w") * F.col("_n")) / F.sum("_n")).alias("m")).first()["m"] or 1.0
    return rows.join(cells.select(cell, (F.col("_w") / F.lit(mean)).alias("weight")), cell)


def surrogate(rows: DataFrame, log_ratio: str, advantage: str) -> DataFrame:
    """Adds ratio, policy loss (the worse of the plain and the clipped term) and the unclipped ratio's penalty."""
    ratio = F.exp(F.greatest(F.lit(-20.0), F.least(F.lit(20.0), F.col(log_ratio))))
    clipped = F.greatest(F.lit(1 - CLIP), F.least(F.lit(1 + CLIP), F.col("ratio")))
    out = rows.withColumn("ratio", ratio)
    return out.withColumn("policy", -F.least(F.col("ratio") * F.col(advantage), clipped * F.col(advantage))).withColumn("penalty", F.lit(KL) * F.col(log_ratio))


def anneal(step, start: float, end: float, steps: int) -> Column:
    return F.lit(start) + F.least(F.lit(1.0), F.col(step) / F.lit(steps)) * F.lit(end - start)


def warmup_cosine(step, warmup: int, total: int) -> Column:
    s = F.col(step)
    decayed = F.lit(0.5) * (1 + F.cos(F.lit(3.141592653589793) * F.least(F.lit(1.0), (s - warmup) / F.lit(max(1, total - warmup)))))
    return F.when(s < warmup, s / F.lit(max(1, warmup))).otherwise(decayed)


def last_phase(steps: DataFrame, step: str, phases: list[tuple[int, float, float]]) -> DataFrame:
    """The last phase whose start is not above the step, from a few literals: no join."""
    found = F.array(*[F.struct(F.lit(i + 1).alias("phase"), F.lit(s).alias("start"), F.lit(a).alias("alpha"), F.lit(b).alias("beta")) for i, (s, a, b) in enumerate(phases)])
    return steps.withColumn("_p", F.element_at(F.filter(found, lambda p: p["start"] <= F.col(step)), -1)).select("*", "_p.phase", "_p.alpha", "_p.beta").drop("_p")


def as_of(left: DataFrame, right: DataFrame, on: str, by: list[str], values: list[str]) -> DataFrame:
    """Joins each left row to the last right row at or before it, by a union and one window instead of a theta join."""
    both = left.select(*by, on, *[F.lit(None).cast(right.schema[v].dataType).alias(v) for v in values], F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"))
    both = both.unionAll(right.select(*by, on, *values, F.lit(0).alias("_side"), F.lit(None).cast(both.schema["_row"].dataType).alias("_row")))
    w = Window.partitionBy(*by).orderBy(on, "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.select("_side", "_row", *[F.last(v, ignorenulls=True).over(w).alias(v) for v in values]).where("_side = 1").select("_row.*", *values)


def stop_after_strikes(rows: DataFrame, run: str, step: str, score: str, points: float, patience: int) -> DataFrame:
    """Adds best (so far), strike (a drop of so many points below it), strikes in a row, and stopped."""
    w = Window.partitionBy(run).orderBy(step)
    out = rows.withColumn("best", F.max(score).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    out = out.withColumn("strike", (F.col("best") - F.col(score)) * 100 >= points)
    out = out.withColumn("_island", F.sum((~F.col("strike")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    row = Window.partitionBy(run, "_island").orderBy(step)
    out = out.withColumn("strikes", F.sum(F.col("strike").cast("int")).over(row.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return out.withColumn("stopped", F.max((F.col("strikes") >= patience).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) == 1).drop("_island")


def warmed_up(rows: DataFrame, run: str, step: str, score: str, first: int = 50) -> DataFrame:
    """Per run, whether the first steps brought anything at all."""
    return rows.where(F.col(step) < first).groupBy(run).agg((F.sum(score) != 0).alias("ok"))


def keep_last(rows: DataFrame, run: str, step: str, k: int) -> DataFrame:
    """Adds kept and latest for the newest k rows of a run."""
    rank = F.row_number().over(Window.partitionBy(run).orderBy(F.desc(step)))
    return rows.withColumn("kept", rank <= k).withColumn("latest", rank == 1)


def trailing_mean(rows: DataFrame, run: str, step: str, score: str, size: int) -> DataFrame:
    """Per run the mean over the last rows."""
    rank = F.row_number().over(Window.partitionBy(run).orderBy(F.desc(step)))
    return rows.withColumn("_r", rank).where(F.col("_r") <= size).groupBy(run).agg(F.avg(score).alias("mean"), F.count("*").alias("n"))


#: Steps of the algorithms, by name in any case: functions of (rows, group, reward) that add an advantage.
ALGORITHMS = {"grpo": group_advantage, "rloo": leave_one_out, "ppo": lambda rows, group, reward: value_advantage(rows, reward, "value"), "raft": lambda rows, group, reward: top_k_mask(rows, group, reward, "sample", 4)}


def algorithm(name: str):
    try:
        return ALGORITHMS[name.lower()]
    except KeyError:
        raise KeyError(f"{name}: known are {', '.join(sorted(ALGORITHMS))}") from None
