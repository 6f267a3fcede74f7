"""Connected components by alternating large-star and small-star, each step in a table in the shared folder.

The least neighbours of a step are a table of their own: where the optimizer finds it small it is broadcast, else the
join stands alone in its stage, where the partition of a hot id is split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stash, stash

ROUNDS = 50
#: Rows of a step's table in one task, about; few rows in many tasks cost more than they bring.
TASK_ROWS = 20_000


def _large_star(edges: DataFrame, tasks: int) -> DataFrame:
    """Every larger neighbour of an id is linked to the id's least neighbour, or to the id if that is less."""
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = stash(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")).coalesce(tasks), "least")
    out = stash(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct().coalesce(tasks), "edges")
    drop_stash(least)
    return out


def _small_star(edges: DataFrame, tasks: int) -> DataFrame:
    """Every smaller neighbour of an id, and the id, are linked to the least of them. Edges point from the larger id."""
    least = stash(edges.groupBy("u").agg(F.min("v").alias("m")).coalesce(tasks), "least")
    linked = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    out = stash(linked.unionAll(least.select("u", F.col("m").alias("v"))).distinct().coalesce(tasks), "edges")
    drop_stash(least)
    return out


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id that an edge (u, v) names; the component is its smallest id. Loops are ignored.

    The rounds needed grow with the logarithm of the ids; a result that is still moving after ROUNDS is an error.
    """
    now = stash(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    for turn in range(ROUNDS + 1):
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == seen or not state["n"]:
            break
        if turn == ROUNDS:
            raise RuntimeError(f"components are not found after {ROUNDS} rounds")
        seen = state
        tasks = max(8, state["n"] // TASK_ROWS + 1)
        large = _large_star(now, tasks)
        after = _small_star(large, tasks)
        drop_stash(now, large)
        now = after
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
