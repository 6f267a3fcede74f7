"""Sharding by sampled splitters, with DataFrame operations only.

Size-weighted samples of the sort key give quantile boundaries; records are range-partitioned by them; ranges that came
out overfull are sampled again and subdivided. Prefix sums inside the ranges then give every record its place, so shard
sizes are exact and not only as good as the sample.

The sort key is (hash of the text, id): equal texts are neighbours and share a shard, except where a group of copies is
so large that the shards would differ by it; then its rows are dealt one by one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_stash, stash, text_of, uniform

#: Boundaries that the driver may hold. Ranges of TARGET_BYTES each, within that number.
MAX_RANGES = 4096
TARGET_BYTES = 64 << 20
SAMPLES_PER_RANGE = 24
#: Groups of equal texts up to this part of a shard stay together.
WHOLE_GROUP = 64
ROUNDS = 3


def _splitters(rows: DataFrame, total: int, n_ranges: int, seed: int) -> list:
    """Boundaries (h, k) at the quantiles of the sampled weight. The sample's size is about n_ranges * SAMPLES_PER_RANGE."""
    p = F.least(F.lit(1.0), F.col("size") * F.lit(n_ranges * SAMPLES_PER_RANGE / max(1, total)))
    sample = rows.withColumn("p", p).where(uniform(F.col("k"), F.col("h"), seed=seed) < F.col("p"))
    w = Window.orderBy("h", "k")
    step = F.floor(F.sum(F.col("size") / F.col("p")).over(w) / F.lit(max(1, total) / n_ranges))
    cut = sample.select("h", "k", step.alias("step")).groupBy("step").agg(F.min(F.struct("h", "k")).alias("at"))
    return [(r["at"]["h"], r["at"]["k"]) for r in cut.where("step > 0").limit(2 * MAX_RANGES).collect()]


def _range_of(bounds: list):
    """Binary search of (h, k) among the sorted boundaries: how many are not above it."""
    if not bounds:
        return F.lit(0)
    steps, size = [], 1
    while size <= len(bounds):
        steps.insert(0, size)
        size *= 2
    h, k = (F.array(*[F.lit(int(b[i])).cast("long") for b in bounds]) for i in (0, 1))
    key = F.struct(F.col("h").alias("h"), F.col("k").alias("k"))

    def advance(at, step):
        to = at + step
        there = F.struct(F.try_element_at(h, to).alias("h"), F.try_element_at(k, to).alias("k"))
        return F.when((to <= len(bounds)) & (there <= key), to).otherwise(at)

    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), advance)


def assign_shards(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text", seed: int = 8) -> DataFrame:
    """A shard and a gapless slot for every row, with shard sizes in bytes as near equal as whole records allow.

    Size is the UTF-8 bytes of the text plus 1. A null text has size 1 and the checksum of no bytes, 0. Null ids sort as
    0 and stay null in the result. Repeated rows are separate records. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("k"), (F.octet_length(text_of(text_col)).cast("long") + 1).alias("size"), F.crc32(text_of(text_col).cast("binary")).alias("text_crc32"), F.xxhash64(text_of(text_col)).alias("h"))
    rows = stash(rows, "shard-keys")
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first()["n"]
    n_ranges = int(min(MAX_RANGES, max(4 * n_shards, total // TARGET_BYTES)))
    bounds = sorted(set(_splitters(rows, total, n_ranges, seed)))
    for turn in range(ROUNDS):  # subdivides what the sample left overfull
        sizes = {r["range"]: (r["size"], r["n"]) for r in rows.groupBy(_range_of(bounds).alias("range")).agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()}
        overfull = [r for r, (size, n) in sizes.items() if size > 2 * total / n_ranges and n > 1]
        if not overfull or len(bounds) > 2 * MAX_RANGES:
            break
        inside = rows.where(_range_of(bounds).isin(overfull))
        weight = sum(sizes[r][0] for r in overfull)
        more = _splitters(inside, weight, max(2, round(weight * n_ranges / max(1, total))), seed + turn + 1)
        if not set(more) - set(bounds):
            break
        bounds = sorted({*bounds, *more})
    ranged = rows.withColumn("range", _range_of(bounds))
    before, count = [0], [0]
    per = {r["range"]: (r["size"], r["n"]) for r in ranged.groupBy("range").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()}
    for r in range(len(bounds) + 1):
        size, n = per.get(r, (0, 0))
        before.append(before[-1] + size)
        count.append(count[-1] + n)
    lookup = lambda values: F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), F.col("range") + 1)
    order = Window.partitionBy("range").orderBy("h", "k")
    group = Window.partitionBy("range", "h")
    placed = ranged.withColumn("end", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("row", F.row_number().over(order))
    placed = placed.withColumn("g_size", F.sum("size").over(group)).withColumn("g_start", F.min(F.col("end") - F.col("size")).over(group))
    whole = F.col("g_size") * F.lit(WHOLE_GROUP * n_shards) <= F.lit(total)
    middle = lookup(before) * 2 + F.when(whole, F.col("g_start") * 2 + F.col("g_size")).otherwise(F.col("end") * 2 - F.col("size"))
    shard = F.least(F.lit(n_shards - 1), F.floor(middle * n_shards / F.lit(max(1, 2 * total))).cast("int"))
    placed = stash(placed.select("doc_id", "size", "text_crc32", shard.alias("shard"), (lookup(count) + F.col("row") - 1).alias("place")), "shard-places")
    firsts = {r["shard"]: r["first"] for r in placed.groupBy("shard").agg(F.min("place").alias("first")).collect()}
    first = F.element_at(F.array(*[F.lit(firsts.get(s, 0)).cast("long") for s in range(n_shards)]), F.col("shard") + 1)
    drop_stash(rows)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("place") - first).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
