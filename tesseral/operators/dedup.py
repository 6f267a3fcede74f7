"""Exact and near duplicates, disjointness and overlap."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.code import close_texts

#: Members of a bucket that one task compares with the rows that ask.
BLOCK = 256


def first_wins(rows: DataFrame, keys: Sequence[Column | str], order: Sequence[Column | str]) -> DataFrame:
    """Of rows with one key the first by the given order, which must be total."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_first", F.row_number().over(w)).where("_first = 1").drop("_first")


def last_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of rows with one key the one with the largest order value; combined before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_row"))
    return last.select(*keys, "_row.*")


def flag_overlap(train: DataFrame, keys: dict[str, Column], evaluation: dict[str, DataFrame]) -> DataFrame:
    """Adds a boolean per key: whether the evaluation side has it. One equi join a key, never a join on OR."""
    for name, key in keys.items():
        seen = evaluation[name].select(F.col("key").alias(f"_{name}")).where("key IS NOT NULL").distinct().withColumn(f"in_{name}", F.lit(True))
        train = train.withColumn(f"_k{name}", key).join(seen, F.col(f"_k{name}") == F.col(f"_{name}"), "left")
        train = train.withColumn(f"in_{name}", F.coalesce(f"in_{name}", F.lit(False))).drop(f"_{name}", f"_k{name}")
    return train


def near_in_cell(rows: DataFrame, cell: list[str], id_col: str, text_col: str, threshold: float = 0.85, seeds: int = 24, band: int = 3) -> DataFrame:
    """Adds near_of: the least id of a close text in the same cell that stands before the row, or null.

    Candidates share a band of minima over five-word shingles. Equal texts count as one; each bucket compares its rows with
    its first one, then those that are not close to that with all the others. Close is by the longest common subsequence,
    with case and blanks made one. Distributed, and so not the greedy pass in id order that one machine would make.
    """
    kind = rows.schema[id_col].dataType.simpleString()
    norm = F.lower(F.trim(F.regexp_replace(F.col(text_col), r"(?U)[\s\x1c-\x1f]+", " ")))
    words = F.filter(F.split("_t", r"[^\p{L}\p{N}]+"), lambda x: x != "")
    shingle = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("_w") - 4)), lambda i: F.xxhash64(F.array_join(F.slice("_w", i, F.lit(5)), " ")))
    place = F.to_json(F.struct(*cell))
    texts = rows.select(F.col(id_col).alias("_id"), place.alias("_c"), norm.alias("_t"))
    digest = lambda t: F.sha2(F.concat("_c", F.char(F.lit(0)), t), 256)
    base = texts.select("_id", "_c", digest("_t").alias("_h"), words.alias("_w")).where(F.size("_w") > 0).select("_id", "_c", "_h", shingle.alias("_s"))

    def seeded(seed):  # a lambda of two arguments would get the index as its second
        return F.array_min(F.transform("_s", lambda h: F.xxhash64(h, F.lit(seed))))

    least = [seeded(s) for s in range(seeds)]
    bands = F.array(*[F.xxhash64("_c", F.lit(b), *least[b : b + band]) for b in range(0, seeds, band)])
    own = base.select("_id", "_h", bands.alias("_keys")).groupBy("_h").agg(F.min("_id").alias("_id"), F.first("_keys").alias("_keys"), F.count("*").alias("_copies"))
    keyed = own.select("_id", F.explode(F.array_distinct("_keys")).alias("_key"))
    first = keyed.groupBy("_key").agg(F.min("_id").alias("_to"), F.count("*").alias("_n")).where("_n > 1")
    placed = keyed.join(first, "_key").where("_id > _to")
    pairs = placed.select("_id", "_to").distinct()

    @F.pandas_udf("boolean")
    def close(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([close_texts(x, y, threshold) for x, y in zip(a, b, strict=True)], dtype="bool")

    text = texts.select(F.col("_id").alias("_i"), "_t")
    both = pairs.join(text, F.col("_id") == F.col("_i")).select("_id", "_to", F.col("_t").alias("_a")).join(text, F.col("_to") == F.col("_i"))
    links = both.where(close("_a", "_t")).select("_id", "_to")

    # whatever is close to the first of a bucket has nothing less there, and a row with a lesser one elsewhere needs none
    best = links.groupBy("_id").agg(F.min("_to").alias("_best"))
    undecided = placed.where("_n > 2").join(links, ["_id", "_to"], "left_anti").join(best, "_id", "left").where("_best IS NULL OR _best > _to")
    blocks = F.ceil(F.col("_n") / BLOCK).cast("int")
    asking = undecided.select("_key", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("_block"), F.lit(True).alias("_asks"), "_id", "_best")
    members = placed.join(undecided.select("_key").distinct(), "_key", "left_semi")
    members = members.select("_key", F.pmod(F.xxhash64("_id"), blocks).cast("int").alias("_block"), F.lit(False).alias("_asks"), "_id", F.lit(None).cast(kind).alias("_best"))
    met = asking.unionAll(members).join(own.select("_id", "_keys"), "_id").join(text, F.col("_id") == F.col("_i"))
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    met = met.select("_key", "_block", "_asks", "_id", "_best", "_keys", "_t").repartition(parts, "_key", "_block").sortWithinPartitions("_key", "_block")
    rest = met.mapInArrow(_least_close(threshold), f"_id {kind}, _to {kind}")

    found = links.unionAll(rest).groupBy("_id").agg(F.min("_to").alias("_best"))
    least_of = own.join(found, "_id", "left").where("_copies > 1 OR _best IS NOT NULL").select("_h", F.least("_id", "_best").alias("_least"))
    near = texts.select("_id", digest("_t").alias("_h")).join(least_of, "_h").where("_id > _least").select("_id", F.col("_least").alias("near_of"))
    return rows.join(near, F.col(id_col) == F.col("_id"), "left").drop("_id")


def _least_close(threshold: float):
    """Over rows (key, block, asks, id, best, keys, text) in order of key and block: each asking row with its least close member.

    A pair is compared in the first of the buckets it shares, and only below what the row already has.
    """

    def answers(key, members, asking):
        members.sort(key=lambda m: m[0])
        for own, best, keys, text in asking:
            for other, _, theirs, there in members:
                if other >= own or (best is not None and other >= best):
                    break
                if next(x for x, y in zip(keys, theirs, strict=True) if x == y) == key and close_texts(text, there, threshold):
                    yield own, other
                    break

    def run(batches):
        schema, now, members, asking, out = None, None, [], [], []
        for batch in batches:
            schema = pa.schema([("_id", batch.schema.field("_id").type), ("_to", batch.schema.field("_id").type)])
            for key, block, asks, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (key, block) != now:
                    out += answers(now[0], members, asking) if now else ()
                    now, members, asking = (key, block), [], []
                (asking if asks else members).append(row)
        if now:
            out += answers(now[0], members, asking)
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], schema.field(i).type) for i in (0, 1)], schema=schema)

    return run


def leaks_in_cell(asking: DataFrame, other: DataFrame, cell: list[str], id_col: str, text_col: str, threshold: float = 0.85, block: int = BLOCK) -> DataFrame:
    """Adds leak_of to the asking rows: the least id of a text of the other side, in the same cell, as close as threshold; or null.

    Close is close_texts on the texts as they are. All pairs of a cell's two sides are decided, in blocks; a few of the
    rows of a cell should ask, as those held out for validation do.
    """
    kind = asking.schema[id_col].dataType.simpleString()

    def side(rows):
        return rows.select(F.to_json(F.struct(*cell)).alias("_c"), F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).where("_t IS NOT NULL")

    left, right = side(asking), side(other)
    count = lambda rows, name: rows.groupBy("_c").agg(F.ceil(F.count("*") / block).cast("int").alias(name))
    sizes = count(left, "_l").join(count(right, "_r"), "_c")

    def dealt(rows, own, across, asks):
        mine, to = F.pmod(F.xxhash64("_id"), F.col(own)).cast("int"), F.explode(F.sequence(F.lit(0), F.col(across) - 1))
        return rows.join(sizes, "_c").select("_c", mine.alias("_own"), to.alias("_to"), F.lit(asks).alias("_asks"), "_id", "_t")

    met = dealt(left, "_l", "_r", True).select("_c", F.col("_own").alias("_a"), F.col("_to").alias("_b"), "_asks", "_id", "_t")
    met = met.unionAll(dealt(right, "_r", "_l", False).select("_c", F.col("_to").alias("_a"), F.col("_own").alias("_b"), "_asks", "_id", "_t"))

    def run(frame):
        rows = sorted(zip(frame.loc[~frame["_asks"], "_id"], frame.loc[~frame["_asks"], "_t"], strict=True), key=lambda r: r[0])
        found = [(i, next((j for j, u in rows if close_texts(t, u, threshold)), None)) for i, t in zip(frame.loc[frame["_asks"], "_id"], frame.loc[frame["_asks"], "_t"], strict=True)]
        return pd.DataFrame([f for f in found if f[1] is not None], columns=["_id", "_to"])

    near = met.groupBy("_c", "_a", "_b").applyInPandas(run, f"_id {kind}, _to {kind}").groupBy("_id").agg(F.min("_to").alias("leak_of"))
    return asking.join(near, F.col(id_col) == F.col("_id"), "left").drop("_id")


def _blocks(passages: DataFrame, rows: int = 10_000):
    """(id, text) of the passages, so many at a time on the driver."""
    block = []
    for r in passages.toLocalIterator():
        block.append((r[0], r[1]))
        if len(block) == rows:
            yield block
            block = []
    if block:
        yield block


def _search(block: list[tuple]):
    """Over rows (id, text) the pairs (id, passage id) of one automaton of passages."""

    def run(batches):
        import ahocorasick

        ids: dict[str, list] = {}
        for i, text in block:
            ids.setdefault(text, []).append(i)
        automaton = ahocorasick.Automaton()
        for text in ids:
            automaton.add_word(text, text)
        automaton.make_automaton()
        for batch in batches:
            pairs = [(d, p) for d, t in zip(*(c.to_pylist() for c in batch.columns), strict=True) if t for x in {x for _, x in automaton.iter(t)} for p in ids[x]]
            yield pa.RecordBatch.from_pydict({"_d": [x[0] for x in pairs], "_p": [x[1] for x in pairs]})

    return run


def passages_in(texts: DataFrame, id_col: str, text_col: str, passages: DataFrame, passage_id: str, passage_text: str, size: int = 6) -> DataFrame:
    """(id, passage id) where the text contains the passage whole.

    A passage's words but the first and the last stand whole inside any occurrence, whatever is glued to its ends; the
    first size of them are its key. Keys are hashes; a text's runs of words are tested against the passages' few keys
    before anything is shuffled. Passages of fewer than three words have no such word; they are searched in all texts, a
    block of them at a time. An empty passage is in no text.
    """
    words = lambda c: F.filter(F.split(c, r"\s+"), lambda x: x != "")
    key = lambda w: F.xxhash64(F.array_join(w, " "))
    p = passages.select(F.col(passage_id).alias("_p"), F.col(passage_text).alias("_pt"), words(F.col(passage_text)).alias("_w")).where("_pt <> ''")
    p = p.withColumn("_n", F.least(F.size("_w") - 2, F.lit(size)))
    long = p.where("_n > 0").select("_p", "_pt", "_n", key(F.slice("_w", F.lit(2), F.col("_n"))).alias("_key"))
    short = p.where("_n <= 0").select("_p", "_pt")
    sizes = sorted(r["_n"] for r in long.select("_n").distinct().collect())  # at most size values
    base = texts.select(F.col(id_col).alias("_d"), F.col(text_col).alias("_t"))

    def runs(n):
        return F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("_w") - n + 1), lambda i: key(F.slice("_w", i, F.lit(n)))))

    kinds = [rows.schema[c].dataType.simpleString() for rows, c in ((texts, id_col), (passages, passage_id))]
    found = base.where(F.lit(False)).select("_d", F.lit(None).cast(kinds[1]).alias("_p"))
    for block in _blocks(short):
        found = found.unionAll(base.mapInArrow(_search(block), f"_d {kinds[0]}, _p {kinds[1]}"))
    for n in sizes:
        grams = base.select("_d", words(F.col("_t")).alias("_w")).where(F.size("_w") >= n).select("_d", F.explode(runs(n)).alias("_key"))
        own = long.where(F.col("_n") == n)
        hits = grams.join(own, "_key").select("_d", "_p", "_pt").join(base, "_d").where(F.contains("_t", "_pt")).select("_d", "_p")
        found = found.unionAll(hits)
    return found.select(F.col("_d").alias(id_col), F.col("_p").alias(passage_id)).distinct()
