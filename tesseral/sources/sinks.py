"""Sinks: sorted JSON lines, shards, manifests, reports, indexes, caches, and tables as text."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def json_lines(df: DataFrame, path: str, order: list[str], force: bool = False) -> None:
    """Columns by name, rows by key; files are in order and so are their rows. What is there is an error unless forced."""
    df.select(*sorted(df.columns)).orderBy(*order).write.mode("overwrite" if force else "errorifexists").json(path)


def by_language(df: DataFrame, path: str, force: bool = False) -> None:
    name = F.replace(F.replace("language", F.lit("+"), F.lit("p")), F.lit("#"), F.lit("sharp"))
    df.withColumn("shard", name).write.mode("overwrite" if force else "errorifexists").partitionBy("shard").json(path)


def manifest(parts: dict[str, DataFrame], outer: str, inner: str, files: str | None = None) -> str:
    """JSON with each part's count and distribution, and the digests of written files."""
    out: dict = {}
    for name, df in parts.items():
        counts = df.groupBy(outer, inner).agg(F.count("*").alias("n")).collect()  # cells of two dimensions
        cells: dict = {}
        for r in counts:
            cells.setdefault(str(r[outer]), {})[str(r[inner])] = r["n"]
        out[name] = {"count": sum(r["n"] for r in counts), "by": cells}
        if files:
            found = df.sparkSession.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{files}/{name}")
            out[name]["sha256"] = sorted(r["h"] for r in found.select(F.sha2("content", 256).alias("h")).collect())
    return json.dumps(out, sort_keys=True)


def report(records: DataFrame, aggregates: DataFrame, path: str, force: bool = False) -> None:
    mode = "overwrite" if force else "errorifexists"
    records.write.mode(mode).partitionBy("model_name").json(f"{path}/per_prompt")
    aggregates.write.mode(mode).partitionBy("model_name").json(f"{path}/aggregate")


def retrieval_index(pairs: DataFrame, postings: DataFrame, embeddings: DataFrame, folder: str, force: bool = False) -> None:
    mode = "overwrite" if force else "errorifexists"
    key = [F.col("cwe"), F.col("source"), F.substring("e_neg", 1, 64), F.substring("e_pos", 1, 64)]
    pairs.orderBy(*key).write.mode(mode).parquet(f"{folder}/pairs")
    postings.repartition("term").sortWithinPartitions("term", "id").write.mode(mode).parquet(f"{folder}/postings")
    embeddings.write.mode(mode).parquet(f"{folder}/embeddings")


def cached(rows: DataFrame, cache: DataFrame, key: str, value: str) -> tuple[DataFrame, DataFrame]:
    """rows with the stored value (null: none), and the rows still to score."""
    j = rows.join(cache.select(key, value), key, "left")
    return j, j.where(F.col(value).isNull())


def upserted(cache: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The cache with new rows in place of old ones of their key."""
    return cache.join(new.select(key), key, "left_anti").unionByName(new)


def patched(df: DataFrame, where: Column, spec: str, fields: dict[str, Column]) -> DataFrame:
    """df with fields of a struct set in the rows that match."""
    new = F.col(spec)
    for name, value in fields.items():
        new = new.withField(name, value)
    return df.withColumn(spec, F.when(where, new).otherwise(F.col(spec)))


def markdown(df: DataFrame, limit: int = 200) -> str:
    """A small result as a table; the limit is what a page holds."""
    rows = df.limit(limit).collect()
    head = "| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns)
    return "\n".join([head, *("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows)])


def latex(df: DataFrame, limit: int = 200) -> str:
    rows = df.limit(limit).collect()
    body = " \\\\\n".join(" & ".join("" if v is None else str(v).replace("_", r"\_") for v in r) for r in [df.columns, *rows])
    return f"\\begin{{tabular}}{{{'l' * len(df.columns)}}}\n{body} \\\\\n\\end{{tabular}}"
