"""The pipeline over the smallest tables, held against brute force stage by stage."""

import hashlib
import os

import pytest

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
def test_pipeline_like_brute_force(spark):
    import corpus_pipeline as c

    from tests.llm.test_near_dup import expected
    from tests.llm.test_records import distance_in, normal
    from tests.llm.test_substrings import words_expected

    docs = c.table(spark, SF, "documents")
    columns = docs.columns
    every = {r.doc_id: r for r in docs.collect()}
    kept = c.stash(c.STAGES[0][1](spark, docs, SF), "t")
    assert kept.columns == columns
    good = sorted((r.doc_id, r.text) for r in kept.collect())
    assert 0.5 * len(every) < len(good) < len(every) and all(every[d].text == t for d, t in good)

    near = c.stash(c.STAGES[1][1](spark, kept, SF), "t")
    first = {good[root][0] for _, root in expected(good, 5, 80)}
    assert {r.doc_id for r in near.collect()} == first and near.columns == columns

    cut = c.stash(c.STAGES[2][1](spark, near, SF), "t")
    want = words_expected([(d, t) for d, t in good if d in first], 20)
    for r in cut.collect():
        n, gone, digest = want[r.doc_id, every[r.doc_id].text]
        assert hashlib.sha256(" ".join(r.text.split()).encode()).hexdigest() == digest and r.n_chars == len(r.text)
        assert gone or r.text == every[r.doc_id].text
    assert cut.count() == len(first) and cut.columns == columns

    clean = c.stash(c.STAGES[3][1](spark, cut, SF), "t")
    items = [normal(r.text) for r in c.table(spark, SF, "benchmark").collect()]
    leaky = set()
    for r in cut.collect():
        words = normal(r.text)
        shared = set(words)
        if any(len(shared & set(i)) >= len(set(i)) // 2 and distance_in(i, words) <= len(i) // 5 for i in items):
            leaky.add(r.doc_id)
    assert {r.doc_id for r in clean.collect()} == first - leaky and clean.columns == columns

    last = {r.doc_id: r for r in c.STAGES[4][1](spark, clean, SF).collect()}
    assert {d: r.decoded_sha256 for d, r in last.items()} == {r.doc_id: hashlib.sha256((r.text or "").encode()).hexdigest() for r in clean.collect()}
    whole = {r.doc_id: r.ids_sha256 for r in c.run(spark, SF).collect()}
    assert whole == {d: r.ids_sha256 for d, r in last.items()}


def test_pipeline_over_hard_rows(spark, tmp_path, rows):
    """Nulls, empty and long texts, repeated rows, extra columns with clashing names; then tables without a row."""
    import corpus_pipeline as c
    from pyspark.sql import functions as F

    good = [(1000 + i, " ".join(f"word{(i * 37 + j * 11) % 5000}" for j in range(150)), "en", "s", 1) for i in range(60)]
    bad = [(2000 + i, "buy now!!! " * 40 + f"z{i}", "en", "s", 1) for i in range(60)]
    docs = spark.createDataFrame([*rows, *good, *bad, (3000, "long " + "tail of a text " * 20_000, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.select("*", *[F.lit(7).alias(n) for n in ("k", "th", "runs", "hits", "component", "score", "ids", "payload")])
    labels = spark.createDataFrame([(1000 + i, 1, 0) for i in range(60)] + [(2000 + i, 0, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, good[5][1][:400]), (2, None), (None, "x"), (3, "")], "item_id long, text string")
    for name, whole in (("full", True), ("empty", False)):
        folder = f"{tmp_path}/{name}"
        for table, df in (("documents", docs), ("labels", labels), ("benchmark", items)):
            (df if whole else df.limit(0)).write.parquet(f"{folder}/{table}.parquet")
        out = c.run(spark, folder).collect()
        if not whole:
            assert out == []
            continue
        ids = [r.doc_id for r in out]
        assert not any(i is not None and 2000 <= i < 2060 for i in ids) and 1005 not in ids
        assert sum(1000 <= (i or 0) < 1060 for i in ids) == 59
        kept = docs
        for _, stage in c.STAGES[:-1]:
            kept = c.stash(stage(spark, kept, folder), "t")
            assert kept.columns == docs.columns
        assert sorted(map(str, ids)) == sorted(str(r.doc_id) for r in kept.collect())
