"""Operators on small frames with hand-made values."""

import functools
import itertools
import operator
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesseral.functions import cwe
from tesseral.operators import corpus, dedup, findings, groups, metrics, retrieval, reward, sampling, stats


def test_reward_table(spark):
    """Five outcomes: no compile; compiles without tests passed; a finding of full weight; partial; all."""
    rows = [
        (1, False, False, False, 0, 0, False, False), (2, True, True, True, 0, 3, False, False), (3, True, True, True, 3, 3, False, False), (4, True, True, True, 0, 0, False, False), (5, True, True, True, 3, 3, False, True), (6, True, True, True, 3, 3, True, False),
    ]
    df = spark.createDataFrame(rows, "id long, compiles boolean, runs boolean, output boolean, passed int, total int, refused boolean, stub boolean").withColumn("sim_pos", F.when(F.col("id") == 4, 0.5))
    found = spark.createDataFrame([(3, 8.8, 0.8), (6, 10.0, 1.0)], "id long, severity double, confidence double")
    got = {r.id: r for r in reward.compose(df, found, "id").collect()}
    assert (got[1].r_total, got[5].r_total) == (0.0, -1.5)
    assert got[2].r_reliability == pytest.approx(0.6) and got[2].r_total == pytest.approx(0.3 + 0.7 * 0.6)
    assert got[3].r_security == pytest.approx(0.296) and got[3].r_total == pytest.approx(0.7888)
    assert got[4].r_reliability == pytest.approx(1.0) and got[4].r_rag == pytest.approx(0.05)
    assert got[6].r_security == 1.0 and not got[6].clipped


def test_copy_guard_boundary(spark):
    df = spark.createDataFrame([(0.95,), (0.951,), (0.5,)], "s double")
    assert [round(r[0], 4) for r in df.select(reward.retrieval("s")).collect()] == [0.095, 0.0, 0.05]
    assert [round(r[0], 4) for r in df.select(reward.retrieval("s", F.lit(0.6))).collect()] == [0.1, 0.0, 0.0]


def test_merge_boosts(spark):
    rows = [("f", 1, "codeql", 5.0, 0.7, 1), ("f", 1, "semgrep", 7.0, 0.6, 2), ("g", 1, "a", None, 0.95, 1), ("g", 1, "b", None, 0.95, 2), ("g", 1, "c", None, 0.95, 3)]
    df = spark.createDataFrame(rows, "file string, line int, tool string, severity double, confidence double, pos int")
    got = {r.file: r for r in findings.merge(df, ["file", "line"], ["tool"], ["pos"]).collect()}
    assert (got["f"].tool, got["f"].severity, round(got["f"].confidence, 4), got["f"].tools) == ("codeql", 7.0, 0.85, ["codeql", "semgrep"])
    assert (got["g"].tool, got["g"].confidence, got["g"].severity) == ("a", 1.0, None)


def test_sarif(spark):
    from tesseral.queries.findings import sarif_flatten

    rows = sarif_flatten(spark, "").collect()
    got = {r.start_line + 100 * r.doc: (r.rule_id, r.cwe, r.confidence) for r in rows}
    assert got == {
        3: ("B602", "CWE-78", 0.8), 5: ("B101", "CWE-703", 0.5), 103: ("py/sql", "CWE-89", 0.8), 110: ("py/odd", "CWE-12X", 0.8), 212: ("nullPointer", "CWE-476", 0.8), 214: ("custom-CWE-22-rule", "CWE-22", 0.5),
        215: ("custom-CWE-23-rule", "CWE-23", 0.9), 216: ("custom-CWE-24-rule", "CWE-24", 1.0), 218: ("own", "CWE-788", 0.8), 219: ("own2", "CWE-22", 0.5), 220: ("twice", "CWE-2", 0.8), 221: ("doubleFree", "CWE-415", 0.8),
        222: ("memleak", "CWE-401", 0.8), 223: ("memleak", "CWE-401", 0.8), 224: ("memleak", "CWE-401", 0.8),
    }
    assert {r.start_line: r.message for r in rows if r.doc == 2 and r.start_line > 21} == {22: "a plain text", 23: '{"text": 1', 24: "5"}
    assert all((r.start_column, r.end_line, r.end_column) == (5, r.start_line + 1, 9) for r in rows)


def test_collapse(spark):
    df = spark.createDataFrame([("a", 1, "CWE-787"), ("a", 1, "CWE-119"), ("a", 2, "CWE-79"), ("a", 2, "CWE-22"), ("a", 3, "CWE-119")], "file string, line int, cwe string")
    got = {(r.line, r.cwe): r.final_cwe for r in findings.collapse_related(df, cwe.closure(spark, cwe.parents_table(spark)), ["file", "line"]).collect()}
    assert got == {(1, "CWE-787"): "CWE-787", (1, "CWE-119"): "CWE-787", (2, "CWE-79"): "CWE-79", (2, "CWE-22"): "CWE-22", (3, "CWE-119"): "CWE-119"}


def test_collapse_over_a_long_chain(spark):
    """A hierarchy deeper than any fixed number of rounds, and a cycle."""
    edges = spark.createDataFrame([(f"N{i:02}", f"N{i + 1:02}") for i in range(40)] + [("X", "Y"), ("Y", "X")], "child string, parent string")
    up = cwe.closure(spark, edges)
    assert up.where("descendant = 'N00'").count() == 40 and up.where("descendant IN ('X', 'Y')").count() == 2
    near = edges.where("child LIKE 'N%'").selectExpr("child AS descendant", "parent AS ancestor", "1 AS depth")
    df = spark.createDataFrame([("a", 1, f"N{i:02}") for i in range(41)], "file string, line int, cwe string")
    assert {r.final_cwe for r in findings.collapse_related(df, near, ["file", "line"]).collect()} == {"N00"}


def test_severity_sources(spark):
    df = spark.createDataFrame([("CWE-79", 6.0, "medium"), ("CWE-79", None, "medium"), ("CWE-1", None, "high")], "cwe string, severity double, tier string")
    got = sorted((r.severity_source, r.sourced) for r in findings.source_severity(df, cwe.medians_table(spark)).collect())
    assert got == [("median", 5.9), ("tier", 7.95), ("tool", 6.0)]


def test_fusion(spark):
    a = spark.createDataFrame([(1, 0, 1), (1, 1, 2), (1, 2, 3), (1, 3, 4)], "query_id long, id long, rank int")
    b = spark.createDataFrame([(1, 3, 1), (1, 0, 2)], "query_id long, id long, rank int")
    got = {r.id: r for r in retrieval.fuse(a, b).collect()}
    assert got[0].rrf == pytest.approx(1 / 61 + 1 / 62) and got[0].rrf > got[3].rrf and got[2].rank_b is None
    best = retrieval.match_or_parent(retrieval.fuse(a, b), "query_id", F.lit(2), F.col("id"), F.lit(0)).first()
    assert (best.id, best.level) == (2, 0)
    parent = retrieval.match_or_parent(retrieval.fuse(a, b), "query_id", F.lit(9), F.col("id"), F.lit(0)).first()
    assert (parent.id, parent.level) == (0, 1)


def test_dense_like_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<float>").repartition(5)
    got = retrieval.dense_top_k(df, "id", "v", [7, 8], x[:2], 5).collect()
    u = x.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    for q, v in ((7, x[0]), (8, x[1])):
        want = np.argsort(-(u @ (v / np.linalg.norm(v))), kind="stable")[:5].tolist()
        assert [r.id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == want


def test_group_statistics(spark):
    rows = [(1, i, r) for i, r in enumerate([1.0, 2.0, 3.0, 6.0])] + [(2, i, 5.0) for i in range(3)] + [(3, 0, 4.0)]
    df = spark.createDataFrame(rows, "g int, i int, r double")
    adv = groups.group_advantage(df, "g", "r").collect()
    assert sum(x.advantage for x in adv if x.g == 1) == pytest.approx(0) and all(x.advantage == 0 and not x.active for x in adv if x.g == 2)
    loo = {(x.g, x.i): x.advantage for x in groups.leave_one_out(df, "g", "r").collect()}
    assert loo[1, 0] == pytest.approx(1 - 11 / 3) and loo[3, 0] == 4.0
    assert [x.i for x in groups.top_k_mask(df, "g", "r", "i", 2).where("selected AND g = 2").orderBy("i").collect()] == [0, 1]
    w = groups.inverse_frequency(df, "g").collect()
    assert np.mean([x.weight for x in w]) == pytest.approx(1)
    with pytest.raises(ValueError):
        groups.inverse_frequency(df, "g", 2)
    assert groups.algorithm("GRPO") is groups.group_advantage
    with pytest.raises(KeyError, match="grpo"):
        groups.algorithm("x")


def test_schedules(spark):
    df = spark.createDataFrame([(0,), (199,), (200,), (900,)], "s int")
    assert [r.phase for r in groups.last_phase(df, "s", [(0, 1.0, 1.0), (200, 2.0, 2.0), (700, 3.0, 3.0)]).orderBy("s").collect()] == [1, 1, 2, 3]
    runs = spark.createDataFrame([("a", i, v) for i, v in enumerate([0.5, 0.9, 0.7, 0.6, 0.95, 0.5, 0.5, 0.5])], "run string, step int, score double")
    got = groups.stop_after_strikes(runs, "run", "step", "score", 10, 3).orderBy("step").collect()
    assert [r.strikes for r in got] == [0, 0, 1, 2, 0, 1, 2, 3] and [r.stopped for r in got] == [False] * 7 + [True]
    assert not groups.warmed_up(runs.withColumn("score", F.lit(0.0)), "run", "step", "score").first().ok


def test_sampling(spark):
    df = spark.range(200).withColumn("cell", F.when(F.col("id") < 12, "a").when(F.col("id") < 14, "b").when(F.col("id") < 15, "c").otherwise("d"))
    held = {r.cell: r.n for r in sampling.stratified_holdout(df, ["cell"], "id", 0.1, 7).where("held_out").groupBy("cell").agg(F.count("*").alias("n")).collect()}
    assert held == {"a": 1, "b": 1, "d": 18}  # 18.5 rounds to even
    assert {r.cell: r.n for r in sampling.cap_per_cell(df, ["cell"], "id", F.when(F.col("cell") == "d", 5).otherwise(0), 1).groupBy("cell").agg(F.count("*").alias("n")).collect()} == {"d": 5}
    assert sampling.split_fraction(df, ["cell"], "id", 0.05).where("split = 'val'").count() == 10  # 1 + 0 + 0 + 9
    assert [r.place for r in sampling.numbered(df, "id").orderBy("id").collect()] == list(range(200))
    one, two = (sampling.with_replacement(spark.range(3, 5).withColumnRenamed("id", "step"), df, "id", 4, 1).orderBy("step", "slot").collect() for _ in range(2))
    assert one == two and len(one) == 8
    assert [r.cell for r in sampling.round_robin(df, "cell", "id", 5).orderBy("turn", "cell").collect()] == ["a", "b", "c", "d", "a"]


def test_dedup(spark):
    df = spark.createDataFrame([(1, "x", "k"), (2, "x", "k"), (3, "y", "k")], "id int, t string, c string")
    assert {r.id for r in dedup.first_wins(df, ["t"], ["id"]).collect()} == {1, 3}
    assert {r.id for r in dedup.last_wins(df, ["t"], "id").collect()} == {2, 3}
    keys = {"a": spark.createDataFrame([("x",)], "key string"), "b": spark.createDataFrame([("y",), (None,)], "key string")}
    got = {r.id: (r.in_a, r.in_b) for r in dedup.flag_overlap(df, {"a": F.col("t"), "b": F.col("t")}, keys).collect()}
    assert got == {1: (True, False), 2: (True, False), 3: (False, True)}
    body = " ".join(f"word{i}" for i in range(80))
    near = spark.createDataFrame([(1, body, "c"), (2, body + " more", "c"), (3, body, "d"), (4, "else", "c")], "id int, t string, c string")
    assert {r.id: r.near_of for r in dedup.near_in_cell(near, ["c"], "id", "t").collect()} == {1: None, 2: 1, 3: None, 4: None}
    p = spark.createDataFrame([(7, "b c d"), (8, "zz")], "p int, pt string")
    t = spark.createDataFrame([(1, "a b c d e"), (2, "b c x"), (3, None)], "d int, dt string")
    assert [(r.d, r.p) for r in dedup.passages_in(t, "d", "dt", p, "p", "pt").collect()] == [(1, 7)]


def test_quota(spark):
    df = spark.createDataFrame([(300, 100), (9, 5), (0, 0)], "real long, synth long")
    got = corpus.quota(df, "real", "synth").collect()
    assert [(r.take_real, r.take_synth, r.deficit, r.val) for r in got] == [(200, 22, 0, 11), (9, 1, 10, 1), (0, 0, 20, 0)]


def test_rank_statistics(spark):
    df = spark.createDataFrame([("a", 1.0, True), ("a", 1.0, False), ("b", 2.0, True), ("b", 1.0, False), ("c", 1.0, True)], "g string, s double, p boolean")
    assert {r.g: r.auc for r in stats.auc(df, ["g"], "s", "p").collect()} == {"a": 0.5, "b": 1.0, "c": None}
    tests = spark.createDataFrame([(1, 0.01), (2, 0.04), (3, 0.03), (4, 0.5)], "i int, p double")
    assert [round(r.q, 6) for r in stats.benjamini_hochberg(tests, "p", ["i"]).orderBy("i").collect()] == [0.04, 0.053333, 0.053333, 0.5]
    v = spark.createDataFrame([("a", x) for x in (10.0, 9.5, 4.0, 3.9)] + [("b", 1.0), ("b", 2.0)], "g string, v double")
    assert {r.g: r.elbow for r in stats.elbow(v, ["g"], "v", "v").collect()} == {"a": 6.75, "b": None}
    ci = stats.bootstrap(spark.createDataFrame([("a", 34, 156), ("z", 0, 0)], "g string, k long, n long"), ["g"], "k", "n").collect()
    assert ci[0].ci_lo < 34 / 156 < ci[0].ci_hi and (ci[1].ci_lo, ci[1].ci_hi) == (0, 0)


def test_rates_of_nothing(spark):
    empty = spark.createDataFrame([], "ok boolean, g string")
    got = metrics.conditional_rates(empty, {"m": (F.col("ok"), F.lit(True))}).collect()
    assert [(r.metric, r.value, r.n_den) for r in got] == [("m", 0.0, 0)]
    v = spark.createDataFrame([(x,) for x in range(1, 21)], "x int")
    assert metrics.index_percentile(v, [], "x", 0.95, "p").first().p == 19


def test_near_in_cell_compares_all_of_a_bucket(spark):
    common, one, two = (" ".join(f"{p}{i}" for i in range(n)) for p, n in (("shared", 60), ("left", 40), ("right", 40)))
    rows = [(1, f"{common} {one}", "c"), (2, f"{common} {two}", "c"), (3, f"{common} {two} more", "c"), (4, f"{common} {two} more", "c"), (5, f"{common} {two}", "d")]
    df = spark.createDataFrame(rows, "id int, t string, c string")
    got = dedup.near_in_cell(df, ["c"], "id", "t", seeds=1, band=1)  # one bucket, whose first row is close to none
    assert {r.id: r.near_of for r in got.collect()} == {1: None, 2: None, 3: 2, 4: 2, 5: None}


def test_near_in_cell_reads_the_order_and_not_the_case(spark):
    common, words = " ".join(f"shared{i}" for i in range(60)), [f"word{i}" for i in range(60)]
    rows = [(1, f"{common} {' '.join(words)}"), (2, f"{common} {' '.join(reversed(words))}"), (3, f"{common}  {' '.join(words)}\n".upper())]
    df = spark.createDataFrame(rows, "id int, t string").withColumn("c", F.lit("c"))
    assert {r.id: r.near_of for r in dedup.near_in_cell(df, ["c"], "id", "t", seeds=1, band=1).collect()} == {1: None, 2: None, 3: 1}


def test_close_texts():
    from tesseral.functions import code

    assert code.close_texts("", "", 0.85) and not code.close_texts("", "a", 0.85)
    assert code.close_texts("abcdefgh" * 20, "abcdefgh" * 20 + "x" * 56, 0.85) and not code.close_texts("abcdefgh" * 20, "abcdefgh" * 20 + "x" * 57, 0.85)
    assert not code.close_texts("ab" * 50, "a" * 50 + "b" * 50, 0.85)


def test_disjointness_reads_whole_texts(spark, tmp_path):
    from tesseral.queries import QUERIES

    opening, item = "the same licence header stands before every text", "def f(a, b):\n    return a + b\n"
    docs = [("a", f"{opening} but another body"), ("a", f"{opening}, and ITS body"), ("b", "def g(x, y):\n    return x + y\n"), ("b", "!!"), ("b", None)]
    spark.createDataFrame(docs, "source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(f"{opening} and its body",), (item,), ("??",)], "text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([("nothing of it",)], "text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.source: (r.string_only, r.shape_only, r.both, r.kept) for r in QUERIES["disjointness_whole"](spark, str(tmp_path)).collect()}
    assert got == {"a": (0, 1, 0, 1), "b": (0, 1, 0, 2)}


def test_leaks_in_cell_like_brute_force(spark):
    import random

    from tesseral.functions.code import similarity

    r = random.Random(2)
    base = ["".join(r.choice("abcd ") for _ in range(60)) for _ in range(12)]
    edit = lambda t, n: "".join(r.choice("wxyz") if i in at else c for at in [set(r.sample(range(60), n))] for i, c in enumerate(t))
    rows = [(i, "u" if i % 3 else None, edit(base[i % 11], r.randrange(0, 16))) for i in range(90)] + [(200, "u", None), (201, "v", base[0])]
    df = spark.createDataFrame(rows, "id long, cell string, t string")
    got = {x.id: x.leak_of for x in dedup.leaks_in_cell(df.where("id % 4 = 0"), df.where("id % 4 <> 0"), ["cell"], "id", "t", block=5).collect()}
    want = {i: min((j for j, d, u in rows if j % 4 and d == c and t is not None and u is not None and similarity(t, u) >= 0.85), default=None) for i, c, t in rows if i % 4 == 0}
    assert got == want and sum(v is not None for v in want.values()) > 3
    assert dedup.leaks_in_cell(df.limit(0), df, ["cell"], "id", "t").count() == 0


def test_similarity_is_the_common_subsequence():
    import difflib

    from tesseral.functions.code import similarity

    assert similarity("", None) == 1 and similarity("abc", "") == 0 and similarity("abcd", "abxd") == 0.75
    assert similarity("ab" * 5000, "ab" * 5000 + "c") > 0.9999
    for a, b in (("kitten sitting", "sitting kitten"), ("abcbdab", "bdcaba")):
        assert similarity(a, b) >= difflib.SequenceMatcher(None, a, b).ratio()


def test_passages_of_any_length(spark):
    texts = [(1, "hello world secret here"), (2, "(one two three four)."), (3, "xsecretx"), (4, ""), (5, None), (6, "alpha  beta gamma"), (7, "pre-alpha beta\tgamma!")]
    asked = [(1, "secret"), (2, "two three"), (3, "one two three four"), (4, ""), (5, "alpha beta"), (6, "hello world secret here"), (7, "ecret"), (8, None), (9, "alpha beta\tgamma")]
    t, p = spark.createDataFrame(texts, "d long, dt string"), spark.createDataFrame(asked, "p long, pt string")
    got = {(x.d, x.p) for x in dedup.passages_in(t, "d", "dt", p, "p", "pt").collect()}
    assert got == {(d, q) for d, a in texts for q, b in asked if a and b and b in a}


def test_ranks_over_spans_like_one_window(spark, monkeypatch):
    import random

    from pyspark.sql import Window

    monkeypatch.setattr(sampling, "SPAN_ROWS", 20)
    r = random.Random(1)
    df = spark.createDataFrame([(i, r.choice(["a", "b", None]), r.choice([r.random(), 0.5, 1.0])) for i in range(400)], "id long, c string, p double")
    w = Window.partitionBy("c").orderBy("p", "id")
    want = {x.id: (x.k, x.n) for x in df.select("id", F.row_number().over(w).alias("k"), F.count("*").over(Window.partitionBy("c")).alias("n")).collect()}
    assert {x.id: (x._rank, x._n) for x in sampling.ranked(df, ["c"], ["p", "id"]).collect()} == want
    assert sampling.ranked(df, [], ["p", "id"]).select("_span").distinct().count() > 3
    q = {x.id: (x.rank, x.q) for x in stats.benjamini_hochberg(df.select("id", "p"), "p", ["id"]).collect()}
    rows = sorted(df.select("p", "id").collect())
    least, expected = 1.0, {}
    for k in range(len(rows), 0, -1):
        least = min(least, rows[k - 1].p * len(rows) / k)
        expected[rows[k - 1].id] = (k, least)
    assert {i: (k, round(v, 12)) for i, (k, v) in q.items()} == {i: (k, round(v, 12)) for i, (k, v) in expected.items()}
    assert sorted(x.place for x in sampling.numbered(df, "id").collect()) == list(range(400))
    assert sampling.ranked(df.limit(0), ["c"], ["id"]).count() == 0


def test_bm25_of_the_asked_terms_only(spark):
    docs = spark.createDataFrame([(1, "a b c a"), (2, "b c d"), (3, "x y"), (4, "")], "id long, t string")
    asked = spark.createDataFrame([(1, "a d z"), (2, "c c")], "q long, t string")
    tokens = F.filter(F.split("t", " "), lambda x: x != "")
    whole, figures = retrieval.index_postings(docs, "id", tokens)
    few, same = retrieval.index_postings(docs, "id", tokens, retrieval.query_terms(asked, "q", tokens))
    assert figures.first() == same.first() and {x.term for x in few.collect()} == {"a", "c", "d"}
    assert sorted(retrieval.bm25(asked, "q", tokens, whole, figures).collect()) == sorted(retrieval.bm25(asked, "q", tokens, few, same).collect())


def test_closest_texts(spark):
    from tesseral.functions import text

    docs = spark.createDataFrame([(1, "def f(a): return a + 1"), (2, "def g(b):  return b + 1 # x"), (3, "quite other words")], "id long, text string")
    asked = spark.createDataFrame([(7, "def f(a): return a + 1"), (8, "nothing alike"), (9, "other words here")], "query_id long, text string")
    got = {x.query_id: x for x in retrieval.closest_texts(asked, "query_id", docs, "id", "text", text.retrieval_tokens("text"), text.string_normalize("text"), 5).collect()}
    assert set(got) == {7, 9} and got[7].best == 1 and got[7].nearest == 1 and got[7].best_ast == 1 and got[9].nearest == 3 and got[9].best_ast is None


def test_bm25_top_k_like_all_scores(spark, monkeypatch):
    """The same first documents as by scores of all pairs, in blocks of queries; no row for each query and document is shuffled."""
    r = random.Random(3)
    texts = [" ".join(r.choice("abcdefghij") * r.randrange(1, 4) for _ in range(r.randrange(0, 30))) for _ in range(200)]
    texts += texts[:40] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(5)
    asked = docs.where("id % 10 = 0").withColumnRenamed("id", "q")
    tokens = F.filter(F.split("text", " "), lambda x: x != "")
    monkeypatch.setattr(retrieval, "QUERIES", 9)
    monkeypatch.setattr(retrieval, "DENSE", 3)
    whole, figures = retrieval.index_postings(docs, "id", tokens)
    want = {(x.q, x.id, round(x.score, 6), x.rank) for x in retrieval.top_k(retrieval.bm25(asked, "q", tokens, whole, figures), "q", 5).collect()}
    got = retrieval.bm25_top_k(docs, "id", asked, "q", tokens, 5)
    assert {(x.query_id, x.id, round(x.score, 6), x.rank) for x in got.collect()} == want


def test_penalties_in_any_order(spark):
    """A sum of doubles depends on their order; the rows' order decides nothing."""
    parts, sums = [0.1, 0.2, 0.3, 0.4, 0.7], set()
    for order in (parts, parts[::-1], [0.7, 0.1, 0.4, 0.2, 0.3], [0.3, 0.7, 0.2, 0.1, 0.4]):
        f = spark.createDataFrame([(1, 10.0, x) for x in order], "id long, severity double, confidence double").coalesce(1)
        sums.add(reward.penalties(f, "id").first()["penalty"])
    assert len(sums) == 1 and len({functools.reduce(operator.add, o) for o in itertools.permutations(parts)}) > 1
    odd = spark.createDataFrame([(2, None, 1.0), (3, 5.0, 0.5)], "id long, severity double, confidence double")
    assert {r.id: r.penalty for r in reward.penalties(odd, "id").collect()} == {2: None, 3: 0.25}
