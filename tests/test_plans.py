import hashlib
import random
import re

from pyspark.sql import functions as F

from tesseral.functions import code
from tesseral.operators import corpus
from tesseral.plans.reports import build_corpus, evaluation_report
from tesseral.queries import corpus as corpus_queries
from tesseral.sources.readers import PAIR, PROMPT


def test_corpus_build(spark):
    row = lambda i, body, weak="CWE-787", lang="c": (i, "s", lang, weak, body, None, None, {})
    train = spark.createDataFrame([row(f"t{i:03}", f"text {i}") for i in range(40)] + [row("dup", "text  1 // note"), row("out", "x", "CWE-787", "python"), row("leak", "Held out")], PROMPT)
    held = spark.createDataFrame([row("e1", "held out")], PROMPT)
    built = build_corpus([train], [held], 30, "v1", near=None, leak=None)
    ids = {name: {r.id for r in built[name].collect()} for name in ("train", "val", "eval")}
    assert [r.step for r in built["manifest"].orderBy("place").collect()] == ["eval", "scope", "exact", "cap", "disjoint", "train", "val"]
    assert len(ids["train"] | ids["val"]) in (29, 30) and len(ids["val"]) in (1, 2) and not ids["train"] & ids["val"]
    assert "out" not in ids["train"] and "leak" not in ids["train"] | ids["val"] and ids["eval"] == {"e1"}
    assert all(r.prompt_text.startswith("Implement the following C task.") and r.metadata["prompt_text_pre_normalize"] in r.prompt_text for r in built["train"].collect())


def brute_build(train, held, pairs, cap, seed):
    """The build's rows by loops over few prompts, near pass aside."""
    norm = lambda t: re.sub(r"\s+", " ", re.sub(r"#[^\n]*|//[^\n]*", "", re.sub(r"(?s)/\*.*?\*/", " ", t))).strip().lower()
    seen, cells = set(), {}
    for p in sorted(train):
        if (p[1], norm(p[2])) not in seen:
            seen.add((p[1], norm(p[2])))
            cells.setdefault(p[1], []).append(p)
    taken = {norm(t) for t in held}
    out, val = set(), set()
    for group in cells.values():
        chosen = sorted(group, key=lambda p: (hashlib.sha256(f"{seed}|{p[0]}".encode()).hexdigest(), p[0]))[:cap]
        rows = sorted(p for p in chosen if norm(p[2]) not in taken)
        n = int(len(rows) * 0.2 + 0.5)
        out |= {p[0] for p in rows[n:]}
        val |= {p[0] for p in rows[:n] if not any(code.similarity(p[2], q[2]) >= 0.85 for q in rows[n:])}
    return out, val, {(a, b) for a, b in pairs if norm(a) not in taken and norm(b) not in taken}


def test_corpus_build_like_brute_force(spark):
    r = random.Random(4)
    body = lambda: " ".join(f"w{r.randrange(40)}" for _ in range(12))
    texts = [body() for _ in range(60)]
    texts += [t + " more" for t in texts[:15]] + [t.upper() + " // x" for t in texts[20:25]]
    train = [(f"t{i:03}", ("CWE-787", "c") if i % 2 else ("CWE-22", "python"), t) for i, t in enumerate(texts)]
    held = [texts[30].upper(), texts[31] + "  /* note */", "other"]
    pairs = [(texts[30], "bad"), ("good", texts[40]), ("x", texts[31]), ("fine", "worse")]
    frame = spark.createDataFrame([(i, "s", lang, weak, t, None, None, {}) for i, (weak, lang), t in train], PROMPT)
    evaluation = spark.createDataFrame([(f"e{i}", "e", "c", "CWE-787", t, None, None, {}) for i, t in enumerate(held)], PROMPT)
    exemplars = spark.createDataFrame([("CWE-787", None, a, b, "c", "p", None, None, {}) for a, b in pairs], PAIR)
    got = build_corpus([frame], [evaluation], 25, "v1", 0.2, [exemplars], exemplars, 1, near=None)
    out, val, left = brute_build(train, held, pairs, 25, "v1")
    assert {x.id for x in got["train"].collect()} == out and {x.id for x in got["val"].collect()} == val
    assert {(x.e_pos, x.e_neg) for x in got["pairs"].collect()} == left
    steps = {x.step: x.n for x in got["manifest"].collect()}
    assert list(steps)[:2] == ["eval", "scope"] and steps["train"] == len(out) and steps["val"] > steps["val_without_leaks"] == len(val) and steps["synthetic_cap"] == 1


def test_normalizer_toggles(spark):
    rows = [("1", "s", "c", "CWE-787", "Write it. Return only code.", None, None, {"a": "b"}), ("2", "s", "c", "CWE-787", "a queue", None, None, None)]
    df = spark.createDataFrame(rows, PROMPT)
    plain = {r.id: r for r in corpus.normalized_prompts(df).collect()}
    assert plain["1"].prompt_text == rows[0][4] and plain["1"].metadata == {"a": "b", "prompt_normalize_applied": "false", "prompt_normalize_version": corpus.NORMALIZER}
    assert plain["2"].metadata["prompt_normalize_applied"] == "true" and plain["2"].metadata["prompt_text_pre_normalize"] == "a queue"
    forced = {r.id: r for r in corpus.normalized_prompts(df, False, False, False).collect()}
    assert forced["1"].prompt_text.startswith("Implement the following C task.") and forced["1"].metadata == {"a": "b"}


def test_report(spark):
    rows = [("CWE-79", "c", True, False, False, False, 1, 1, 1), ("CWE-79", "c", False, False, False, True, 0, 0, 1), ("CWE-89", "python", True, True, False, False, 0, 1, 1)]
    r = spark.createDataFrame(rows, "target_cwe string, language string, compiles boolean, refusal boolean, crashed boolean, target_cwe_present boolean, tests_passed int, tests_total int, n_test_cases int")
    out = evaluation_report(r, F.lit(False), F.lit(None).cast("double"))
    got = {(x.target_cwe, x.language, x.metric): x.value for x in out["rates"].collect()}
    assert got[None, None, "compile_at_1"] == 1 / 3 and got["CWE-79", None, "compile_at_1"] == 0.5 and got["CWE-79", "c", "func_sec_at_1"] == 0.5
    assert out["diagnostics"].first().n == 3


def test_corpus_build_keeps_its_plans_short(spark):
    """The driver describes each plan it runs; a plan that holds those of all steps before it is too large for its memory."""
    frame = spark.createDataFrame([(f"t{i:03}", "s", "c", "CWE-787", f"text {i} " * 9, None, None, {}) for i in range(30)], PROMPT)
    held = spark.createDataFrame([("e", "e", "c", "CWE-787", "held out", None, None, {})], PROMPT)
    got = build_corpus([frame], [held], 25, "v1", 0.2)
    for name, df in got.items():
        assert len(df._jdf.queryExecution().toString()) < 100_000, name
    assert got["train"].count() + got["val"].count() <= 25 and len(got["manifest"].collect()) == 9


def test_corpus_build_steps_keep_texts_apart_that_parse_alike(spark, duck_over, tmp_path):
    """Two words are two texts, though both are one name to Python's parser; the SQL has no parser."""
    docs = [(0, "alpha"), (15, "beta"), (30, "Alpha  # again"), (3, "x = 1"), (18, "y = 1"), (1, "other words"), (7, "beta")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(2, "gamma")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {tuple(r) for r in corpus_queries.corpus_build_steps(spark, str(tmp_path)).select("place", "step", "n").collect()}
    assert got == set(duck_over(str(tmp_path), corpus_queries.R.oracles["corpus_build_steps"], "place, step, n"))
