"""Queries that SQL cannot express, against plain Python over the smallest tables."""

import ast
import hashlib
import math
import os
import re
from collections import Counter

import numpy as np
import pytest

from tesseral import queries as reference
from tesseral.functions.code import similarity

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


def rows(spark, name):
    return reference.QUERIES[name](spark, SF).collect()


@pytest.fixture(scope="module")
def turns(spark):
    from tesseral.queries.corpus import completions

    return {(r.conv_id, r.turn): (r.completion, r.language) for r in completions(spark, SF).collect()}


def fenced(text):
    found = [m.strip() for m in re.findall(r"```(?:python|py|cpp|c\+\+|c)?[ \t]*\n(.*?)```", text, re.S)]
    if found:
        return "\n\n".join(found)
    tail = re.search(r"```(?:python|py|cpp|c\+\+|c)?[ \t]*\n(.*)$", text, re.S)
    return re.sub(r"\s*(```)?\s*$", "", tail.group(1)) if tail else text


def parsed(text):
    try:
        return ast.parse(text)
    except (SyntaxError, ValueError):
        return None


def test_mcnemar_p_values(spark):
    got = rows(spark, "mcnemar_pvalue")
    tail = lambda x: math.erfc(math.sqrt(x / 2))
    p = {r.source: tail((abs(r.only_off - r.only_on) - 1) ** 2 / (r.only_off + r.only_on)) if r.only_off + r.only_on else 1.0 for r in got}
    order = sorted(p, key=lambda s: (p[s], s))
    least, q = 1.0, {}
    for k in range(len(order), 0, -1):
        least = q[order[k - 1]] = min(least, p[order[k - 1]] * len(order) / k)
    for r in got:
        assert r.p == pytest.approx(p[r.source], abs=2e-6) and r.q == pytest.approx(q[r.source], abs=2e-6)


def test_bootstrap_intervals_near_the_normal_ones(spark):
    from tesseral.operators import stats

    counts = spark.createDataFrame([("a", 34, 156), ("b", 400, 1000), ("c", 20, 20)], "source string, n_num long, n_den long")
    for r in stats.bootstrap(counts, ["source"], "n_num", "n_den", draws=4000).collect():
        rate = r.n_num / r.n_den
        half = 1.96 * math.sqrt(rate * (1 - rate) / r.n_den)
        assert abs(r.ci_lo - (rate - half)) < 0.012 and abs(r.ci_hi - (rate + half)) < 0.012


def test_syntax_and_patterns(spark, turns):
    assert {(r.conv_id, r.turn): r.parses for r in rows(spark, "python_syntax_flag")} == {k: parsed(fenced(c)) is not None for k, (c, _) in turns.items()}
    norm = lambda t: re.sub(r"\s+", " ", re.sub(r"#[^\n]*", "", re.sub(r"//[^\n]*", "", re.sub(r"(?s)/\*.*?\*/", " ", t)))).strip().lower()
    seen = {}
    for r in rows(spark, "pattern_key_mixed"):
        completion, language = turns[r.conv_id, r.turn]
        code = fenced(completion)
        assert r.balanced == (abs(code.count("}") - code.count("{")) <= 2)
        if language != "python" or parsed(code) is None:
            assert r.pattern == hashlib.sha256(norm(code).encode()).hexdigest()
        else:
            seen.setdefault(r.pattern, set()).add(Counter(type(n).__name__ for n in ast.walk(parsed(code))).total())
    assert all(len(sizes) == 1 for sizes in seen.values())


def test_brace_walks(spark, turns):
    for r in rows(spark, "brace_walk_cut"):
        text = turns[r.conv_id, r.turn][0]
        body, depth = None, 0
        if "{" in text:
            for i in range(text.index("{"), len(text)):
                depth += {"{": 1, "}": -1}.get(text[i], 0)
                if not depth:
                    body = text[text.index("{") : i + 1]
                    break
        assert r.body == body
        cuts = {hashlib.md5(text[:i].encode()).hexdigest() for i in range(len(text) + 1) if i == len(text) or text[i - 1 : i] == "}"}
        assert r.cut_md5 in cuts


def test_tree_overlap_and_ratio(spark, turns):
    def overlap(a, b):
        x, y = (Counter(type(n).__name__ for n in ast.walk(parsed(t))) if parsed(t) is not None else Counter() for t in (a, b))
        return (x & y).total() / (x | y).total() if x | y else 0.0

    def common(a, b):
        row = np.zeros(len(b) + 1, int)
        for c in a:
            new = row.copy()
            for j, d in enumerate(b, 1):
                new[j] = row[j - 1] + 1 if c == d else max(row[j], new[j - 1])
            row = new
        return 2 * int(row[-1]) / (len(a) + len(b)) if a or b else 1.0

    first = {}
    for conv, turn in sorted(turns):
        first.setdefault(conv, fenced(turns[conv, turn][0]))
    checked = 0
    for r in rows(spark, "ast_multiset_jaccard"):
        a, b = fenced(turns[r.conv_id, r.turn][0]), first[r.conv_id]
        assert r.ast == pytest.approx(overlap(a, b), abs=1e-6)
        if len(a) * len(b) < 20_000 and checked < 25:
            checked += 1
            assert r.ratio == pytest.approx(common(a, b), abs=1e-6)
    assert checked > 5


def test_hash_vectors(spark):
    texts = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    for r in rows(spark, "hash_embedding_vectors"):
        v = np.array([b / 255 for b in hashlib.sha256(texts[r.item_id].encode()).digest()][: len(r.vector)])
        assert np.allclose(r.vector, v / np.linalg.norm(v))


def test_near_duplicates_recall(spark):
    """All rows with a close text before them in the cell, by brute force; and none that has no such text."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "lang", "text").where("text IS NOT NULL").collect()
    cells = {}
    for r in sorted(docs):
        cells.setdefault((r.source, r.lang), []).append((r.doc_id, re.sub(r"\s+", " ", r.text).strip().lower()))
    want = {}
    for group in cells.values():
        for i, (d, t) in enumerate(group):
            for e, u in group[:i]:
                if min(len(t), len(u)) >= 0.73 * max(len(t), len(u)) and re.search(r"\w", t) and (Counter(t) & Counter(u)).total() * 2 >= 0.85 * (len(t) + len(u)) and similarity(t, u) >= 0.85:
                    want.setdefault(d, set()).add(e)
    got = {r.doc_id: r.near_of for r in rows(spark, "near_dup_cell") if r.near_of is not None}
    assert all(got[d] in want.get(d, ()) for d in got)
    assert len(got) >= 0.9 * len(want)
