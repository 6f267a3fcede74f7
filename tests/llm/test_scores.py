"""Classifier, language and rule operators: held-out accuracy, brute force, edge cases."""

import os
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest

from tesseral.llm import kernels as K
from tesseral.llm import language_id, quality_nbsvm, quality_rules


def words_of(letters, seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice(letters) for _ in range(r.randrange(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def labelled(spark):
    rows, labels = [], []
    for i in range(300):
        good = i % 4 != 0
        text = words_of("abcde", i, 60) if good else " ".join(w + "%%%" for w in words_of("abcde", i, 60).split())
        rows.append((i, text))
        labels.append((i, int(good), 0))
    rows += [(1000, None), (1001, ""), (None, "abc"), (1002, "der " * 300), (1003, "x" * 100_000)]
    labels += [(2000, 1, 0), (1000, None, None), (None, 1, 0), (5, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_held_out(labelled):
    docs, labels = labelled
    model = quality_nbsvm.fit(docs, labels)
    got = {r.doc_id: r for r in quality_nbsvm.score(docs, model).collect()}
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    held = [i for i in range(300) if crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i].predicted == int(i % 4 != 0) for i in held]) > 0.95
    assert got[1000].score == got[1001].score
    again = quality_nbsvm.fit(docs.repartition(5), labels.repartition(3))
    assert np.array_equal(model.weights, again.weights)


def test_quality_learns_nothing_from_held_out_rows(spark, labelled):
    docs, labels = labelled
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(cast(doc_id AS string) AS binary)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality", "toxic")
    assert np.array_equal(quality_nbsvm.fit(docs, labels).weights, quality_nbsvm.fit(docs, flipped).weights)


def test_quality_edges(spark, labelled):
    docs, labels = labelled
    none = labels.where("quality = 7")
    assert {round(r.score, 6) for r in quality_nbsvm.score(docs, quality_nbsvm.fit(docs, none)).collect()} == {0.5}
    assert quality_nbsvm.score(docs.limit(0), quality_nbsvm.fit(docs.limit(0), labels)).count() == 0
    clash = docs.selectExpr("*", "1 AS y", "2 AS id", "3 AS score", "4 AS grams")
    model = quality_nbsvm.fit(clash, labels)
    assert quality_nbsvm.keep_good(clash, model).columns == clash.columns


def test_descent_reaches_the_dual_optimum():
    """The primal and dual objectives meet."""
    rng = np.random.default_rng(1)
    rows = [np.sort(rng.choice(30, 8, replace=False)) for _ in range(40)]
    y = np.where(rng.random(40) < 0.5, 1.0, -1.0)
    scale = rng.normal(size=quality_nbsvm.SIZE)
    w, b = quality_nbsvm.descend(rows, scale, y, np.full(40, 0.5), 400, 0)
    x = np.zeros((40, quality_nbsvm.SIZE))
    for i, r in enumerate(rows):
        x[i, r] = scale[r] / np.sqrt(len(r))
    full = np.append(w, b)
    hinge = np.maximum(0, 1 - y * (x @ w + b))
    primal = full @ full / 2 + 0.5 * hinge.sum()
    grad_small = [primal <= (v @ v / 2 + 0.5 * np.maximum(0, 1 - y * (x @ v[:-1] + v[-1])).sum()) + 1e-3 for v in (full + rng.normal(scale=0.01, size=full.shape) for _ in range(20))]
    assert all(grad_small)


def brute_probability(word, table):
    """Sum over all segmentations of the product of the pieces' probabilities."""
    if not word:
        return 1.0
    return sum(p * brute_probability(word[len(piece) :], table) for piece, p in table.items() if word.startswith(piece))


def test_forward_sums_all_segmentations():
    pieces = sorted({b"a", b"b", b"ab", b"ba", b"aba", b" ", b" a", b" ab", b"bb"})
    rng = np.random.default_rng(0)
    p = np.vstack([rng.random((len(pieces), 2)), np.zeros((1, 2))])
    model = language_id.Model(pieces, ["x", "y"], p, np.zeros(2))
    words = [b" abab", b" ba", b" bbbbab", b" a"]
    got = model.word_scores(words)
    for w, row in zip(words, got, strict=True):
        for lang in range(2):
            assert np.isclose(row[lang], np.log(brute_probability(w, {x: p[i, lang] for i, x in enumerate(pieces)})))


def test_expected_counts_are_derivatives():
    """p * d log P / d p is the mean use of a piece."""
    pieces = sorted({b"a", b"b", b"ab", b" "})
    p = np.vstack([np.random.default_rng(2).random((len(pieces), 1)), np.zeros((1, 1))])
    model = language_id.Model(pieces, ["x"], p, np.zeros(1))
    own, starts, sizes, found = next(model.groups([b" abab"]))
    used = model.expected(starts, sizes, found, np.array([[1.0]]))
    for i in range(len(pieces)):
        moved = p.copy()
        moved[i] *= 1 + 1e-6
        change = language_id.Model(pieces, ["x"], moved, np.zeros(1)).word_scores([b" abab"]) - model.word_scores([b" abab"])
        assert np.isclose(used[i, 0], change[0, 0] / 1e-6, atol=1e-4)


def test_language_held_out(spark):
    letters = {"aa": "abcdef", "bb": "cdefgh", "cc": "éàxyz"}
    rows = [(i, words_of(letters[lang], i, 40), lang) for i in range(240) for lang in [sorted(letters)[i % 3]]]
    rows += [(1000, None, "aa"), (1001, "12 34 !!", "aa"), (1002, "", None), (None, "abc", "aa"), (1003, "a" * 5000, None), (1004, "ABCDEF abc", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(docs)
    got = {r.doc_id: r for r in language_id.predict(docs.selectExpr("*", "1 AS n", "2 AS word", "3 AS score"), model).collect()}
    held = [i for i in range(240) if crc32(str(i).encode()) % 4 == 2]
    assert len(held) > 30 and np.mean([got[i].lang_pred == sorted(letters)[i % 3] for i in held]) > 0.95
    assert {got[i].lang_pred for i in (1000, 1001, 1002)} == {"und"} and got[1000].score == 0
    assert all(0 <= r.score <= 1 for r in got.values()) and got[1004].lang_pred in letters
    assert language_id.predict(docs.limit(0), model).count() == 0
    nothing = language_id.fit(docs.where("lang IS NULL"))
    assert {r.lang_pred for r in language_id.predict(docs, nothing).collect()} == {"und"}


def test_long_runs_keep_every_character():
    """Runs of over 40 bytes in scripts of one to four bytes a character, at the real limit."""
    for letters in ("abcde", "éàüñ", "語言識別模型", "𝒳𝒴𝒵", "aé語𝒳"):
        r = random.Random(len(letters))
        for n in (1, 13, 30, 41, 200, 5000):
            text = "".join(r.choice(letters) for _ in range(n))
            data, offsets = K.flat(pa.array([text, None, "x" + text, text + " y"]))
            starts, ends, bounds = language_id.spans(data, offsets)
            raw = data.tobytes()
            for row, whole in ((0, text), (2, "x" + text), (3, text + "y")):
                parts = [raw[starts[i] : ends[i]] for i in range(bounds[row], bounds[row + 1])]
                assert "".join(p.decode() for p in parts) == whole and max(map(len, parts)) <= language_id.MAX_WORD + 3
            assert bounds[1] == bounds[2]


def rule_counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    three = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = Counter(three)
    repeated = {i + k for i, x in enumerate(three) if often[x] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeated)


def test_rules_like_brute_force(docs, rows, spark):
    extra = ["a b\n\na b\n a b\na b", "\n\n\n", "x", "a b c a b c a b c", "# * $ | <>", "é é é é é\né é é é é"]
    more = [*rows, *[(500 + i, t, "en", "s", len(t)) for i, t in enumerate(extra)]]
    df = spark.createDataFrame(more, docs.schema)
    labels = spark.createDataFrame([(0, 1), (3, 1), (4, 0), (None, 1), (5, None)], "doc_id long, quality int")
    ratio = quality_rules.fit(df, labels)
    got = quality_rules.judge(df, ratio).collect()
    assert len(got) == len(more)
    want = sorted(str((r[0], *rule_counts(r[1]))) for r in more)
    assert sorted(str((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed and r.score >= ratio.threshold)


def test_ratio_like_brute_force(spark):
    texts = [(i, words_of("abcdef", i, 20)) for i in range(12)] + [(20, None), (21, "ab")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 5)) for i in range(12)], "doc_id long, quality int")
    ratio = quality_rules.fit(df, labels)

    def grams(text):
        data = np.frombuffer((text or "").encode(), np.uint8)
        return quality_rules.buckets(data, 4)

    raw, target = np.full(quality_rules.SIZE, 0.5), np.full(quality_rules.SIZE, 0.5)
    for i, t in texts:
        np.add.at(raw, grams(t), 1)
        if i < 5:
            np.add.at(target, grams(t), 1)
    weights = np.log(target / target.sum()) - np.log(raw / raw.sum())
    got = {r.doc_id: r.score for r in quality_rules.judge(df, ratio).collect()}
    for i, t in texts:
        g = grams(t)
        assert np.isclose(got[i], weights[g].mean() if len(g) else 0.0)


def test_rules_without_trusted_rows(spark):
    df = spark.createDataFrame([(1, "word " * 10 + words_of("abc", 1, 80)), (2, "x")], "doc_id long, text string")
    ratio = quality_rules.fit(df, spark.createDataFrame([], "doc_id long, quality int"))
    assert all(r.kept == (not r.base_failed) for r in quality_rules.judge(df, ratio).collect())
    assert quality_rules.judge(df.limit(0), ratio).count() == 0


def test_rules_fit_on_all_trusted_rows(spark):
    """No number of trusted rows is too high for the counts and the threshold to be of all of them."""
    df = spark.range(0, 30_000, 1, 3).selectExpr("id AS doc_id", "concat_ws(' ', 'all', md5(cast(id AS string)), if(id % 7 = 0, repeat('x', 20), '')) AS text")
    labels = spark.range(0, 30_000, 1, 2).selectExpr("id AS doc_id", "int(id % 10 > 0) AS quality").unionAll(spark.createDataFrame([(None, 1), (3, 0), (8, None), (90_000, 1)], "doc_id long, quality int"))
    ratio = quality_rules.fit(df, labels)
    texts = dict(df.collect())
    good = [i for i in texts if i % 10 and i != 3]
    assert len(good) > 20_000

    def counts(ids):
        data = [quality_rules.buckets(np.frombuffer(texts[i].encode(), np.uint8), 4) for i in ids]
        return np.bincount(np.concatenate(data), minlength=quality_rules.SIZE) + 0.5

    raw, target = counts(texts), counts(good)
    assert np.allclose(ratio.weights, np.log(target / target.sum()) - np.log(raw / raw.sum()), rtol=0, atol=1e-9)
    scores = [r.score for r in quality_rules.judge(df, ratio).collect() if r.doc_id in set(good)]
    low = np.quantile(scores, quality_rules.REFUSED)
    assert np.isclose(ratio.threshold, low - quality_rules.MARGIN * (np.median(scores) - low), rtol=1e-9)
    assert np.array_equal(quality_rules.fit(df.repartition(5, "text"), labels.repartition(3)).weights, ratio.weights)


def test_quantiles_like_numpy(spark):
    r = np.random.default_rng(3)
    for values in ([-0.25], [2.0, -1.0], [0.0] * 5, r.normal(size=1000), np.round(r.normal(size=3000), 1), r.normal(size=200) * 1e-300, [-1e308, 1e308, 0.5, -0.0, 5e-324]):
        values = np.array(values, np.float64)
        keys = quality_rules._ordered(values)
        assert np.array_equal(quality_rules._ordered(keys.view(np.float64)).view(np.float64), values)
        df = spark.createDataFrame([(int(k),) for k in keys], "key long")
        got = quality_rules._quantiles(df, [0.005, 0.5, 1.0])
        assert np.allclose(got, np.quantile(values, [0.005, 0.5, 1.0]), rtol=1e-15, atol=0)


def test_words_and_hashes():
    texts = ["a  b\tc", "", None, "d", " e f ", "été ça"]
    data, offsets = K.flat(pa.array(texts))
    starts, ends, bounds = K.words(data, offsets)
    raw = data.tobytes()
    for i, t in enumerate(texts):
        assert [raw[a:b].decode() for a, b in zip(starts[bounds[i] : bounds[i + 1]], ends[bounds[i] : bounds[i + 1]], strict=True)] == re.findall(r"[^\x20\x09-\x0D]+", t or "")
    words = [b"ab", b"b", b"ab", b"ba"]
    flat = np.frombuffer(b"".join(words), np.uint8)
    e = np.cumsum([len(w) for w in words])
    h = K.word_hashes(flat, e - [len(w) for w in words], e)
    assert h[0] == h[2] and len(set(h.tolist())) == 3
    v = np.random.default_rng(0).integers(0, 5, 3000).astype(np.uint64)
    for n in (2, 7):
        g = K.ngram_hashes(v, n)
        keys = [tuple(v[i : i + n]) for i in range(len(v) - n + 1)]
        assert len(set(g.tolist())) == len(set(keys)) and len({*zip(g.tolist(), keys, strict=True)}) == len(set(keys))
    for w in (1, 2, 5, 8):
        assert K.sliding_min(v, w).tolist() == [min(v[i : i + w]) for i in range(len(v) - w + 1)]


def test_kernels_over_segments(monkeypatch):
    """Long inputs in segments give the hashes of short ones."""
    data = np.random.default_rng(1).integers(97, 100, 5000).astype(np.uint8)
    v = K.mix(data.astype(np.uint64))
    before = K.byte_ngram_hashes(data, 9), K.ngram_hashes(v, 9), K.word_hashes(data, np.arange(0, 5000, 10), np.arange(5, 5005, 10))
    monkeypatch.setattr(K, "SEGMENT", 64)
    after = K.byte_ngram_hashes(data, 9), K.ngram_hashes(v, 9), K.word_hashes(data, np.arange(0, 5000, 10), np.arange(5, 5005, 10))
    assert all(np.array_equal(a, b) for a, b in zip(before, after, strict=True))


SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


def plain_indicators(text):
    """The classifier's features of a text, by sets and loops."""
    data, out = (text or "").encode(), set()
    for n, base in ((3, 0), (4, 1 << 16)):
        for i in range(len(data) - n + 1):
            out.add(base + ((int.from_bytes(data[i : i + n]) * 0x9E3779B1 & 0xFFFFFFFF) >> 16))
    words = data.split()
    same = sum(a == b for a, b in zip(words, words[1:]))
    return out | {2 * (1 << 16) + i for i, share in enumerate(quality_nbsvm.SAME) if same > 2 and same > share * (len(words) - 1)}


@needs_tables
def test_quality_query_like_brute_force(spark):
    """Ratios, optimum, margins and scores of op2 over all documents, by plain loops."""
    from tesseral.llm import queries

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.quality is not None and r.doc_id in docs}
    held = {d: crc32(str(d).encode()) % 5 == 0 for d in docs}
    rows = {d: plain_indicators(docs[d]) for d in docs}
    seen = sorted(d for d in labels if not held[d])
    counts = {1: Counter(), 0: Counter()}
    for d in seen:
        counts[labels[d]].update(rows[d])
    size = quality_nbsvm.SIZE
    total = {y: sum(c.values()) + size for y, c in counts.items()}
    ratio = np.array([np.log((counts[1][f] + 1) / total[1]) - np.log((counts[0][f] + 1) / total[0]) for f in range(size)])
    model = quality_nbsvm.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    w = np.divide(model.weights, ratio, out=np.zeros(size), where=np.abs(ratio) > 1e-12)
    share = np.mean([labels[d] for d in seen])
    cost = {1: 0.5 / share, 0: 0.5 / (1 - share)}

    def primal(v, b):
        loss = 0.0
        for d in seen:
            at = np.fromiter(rows[d], int, len(rows[d]))
            loss += cost[labels[d]] * max(0.0, 1 - (2 * labels[d] - 1) * (v[at] @ ratio[at] / np.sqrt(max(1, len(at))) + b))
        return v @ v / 2 + b * b / 2 + loss

    best, rng = primal(w, model.bias), np.random.default_rng(0)
    for _ in range(5):
        assert best <= primal(w + rng.normal(scale=0.01, size=size) * (w != 0), model.bias + rng.normal(scale=0.01)) + 1e-2
    got = {r.doc_id: r for r in queries.op2_quality_nbsvm(spark, SF).collect()}
    assert set(got) == set(docs)
    for d, r in got.items():
        at = np.fromiter(rows[d], int, len(rows[d]))
        margin = (model.weights.astype(np.float32)[at].sum(dtype=np.float64) / np.sqrt(len(at)) if len(at) else 0.0) + model.bias
        assert r.held_out == held[d] and r.predicted == int(r.score >= 0.3)
        assert r.score == pytest.approx(1 / (1 + np.exp(-(model.slope * margin + model.offset))), abs=1e-3)


@needs_tables
def test_language_query_like_brute_force(spark):
    """op3 over all documents: every word's segmentations are summed by a plain table, in logarithms added by document."""
    from tesseral.llm import queries

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.fit(docs)
    table = {piece: model.p[i] for i, piece in enumerate(model.pieces)}
    known = {}

    def word_log(word):
        if word not in known:
            alpha = [np.ones(len(model.langs))] + [np.zeros(len(model.langs)) for _ in word]
            for end in range(1, len(word) + 1):
                for start in range(max(0, end - language_id.MAX_WORD - 4), end):
                    p = table.get(word[start:end])
                    if p is not None:
                        alpha[end] = alpha[end] + alpha[start] * p
            known[word] = np.log(np.maximum(alpha[-1], 1e-300))
        return known[word]

    got = {r.doc_id: r for r in queries.op3_language_id(spark, SF).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert set(got) == {r.doc_id for r in rows}
    for r in rows:
        log, letters = np.zeros(len(model.langs)), False
        for run in re.findall(rb"[A-Za-z\x80-\xff]+", (r.text or "").encode()):
            cut = [0]
            while len(run) - cut[-1] > 0:
                at = len(cut) * language_id.MAX_WORD
                while at < len(run) and run[at] & 0xC0 == 0x80:
                    at -= 1
                cut.append(min(at, len(run)))
            for a, b in zip(cut, cut[1:]):
                shown = run[a:b].decode().lower()
                if any(c.isalpha() for c in shown):
                    letters = True
                    log += word_log(b" " + shown.encode())
        x = got[r.doc_id]
        assert x.held_out == (crc32(str(r.doc_id).encode()) % 4 == 2)
        if not letters:
            assert x.lang_pred == "und" and x.score == 0
            continue
        log += model.prior
        post = np.exp(log - log.max()) / np.exp(log - log.max()).sum()
        assert x.lang_pred == model.langs[int(post.argmax())] and x.score == pytest.approx(post.max(), abs=1e-6)
