import hashlib
import os
import random
import re

import numpy as np
import pytest

from tesseral.llm import indexes, substring_fm, substring_runs
from tesseral.llm import fragments as fr

SF = "/root/testdata/sf0.01"


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def order_key(row):
    return (row[0] is None, row[0] or 0)


def words_expected(rows, window):
    """By (id, text): words, removed, digest. Rows that repeat are one document; null ids come last."""
    seen, out = set(), {}
    for doc, text in sorted({(r[0], r[1] or "") for r in rows}, key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        w, gone = split(text), set()
        for i in range(len(w) - window + 1):
            x = tuple(w[i : i + window])
            if x in seen:
                gone.update(range(i, i + window))
            seen.add(x)
        out[doc, text] = (len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest())
    return out


def bytes_expected(rows, window):
    texts = {(r[0], r[1] or ""): (r[1] or "").encode() for r in rows}
    count = {}
    for data in texts.values():
        for i in range(len(data) - window + 1):
            x = hash(data[i : i + window])
            count[x] = count.get(x, 0) + 1
    out = {}
    for key, data in texts.items():
        mask = np.zeros(len(data) + 1, bool)
        for i in range(len(data) - window + 1):
            if count[hash(data[i : i + window])] > 1:
                mask[i : i + window] = True
        gone = mask[:-1]
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum())
        out[key] = (len(data), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(data, np.uint8)[~gone])).hexdigest())
    return out


def multiset(rows):
    return sorted(map(str, rows))


@pytest.mark.parametrize("hot", [64, 2])
def test_words_like_brute_force(docs, rows, monkeypatch, hot):
    monkeypatch.setattr(fr, "HOT", hot)
    got = substring_fm.digest(docs).collect()
    want = words_expected(rows, 20)
    assert multiset((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == multiset((r[0], *want[r[0], r[1] or ""]) for r in rows)
    assert sum(r.n_removed for r in got) > 500


@pytest.mark.parametrize("hot", [64, 2])
def test_bytes_like_brute_force(docs, rows, monkeypatch, hot):
    monkeypatch.setattr(fr, "HOT", hot)
    got = substring_runs.remove_repeats(docs).collect()
    want = bytes_expected(rows, 400)
    assert multiset((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == multiset((r[0], *want[r[0], r[1] or ""]) for r in rows)
    assert sum(r.n_removed for r in got) > 5000
    short = bytes_expected(rows, 256)
    for r, (d, t) in ((r, x) for r in got for x in want if x[0] == r.doc_id and r.doc_id is not None):
        assert r.n_removed <= r.n_marked <= max(short[d, t][1], r.n_removed)


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
def test_query_over_whole_tables_like_brute_force(spark):
    """All columns of op9 over the 1,000 documents; marks are true matches, and nearly all of them."""
    from tesseral.llm import queries

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want, short = bytes_expected(rows, 400), bytes_expected(rows, 256)
    got = queries.op9_substring_runs(spark, SF).collect()
    assert {(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == {(k[0], *v) for k, v in want.items()} and len(got) == len(rows)
    true = {k[0]: v[1] for k, v in short.items()}
    assert all(r.n_removed <= r.n_marked <= true[r.doc_id] for r in got)
    assert sum(r.n_marked for r in got) > 0.95 * sum(true.values())


def test_short_passages_are_marked(spark):
    """Passages below the window are marked in all their surroundings, more of them than one anchor may have too."""
    r = random.Random(8)
    own = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    few, many = [own(320) for _ in range(30)], own(380)
    rows = [(i, own(700) + few[i // 3] + own(700)) for i in range(90)] + [(1000 + i, own(500) + many + own(500)) for i in range(150)] + [(2000 + i, own(1500)) for i in range(60)]
    got = {x.doc_id: x for x in substring_runs.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not any(x.n_removed for x in got.values())
    assert sum(got[i].n_marked >= 256 for i in range(90)) > 70 and sum(got[1000 + i].n_marked >= 256 for i in range(150)) > 110
    assert not any(got[2000 + i].n_marked for i in range(60)) and all(x.n_marked < 420 for x in got.values())


def test_an_empty_batch_changes_nothing(monkeypatch):
    """A hot anchor's rows over several batches are all cut again, with empty batches between them too."""
    monkeypatch.setattr(fr, "HOT", 4)
    n = 40
    table = {c: np.zeros(n, np.int64) for c in ("a", "fh", "k", "th", "base", "s", "n", "c", "kind")}
    table |= {"a": np.repeat([1, 2, 3, 4], 10), "fh": np.concatenate([np.arange(10), np.repeat([1, 2], 5), np.arange(10), np.arange(10) // 2]), "k": np.arange(n), "n": np.full(n, 3), "c": np.ones(n, np.int64)}
    for first_stays in (True, False):
        run = fr._settler(fr.Plan(20, (6, 20), 10, first_stays, None, None))
        out = []
        for size, empty in ((n, False), (3, False), (3, True), (1, True)):
            batches = [b for i in range(0, n, size) for b in [fr._batch({c: v[i : i + size] for c, v in table.items()})] + [fr._batch({c: v[:0] for c, v in table.items()})] * empty]
            got = [tuple(x.values()) for b in run(batches) for x in b.to_pylist()]
            removed = sorted((x[2], x[5]) for x in got if x[8] == fr.REMOVED)
            out.append((removed, sorted((x[0], x[1], x[2], x[7], x[8]) for x in got if x[8] != fr.REMOVED)))
        assert all(x == out[0] for x in out[1:])
        assert {x[4] for x in out[0][1] if x[0] == 3} == {fr.CUT}


def test_common_passage_in_new_surroundings(spark, monkeypatch):
    """One anchor under many different fragments is cut again, and nothing is lost."""
    r = random.Random(5)
    word = lambda: f"u{r.randrange(10**6)}"
    passage = [word() for _ in range(30)]
    rows = [(i, " ".join([word() for _ in range(25)] + passage + [word() for _ in range(25)])) for i in range(150)]
    monkeypatch.setattr(fr, "HOT", 8)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = words_expected(rows, 20)
    assert {(x.doc_id, x.n_removed, x.kept_sha256) for x in substring_fm.digest(df).collect()} == {(k[0], *v[1:]) for k, v in want.items()}
    want = bytes_expected(rows, 100)
    assert {(x.doc_id, x.n_removed, x.kept_sha256) for x in substring_runs.remove_repeats(df, window=100).collect()} == {(k[0], v[1], v[3]) for k, v in want.items()}


def test_empty_tables_and_clashing_names(docs, nothing, clashing):
    assert substring_fm.digest(nothing).count() == substring_runs.remove_repeats(nothing).count() == 0
    assert multiset(substring_fm.digest(clashing).collect()) == multiset(substring_fm.digest(docs).collect())
    cut = substring_fm.remove_repeats(clashing)
    assert cut.columns == clashing.columns and cut.count() == docs.count()


def test_remove_repeats_keeps_texts_without_repeats(docs, rows):
    got = {(r.doc_id, r.source): r.text for r in substring_fm.remove_repeats(docs).collect() if r.doc_id is not None}
    assert got[9, "s"] == "short text" and got[13, "s"] == "  \n\t " and got[8, "s"] is None and got[1, "s"] == ""


def test_suffix_order():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 7, 120):
        for sigma in (1, 2, 6, 100_000):
            text = rng.integers(0, sigma, n)
            assert [tuple(text[i:]) for i in indexes.suffix_array(text)] == sorted(tuple(text[i:]) for i in range(n))


def test_indexes():
    rng = np.random.default_rng(0)
    text = np.concatenate([rng.integers(1, 4, 300), [0]])
    order = indexes.suffix_array(text)
    assert [tuple(text[i:]) for i in order] == sorted(tuple(text[i:]) for i in range(len(text)))
    index = indexes.FMIndex(text, 4)
    ends = np.arange(5, 301)
    matched, lo, hi = index.matching(text, ends, 5)
    for e, m in zip(ends, matched, strict=True):
        best = max((n for n in range(1, 6) if sum(tuple(text[i : i + n]) == tuple(text[e - n : e]) for i in range(300)) > 1), default=0)
        assert m == best
    full = matched == 5
    first = index.earliest(lo[full], hi[full])
    assert all(tuple(text[a : a + 5]) == tuple(text[e - 5 : e]) and a <= e - 5 for a, e in zip(first, ends[full], strict=True))
    runs = indexes.RunLengthIndex(text)
    place = np.empty(len(text), int)
    place[order] = np.arange(len(text))
    before = runs.neighbour(np.arange(len(text)), runs.before)
    assert all(before[i] == order[place[i] - 1] for i in range(len(text)) if place[i] > 0)
    after = runs.neighbour(np.arange(len(text)), runs.after)
    assert all(after[i] == order[place[i] + 1] for i in range(len(text)) if place[i] < len(text) - 1)
