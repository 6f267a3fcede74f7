import random
import re
from itertools import combinations

from tesseral.llm import near_dup
from tesseral.llm.components import components


def shingles(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def expected(rows, size=3, percent=85):
    """By row number: set size and the least row number reachable, rows in order of id with null ids last."""
    sets = [shingles(t, size) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            x, y = sorted((root(i), root(j)))
            parent[y] = x
    return [(len(s), root(i)) for i, s in enumerate(sets)]


def test_like_brute_force(docs, rows):
    unique = sorted({(r[0], r[1]) for r in rows if r[0] is not None}, key=lambda r: r[0])
    want = {d: (n, unique[c][0], unique[c][0] == d) for (d, _), (n, c) in zip(unique, expected(unique), strict=True)}
    got = near_dup.clusters(docs).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id is not None} == {(d, *v) for d, v in want.items()}


def test_groups_of_near_copies_and_chains(spark):
    """Near copies around one text, and a chain whose ends are not alike."""
    r = random.Random(3)
    base = [f"w{r.randrange(5000)}" for _ in range(200)]
    rows = []
    for i in range(60):
        own = list(base)
        for _ in range(r.randrange(1, 4)):
            own[r.randrange(200)] = f"x{r.randrange(10**6)}"
        rows.append((100 + i, " ".join(own)))
    chain = [f"c{r.randrange(5000)}" for _ in range(200)]
    for i in range(12):
        rows.append((300 + i, " ".join(chain)))
        for _ in range(3):
            chain[r.randrange(200)] = f"y{r.randrange(10**6)}"
    for i in range(40):
        rows.append((500 + i, " ".join(f"z{r.randrange(300)}" for _ in range(100))))
    want = {rows[i][0]: rows[c][0] for i, (_, c) in enumerate(expected(rows))}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_dup.clusters(df).collect()} == want
    kept = {r.doc_id for r in near_dup.drop_near_duplicates(df, size=3, percent=85).collect()}
    assert kept == {d for d, c in want.items() if d == c}


def test_small_blocks_and_salts(spark, monkeypatch):
    """Buckets over one block and partners over one task give the same links."""
    monkeypatch.setattr(near_dup, "BLOCK", 4)
    monkeypatch.setattr(near_dup, "SALT_ROWS", 3)
    test_groups_of_near_copies_and_chains(spark)


def test_edge_cases(docs, nothing, clashing):
    assert near_dup.clusters(nothing).count() == 0
    assert sorted(map(str, near_dup.clusters(clashing).collect())) == sorted(map(str, near_dup.clusters(docs).collect()))
    assert near_dup.drop_near_duplicates(clashing).columns == clashing.columns
    only = docs.where("text IS NULL OR trim(text) = ''")
    assert all(r.kept and r.n_shingles == 0 for r in near_dup.clusters(only).collect())


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 50), (50, 60), (7, 7)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 50: 50, 60: 50, 100: 50}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_unfinished_components_are_an_error(spark, monkeypatch):
    import pytest
    from tesseral.llm import components as module

    monkeypatch.setattr(module, "ROUNDS", 2)
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)], "u long, v long")
    with pytest.raises(RuntimeError, match="not found after 2 rounds"):
        components(edges)


def test_negative_ids_and_no_sketches(spark):
    r = random.Random(4)
    rows = []
    for g in range(6):
        base = [f"g{g}w{r.randrange(4000)}" for _ in range(400)]
        for i in range(8):
            own = list(base)
            for _ in range(r.randrange(0, 9)):
                own[r.randrange(400)] = f"x{r.randrange(10**6)}"
            rows.append((g * 10 + i - 30, " ".join(own)))
    rows.sort()
    want = {rows[i][0]: rows[c][0] for i, (_, c) in enumerate(expected(rows))}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {x.doc_id: x.component_id for x in near_dup.clusters(df).collect()} == want
    assert {x.k: x.component for x in near_dup.near_duplicates(df, deviations=None).collect()} == want


def test_shared_folder_must_be_named_on_a_cluster():
    import pytest
    from types import SimpleNamespace as S

    from tesseral.llm.common import shared_dir

    unset = S(get=lambda *a: None)
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_dir(S(conf=unset, sparkContext=S(master=master, getConf=lambda: unset)))
