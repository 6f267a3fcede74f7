"""Sources and sinks over files in a temporary folder."""

import json

import pytest
from pyspark.sql import functions as F

from tesseral.sources import readers, sinks


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text if isinstance(text, str) else "\n".join(x if isinstance(x, str) else json.dumps(x) for x in text))
    return str(path)


def fix(commit, **more):
    return {"fix_commit": commit, "cve_id": "CVE-1", "project": "p", "language": "C", "cwe": "CWE-787", "function_name": "f", "signature": "int f(int x)", "pre_fix": "a", "post_fix": "b"} | more


def test_fixes(spark, tmp_path):
    write(tmp_path / "d/a.jsonl", [fix("1"), "", "{broken", fix("2", language="rust"), fix("3", cwe="x"), fix("4"), fix("5", pre_fix="b"), fix("6", signature="")])
    raw = readers.json_lines(spark, str(tmp_path / "d"), readers.FIXES)
    assert raw.where("fix_commit IS NOT NULL").count() == 6
    prompts = readers.fixes_prompts(raw).collect()
    assert len(prompts) == 3 and all(p.id.startswith("cvefixes:") and len(p.id) == 25 for p in prompts)
    assert [r.fix_commit for r in readers.fixes_pairs(raw).collect()] == ["1"]
    kept = readers.json_lines(spark, str(tmp_path / "d"), readers.FIXES, drop_malformed=False)
    assert kept.cache().where("_corrupt_record IS NOT NULL").count() == 1


def test_json_arrays(spark, tmp_path):
    item = {"id": "c1", "cwe": 787, "vulnerable": True, "code": "int x;", "lines": [1]}
    write(tmp_path / "castle.json", json.dumps({"tests": [item, item | {"id": "c2", "vulnerable": False}, item | {"id": "c3", "code": " "}]}))
    raw = readers.json_array(spark, str(tmp_path / "castle.json"), readers.CASTLE, "tests")
    made = {r.metadata["vulnerable"]: r.prompt_text for r in readers.castle_prompts(raw).collect()}
    assert len(made) == 2 and readers.castle_prompts(raw, keep_safe=False).count() == 1
    assert all(t.endswith(f"no commentary, no markdown fences.\n\n```c\n{item['code'].strip()}\n```") for t in made.values())
    assert "(vulnerable line(s): [" in made["true"] and "free of CWE-" in made["false"]
    row = {"prompt_id": 1, "cwe_identifier": "CWE-787", "language": "c", "test_case_prompt": "do", "origin_code": "x"}
    write(tmp_path / "auto/a.json", json.dumps([row, row | {"prompt_id": 2}]))
    write(tmp_path / "auto/b.json", json.dumps([row | {"test_case_prompt": "later"}, row | {"origin_code": "y", "language": "go"}]))
    write(tmp_path / "auto/c.json", '"not an array"')
    got = readers.autocomplete_prompts(readers.json_array(spark, str(tmp_path / "auto"), readers.AUTOCOMPLETE)).collect()
    assert [p.prompt_text for p in got] == ["do"] and got[0].test_spec.prefix_text == "do\n"


def test_other_adapters(spark, tmp_path):
    func = "std::string f(int a) { " + "x();" * 30 + "}"
    raw = readers.json_lines(spark, write(tmp_path / "v.jsonl", [{"func": func, "target": 1, "cwe": ["CWE-787", "CWE-125", "?"], "commit_id": "c"}, {"func": func, "target": 0, "cwe": ["CWE-787"]}, {"func": "short", "target": 1, "cwe": ["CWE-787"]}]), readers.VULNERABLE)
    got = readers.vulnerable_prompts(raw).collect()
    assert sorted(p.target_cwe for p in got) == ["CWE-125", "CWE-787"] and {p.language for p in got} == {"cpp"}
    raw = readers.json_lines(spark, write(tmp_path / "t.jsonl", [{"id": "1", "category": "79", "language": "py", "task_description": "Do it", "signature": "def f(x)", "tests": [{"stdin": "1"}]}, {"id": "2", "category": "79", "language": "py", "task_description": " "}]), readers.TASKS)
    (p,) = readers.task_prompts(raw).collect()
    assert p.prompt_text == "Do it\n\ndef f(x)" and p.test_spec.test_cases[0].timeout_s == 5.0 and p.test_spec.compile_flags == []
    raw = readers.json_lines(spark, write(tmp_path / "s.jsonl", [{"ID": "CWE-020_a.py", "Prompt": "p"}, {"ID": "none", "Prompt": "p"}]), readers.SNIPPETS)
    assert [p.target_cwe for p in readers.snippet_prompts(raw).collect()] == ["CWE-20"]
    assert readers.in_scope(readers.snippet_prompts(raw)).count() == 1


def test_trees(spark, tmp_path):
    write(tmp_path / "j/C/testcases/CWE121_Stack/s01/a.c", "void bad() {}")
    write(tmp_path / "j/C/testcases/CWE121_Stack/s01/a.txt", "no")
    write(tmp_path / "j/C/testcases/CWE190_Int/b.cpp", "void good() {}")
    got = sorted((r.cwe, r.language) for r in readers.source_tree(spark, str(tmp_path / "j")).collect())
    assert got == [("CWE-121", "c"), ("CWE-190", "cpp")]
    for name, body in (("py/cwe_022_0_task.py", "task"), ("py/cwe_022_0_test.py", "test"), ("c/cwe_078_0_c_task.c", "t"), ("c/bad_task.c", "x"), ("c/cwe_079_1_c_test.c", "y")):
        write(tmp_path / "w" / name, body)
    got = readers.task_test_pairs(spark, str(tmp_path / "w")).collect()
    assert [(r.stem, r.cwe, r.language, r.task, r.test) for r in got] == [("cwe_022_0", "CWE-22", "python", "task", "test")]


def test_tables_and_lookups(spark, tmp_path):
    tables = {
        "cve": spark.createDataFrame([("CVE-1",), ("CVE-2",)], "cve_id string"), "cwe_classification": spark.createDataFrame([("CVE-1", "CWE-79"), ("CVE-1", "CWE-89"), ("CVE-2", "CWE-22")], "cve_id string, cwe_id string"),
        "fixes": spark.createDataFrame([("CVE-1", "h1"), ("CVE-2", "h2")], "cve_id string, hash string"), "file_change": spark.createDataFrame([(1, "h1", "a.py", "Python"), (2, "h2", "b.js", "JavaScript")], "file_change_id long, hash string, filename string, programming_language string"),
        "method_change": spark.createDataFrame([(1, "f", "f(x)", "new", "old"), (2, "g", "g()", "new", None)], "file_change_id long, name string, signature string, code string, before_change string"),
    }
    assert sorted(r.cwe for r in readers.fixes_join(tables).collect()) == ["CWE-79", "CWE-89"] and readers.fixes_join(tables, 1).count() == 1
    spark.createDataFrame([("1", "79", None, {"a": 1})], "id string, CWE_ID string, prompt string, unittest map<string,int>").write.parquet(str(tmp_path / "p"))
    got = readers.with_aliases(spark.read.parquet(str(tmp_path / "p")), {"cwe": ["cwe", "cwe_id"], "text": ["task", "prompt"], "tests": ["unittest"], "gone": ["x"]}).first()
    assert (got.cwe, got.text, got.tests, got.gone) == ("79", None, '{"a":1}', None)
    assert [r.value for r in readers.text_list(spark, write(tmp_path / "l.txt", "# c\nCWE-79 # x\n\n CWE-89\n")).collect()] == ["CWE-79", "CWE-89"]
    assert {r.child: r.parents for r in readers.lookup(spark, write(tmp_path / "h.json", json.dumps({"_meta": {}, "parents": {"a": ["b"]}})), "child", "parents", "parents").collect()} == {"a": '["b"]'}
    assert readers.lookup(spark, write(tmp_path / "x.json", json.dumps({"_meta": {"status": "placeholder"}, "parents": {"a": "b"}})), "c", "p", "parents").count() == 0
    assert readers.baselines(spark).count() == 8 and readers.baselines(spark, "open").count() == 2


def test_records(spark, tmp_path):
    write(tmp_path / "r/run1/part.jsonl", [{"prompt_id": "a", "compiles": False}, {"prompt_id": "b"}, {"prompt_id": "a", "compiles": True}])
    got = {r.prompt_id: r.compiles for r in readers.records(spark, str(tmp_path / "r/run1")).collect()}
    assert got == {"a": True, "b": None}
    known = spark.createDataFrame([("a",)], "id string")
    assert readers.records(spark, str(tmp_path / "r/run1"), known).count() == 1
    assert {r.cell for r in readers.logs(spark, str(tmp_path / "r/run1"), "prompt_id string").collect()} == {"run1"}
    raw = spark.createDataFrame([("c", "f", 0, "good"), ("c", "f", 1, "bad"), ("c", "g", 0, "x"), ("c", "g", 1, "x"), ("d", "f", 1, "y")], "commit_id string, file_name string, target int, func string")
    assert [(r.e_pos, r.e_neg) for r in readers.paired_functions(raw).collect()] == [("good", "bad")]


def test_chunked_source(spark):
    class Source(readers.ChunkedSource):
        @staticmethod
        def fetch(key, start, end):
            if key == "b":
                raise OSError("no route")
            yield f"{key}-{start[:10]}", start, 7.5

    spark.dataSource.register(Source)
    df = spark.read.format("chunked").options(keys="a,b", start="2024-01-01", end="2024-12-31", days="120").load()
    assert df.rdd.getNumPartitions() == 8 and df.count() == 4


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("2", "c++", "x", 1), ("1", "python", "y", 2), ("3", "c#", "y", 3)], "id string, language string, source string, n int")
    out = str(tmp_path / "out/train")
    sinks.json_lines(df, out, ["id"])
    assert [r.id for r in spark.read.json(out).collect()] == ["1", "2", "3"]
    with pytest.raises(Exception, match="exist"):
        sinks.json_lines(df, out, ["id"])
    sinks.json_lines(df, out, ["id"], force=True)
    made = json.loads(sinks.manifest({"train": df}, "source", "language", str(tmp_path / "out")))
    assert made["train"]["count"] == 3 and made["train"]["by"]["y"] == {"python": 1, "c#": 1} and made["train"]["sha256"]
    sinks.by_language(df, str(tmp_path / "shards"))
    assert {r.shard for r in spark.read.json(str(tmp_path / "shards")).select("shard").collect()} == {"cpp", "python", "csharp"}
    sinks.report(df.withColumn("model_name", F.lit("m")), df.withColumn("model_name", F.lit("m")), str(tmp_path / "rep"))
    assert spark.read.json(str(tmp_path / "rep/per_prompt")).count() == 3
    cache = spark.createDataFrame([("1", 0.5)], "id string, score double")
    joined, todo = sinks.cached(df, cache, "id", "score")
    assert joined.count() == 3 and {r.id for r in todo.collect()} == {"2", "3"}
    assert {r.id: r.score for r in sinks.upserted(cache, spark.createDataFrame([("1", 0.9), ("2", 0.1)], "id string, score double"), "id").collect()} == {"1": 0.9, "2": 0.1}
    nested = df.select("id", F.struct(F.lit("a").alias("p"), F.lit("b").alias("q")).alias("spec"))
    assert {r.id: r.spec.p for r in sinks.patched(nested, F.col("id") == "2", "spec", {"p": F.lit("z")}).collect()} == {"1": "a", "2": "z", "3": "a"}
    assert sinks.markdown(df.select("id").orderBy("id")).splitlines()[2] == "| 1 |" and "tabular" in sinks.latex(df)


def test_index(spark, tmp_path):
    pairs = spark.createDataFrame([("CWE-79", "s", "n", "p", 1)], "cwe string, source string, e_neg string, e_pos string, id long")
    postings = spark.createDataFrame([("t", 1, 1, 1)], "term string, id long, tf long, dl int")
    vectors = spark.createDataFrame([(1, [1.0])], "id long, v array<float>")
    sinks.retrieval_index(pairs, postings, vectors, str(tmp_path / "i"))
    assert set(readers.index(spark, str(tmp_path / "i"))) == {"pairs", "postings", "embeddings"}
    sinks.retrieval_index(pairs, postings, vectors.limit(0), str(tmp_path / "i"), force=True)
    with pytest.raises(ValueError, match="1 pairs, but 0 vectors"):
        readers.index(spark, str(tmp_path / "i"))
