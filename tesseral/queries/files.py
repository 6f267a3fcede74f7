"""Sources and sinks: the driver's tables written in each format and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import readers, sinks
from .base import Registry, scratch, table

R = Registry()
query = R.query


def put(df, path: str, column: str = "value") -> str:
    """Each row's text as a file of its own lines."""
    df.select(F.col(column).alias("value")).write.text(path)
    return path


def supplier_prompts(spark, sf_dir):
    """Suppliers as prompts with a nested spec."""
    k = F.col("s_suppkey")
    case = F.struct(F.col("s_name").alias("input_stdin"), k.cast("string").alias("expected_stdout"), F.lit(5.0).alias("timeout_s"))
    lang = F.when(k % 3 == 0, "python").when(k % 3 == 1, "c").otherwise("c++")
    spec = F.struct(lang.alias("language"), F.array(case).alias("test_cases"), F.create_map(F.lit("a.txt"), F.col("s_name")).alias("extra_files"), F.array(F.lit("-O2"), F.lit("-Wall")).alias("compile_flags"))
    return table(spark, sf_dir, "supplier").select(F.format_string("s%06d", k).alias("id"), F.concat(F.lit("nation "), F.col("s_nationkey")).alias("source"), lang.alias("language"), F.concat(F.lit("CWE-"), k % 4).alias("target_cwe"), F.col("s_name").alias("prompt_text"), spec.alias("test_spec"), F.create_map(F.lit("k"), k.cast("string")).alias("metadata"))


_LANG = "CASE s_suppkey % 3 WHEN 0 THEN 'python' WHEN 1 THEN 'c' ELSE 'c++' END"


@query(f"SELECT printf('s%06d', s_suppkey) AS id, {_LANG} AS language, concat('CWE-', s_suppkey % 4) AS target_cwe, s_name AS prompt_text, s_name AS stdin, '-O2 -Wall' AS flags, s_name AS extra, CAST(s_suppkey AS VARCHAR) AS note FROM supplier")
def prompt_lines_round_trip(spark, sf_dir):
    """SNK1, SNK6, SRC1-2, SRC12: sorted JSON lines, written over what is there, read with their nested specs."""
    path = scratch(spark)
    for _ in range(2):
        sinks.json_lines(supplier_prompts(spark, sf_dir), path, ["id"], force=True)
    p = readers.prompts(spark, path)
    return p.select("id", "language", "target_cwe", "prompt_text", F.col("test_spec.test_cases")[0]["input_stdin"].alias("stdin"), F.array_join("test_spec.compile_flags", " ").alias("flags"), F.col("test_spec.extra_files")["a.txt"].alias("extra"), F.col("metadata")["k"].alias("note"))


@query(f"SELECT replace({_LANG}, '+', 'p') AS shard, CAST(count(*) AS BIGINT) AS n FROM supplier GROUP BY 1")
def language_shards(spark, sf_dir):
    """SNK2: a folder a language."""
    path = scratch(spark)
    sinks.by_language(supplier_prompts(spark, sf_dir).select("id", "language"), path)
    return spark.read.json(path).groupBy("shard").agg(F.count("*").alias("n"))


@query(f"SELECT concat('nation ', s_nationkey) AS source, {_LANG} AS language, CAST(count(*) AS BIGINT) AS n FROM supplier GROUP BY 1, 2")
def manifest_counts(spark, sf_dir):
    """SNK3: the manifest's cells, read back from its JSON."""
    made = sinks.manifest({"train": supplier_prompts(spark, sf_dir)}, "source", "language")
    cells = F.from_json(F.get_json_object(F.lit(made), "$.train.by"), "map<string,map<string,bigint>>")
    return spark.range(1).select(F.explode(cells).alias("source", "by")).select("source", F.explode("by").alias("language", "n"))


@query("SELECT n_name AS model_name, CAST(count(*) AS BIGINT) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1")
def report_files(spark, sf_dir):
    """SNK4: records and aggregates by model."""
    path = scratch(spark)
    rows = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("model_name"), "s_suppkey")
    sinks.report(rows, rows.groupBy("model_name").agg(F.count("*").alias("n")), path)
    whole = spark.read.json(f"{path}/per_prompt").groupBy("model_name").agg(F.count("*").alias("m"))
    return spark.read.json(f"{path}/aggregate").join(whole, "model_name").where("n = m").select("model_name", "n")


@query("SELECT r_name AS region, CAST(row_number() OVER (PARTITION BY r_name ORDER BY n_name) - 1 AS INT) AS pos, n_name AS name, CAST(n_nationkey AS BIGINT) AS id FROM nation JOIN region ON n_regionkey = r_regionkey")
def json_array_files(spark, sf_dir):
    """SRC3: one whole-file document a region, with an array in a field."""
    path = scratch(spark)
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    one = rows.groupBy("r_name").agg(F.array_sort(F.collect_list(F.struct("n_name", "n_nationkey"))).alias("x"))
    tests = F.transform("x", lambda e: F.struct(e["n_name"].alias("name"), e["n_nationkey"].alias("id"), F.col("r_name").alias("region")))
    one.select("r_name", F.to_json(F.struct(tests.alias("tests"))).alias("value")).write.partitionBy("r_name").text(path)
    return readers.json_array(spark, f"{path}/*", "name STRING, id BIGINT, region STRING", "tests").select("region", "pos", "name", "id")


@query("SELECT concat('CWE-', 100 + n_nationkey) AS cwe, CASE WHEN n_nationkey % 2 = 0 THEN 'cpp' ELSE 'c' END AS language, n_name AS text FROM nation")
def source_tree_files(spark, sf_dir):
    """SRC5: files below folders that name a weakness; other files are left out."""
    path, k = scratch(spark), F.col("n_nationkey")
    rows = table(spark, sf_dir, "nation").select(F.col("n_name").alias("value"), F.format_string("CWE%d_Kind", 100 + k).alias("folder"), (k % 2 == 0).alias("cpp"))
    files = {f"{path}/{r.folder}/s01/{r.value.replace(' ', '_')}.{'cpp' if r.cpp else 'c'}": r.value for r in rows.collect()}  # 25 nations
    files[f"{path}/CWE121_Kind/notes.txt"] = "none"
    write_files(spark, files)
    return readers.source_tree(spark, path).select("cwe", "language", "text")


def write_files(spark, files: dict[str, str]) -> None:
    """A few small files, wherever the session's file systems put them."""
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    for name, text in files.items():
        at = hadoop.Path(name)
        out = at.getFileSystem(conf).create(at, True)
        out.write(bytearray(text.encode()))
        out.close()


@query("SELECT printf('cwe_%03d_%d', 20 + r_regionkey, r_regionkey) AS stem, concat('CWE-', 20 + r_regionkey) AS cwe, CASE r_regionkey % 3 WHEN 0 THEN 'python' WHEN 1 THEN 'c' ELSE 'cpp' END AS language, concat('task ', r_name) AS task, concat('test ', r_name) AS test FROM region")
def task_and_test_files(spark, sf_dir):
    """SRC6: pairs of files with one stem."""
    path, files = scratch(spark), {f"x/cwe_099_{i}_task.py": "alone" for i in range(2)}
    for r in table(spark, sf_dir, "region").collect():  # five regions
        for side in ("task", "test"):
            files[f"r{r.r_regionkey}/cwe_{20 + r.r_regionkey:03}_{r.r_regionkey}_{side}.{('py', 'c', 'cpp')[r.r_regionkey % 3]}"] = f"{side} {r.r_name}"
    write_files(spark, {f"{path}/{name}": text for name, text in files.items()})
    return readers.task_test_pairs(spark, path)


@query("SELECT CAST(n_nationkey AS VARCHAR) AS cwe, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE concat('other ', n_name) END AS text, CAST(to_json(struct_pack(a := n_nationkey)) AS VARCHAR) AS tests FROM nation")
def column_spellings(spark, sf_dir):
    """SRC8: the first spelling that is there and not null; structs as JSON."""
    k = F.col("n_nationkey")
    rows = table(spark, sf_dir, "nation").select(k.alias("CWE_ID"), F.when(k % 2 == 0, F.col("n_name")).alias("task"), F.concat(F.lit("other "), "n_name").alias("prompt"), F.struct(k.alias("a")).alias("unittest"))
    return readers.with_aliases(rows, {"cwe": ["cwe", "cwe_id"], "text": ["task", "prompt"], "tests": ["tests", "unittest"]})


@query("SELECT concat('CWE-', n_nationkey) AS value FROM nation")
def list_file(spark, sf_dir):
    """SRC10: lines, with comments and blank ones between."""
    k = F.col("n_nationkey")
    line = F.concat(F.lit("# a comment\n \nCWE-"), k, F.when(k % 2 == 0, "  # note").otherwise(""))
    return readers.text_list(spark, put(table(spark, sf_dir, "nation").select(line.alias("value")), scratch(spark)))


@query("SELECT CAST(label AS VARCHAR) AS cwe, CAST(count(*) AS BIGINT) AS pairs, CAST(count(*) AS BIGINT) AS vectors FROM embeddings GROUP BY 1")
def index_round_trip(spark, sf_dir):
    """SNK7, SRC16: the tables of a retrieval index."""
    path, e = scratch(spark), table(spark, sf_dir, "embeddings")
    text = F.col("vec_id").cast("string")
    pairs = e.select(F.col("label").cast("string").alias("cwe"), F.lit("s").alias("source"), text.alias("e_neg"), text.alias("e_pos"), F.col("vec_id").alias("id"))
    postings = pairs.select(F.col("cwe").alias("term"), "id", F.lit(1).alias("tf"), F.lit(1).alias("dl"))
    sinks.retrieval_index(pairs, postings, e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), path)
    found = readers.index(spark, path)
    joined = found["pairs"].join(found["embeddings"], "id", "left")
    return joined.groupBy("cwe").agg(F.count("*").alias("pairs"), F.count("v").alias("vectors"))


@query("SELECT 'prompt ' || n_name AS prompt, 'answer ' || n_nationkey AS completion FROM nation")
def canned_completions(spark, sf_dir):
    """SRC19."""
    path = scratch(spark)
    sinks.json_lines(table(spark, sf_dir, "nation").select(F.concat(F.lit("prompt "), "n_name").alias("prompt"), F.concat(F.lit("answer "), F.col("n_nationkey")).alias("completion")), path, ["prompt"])
    return readers.canned(spark, path)


@query(f"SELECT * FROM (VALUES {', '.join(str(x) for x in readers.BASELINES)}) t(name, category) WHERE category = 'trained'")
def baseline_table(spark, sf_dir):
    """SRC18."""
    return readers.baselines(spark, "trained")


@query(f"SELECT printf('s%06d', s_suppkey) AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'patched' ELSE {_LANG} END AS spec_language FROM supplier")
def patched_specs(spark, sf_dir):
    """SNK9: a field of the spec set in half of the rows."""
    rows = sinks.patched(supplier_prompts(spark, sf_dir), F.substring("id", 2, 6).cast("int") % 2 == 0, "test_spec", {"language": F.lit("patched")})
    return rows.select("id", F.col("test_spec.language").alias("spec_language"))


_ROWS = "SELECT r_regionkey, r_name FROM region ORDER BY 1"


@query(f"""WITH r AS ({_ROWS}) SELECT concat('| r_regionkey | r_name |', chr(10), '|---|---|', string_agg(concat(chr(10), '| ', r_regionkey, ' | ', r_name, ' |'), '' ORDER BY r_regionkey)) AS markdown,
concat('\\begin{{tabular}}{{ll}}', chr(10), 'r\\_regionkey & r\\_name', string_agg(concat(' \\\\', chr(10), r_regionkey, ' & ', replace(r_name, '_', '\\_')), '' ORDER BY r_regionkey), ' \\\\', chr(10), '\\end{{tabular}}') AS latex FROM r""")
def tables_as_text(spark, sf_dir):
    """SNK10."""
    rows = table(spark, sf_dir, "region").select("r_regionkey", "r_name").orderBy("r_regionkey")
    return spark.range(1).select(F.lit(sinks.markdown(rows)).alias("markdown"), F.lit(sinks.latex(rows)).alias("latex"))
