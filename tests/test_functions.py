"""Text, weakness and statistics functions against hand-made values."""

import math

import pytest
from pyspark.sql import functions as F

from tesseral.functions import code, cwe, stats, text


def values(spark, column, rows, name="x", kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, {name} {kind}")
    return [r.v for r in df.select("i", column.alias("v")).orderBy("i").collect()]


def test_normalize_cwe(spark):
    assert values(spark, cwe.normalize_cwe("x"), ["CWE-79", "cwe-79", " 89 ", "CWE-020", "CWE-x", "", None, "79a"]) == ["CWE-79", "CWE-79", "CWE-89", "CWE-020", None, None, None, None]
    with pytest.raises(Exception, match="not a weakness"):
        values(spark, cwe.strict_cwe("x"), ["nope"])
    assert values(spark, cwe.coerce_cwe("x"), ["79", "cwe_22", "CWE-CWE-5", "x"]) == ["CWE-79", "CWE-22", "CWE-5", None]


def test_normalize_language(spark):
    assert values(spark, cwe.normalize_language("x"), ["Python3", " C++ ", "cxx", "c", "rust", None]) == ["python", "cpp", "cpp", "c", None, None]


def test_severity_and_confidence(spark):
    assert values(spark, cwe.tier("x"), [9.0, 7.0, 4.0, 3.9, None], kind="double") == ["critical", "high", "medium", "low", "medium"]
    assert values(spark, cwe.severity_bin("x"), [8.8, 5.5, 3.65, None], kind="double") == ["high", "medium", "low", None]
    given = ['"error"', '"Warning"', '"note"', "0.7", "85", "200", "-3", '"HIGH"', '"85"', "true", "null", "{}", None]
    assert values(spark, cwe.coerce_confidence(F.parse_json("x")), given) == [0.8, 0.5, 0.3, 0.7, 0.85, 1.0, 0.0, 0.5, 0.5, 1.0, 0.5, 0.5, 0.5]


def test_scope(spark):
    assert values(spark, cwe.languages_in_scope("x"), ["CWE-22", "CWE-787", "CWE-89", "CWE-862", "CWE-327"]) == [["python", "c", "cpp"], ["c", "cpp"], ["python"], ["python", "c"], []]


def test_closure_ends_on_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")], "child string, parent string")
    got = {(r.descendant, r.ancestor) for r in cwe.closure(spark, edges).collect()}
    assert got == {("a", "b"), ("a", "c"), ("b", "a"), ("b", "c"), ("c", "a"), ("c", "b"), ("d", "a"), ("d", "b"), ("d", "c")}
    tree = {(r.descendant, r.ancestor): r.depth for r in cwe.closure(spark, cwe.parents_table(spark)).collect()}
    assert tree["CWE-787", "CWE-118"] == 2 and tree["CWE-78", "CWE-707"] == 3


def test_string_normalize(spark):
    got = values(spark, text.string_normalize("x"), ["int  X; // note\n# inc\n/* a\nb */ Y", "a", "", None])
    assert got == ["int x; y", "a", "", None]


def test_canonical_hash_is_equal(spark):
    assert len(set(values(spark, text.canonical_hash("x"), ["x = 1", "x = 1\n", "x = 1\n\n\n", "x = 1\r\n"]))) == 1


def test_retrieval_tokens(spark):
    got = values(spark, text.retrieval_tokens("x"), ["getUserName snake_case CWE-79 CVE-2020-1234 42"])
    assert got == [["get", "user", "name", "snake_case", "cwe-79", "cve-2020-1234", "42"]]


def test_code_extraction(spark):
    rows = ["x\n```python\na = 1\n```\ny\n```c\nint b;\n```", "t\n```py\nopen = 1\n", "raw", "cut here<|im_end|>rest", "int f(); /* open", "/* a */ int f();"]
    assert values(spark, text.fenced_code(text.truncate_continuation("x")), rows[:4]) == ["a = 1\n\nint b;", "open = 1", "raw", "cut here"]
    assert values(spark, text.strip_open_comment("x"), rows[4:]) == ["int f();", "/* a */ int f();"]


def test_refusal(spark):
    given = ["\n I cannot do it", "As an AI model", "I cannot\ndef f(): pass", "Sure", "", "\r\n\tI cannot", "\u2028\xa0I won't\x0bdo it", "Sure\rI cannot"]
    assert values(spark, text.refusal("x"), given) == [True, True, False, False, False, True, True, False]


def test_stub(spark):
    py = text.stub_reason("x", F.lit("python"))
    assert values(spark, py, ["def f(x):\n    pass", "def compute_everything(x, y):\n    pass", "def compute(x):\n    y = x * 2\n    return y + 1", "# only\n# comments here and more"]) == ["short", "py_trivial", None, "short"]
    c = text.stub_reason("x", F.lit("c"))
    assert values(spark, c, ["int main(int argc, char **argv) { return 0; }", "int add(int a, int b) { return a + b; }"]) == ["c_trivial", None]
    assert values(spark, py, ["def compute_everything(x, y):\r\n\tpass\r\n", "\t# comment\r\tdef compute_everything(x):\r\t\treturn None", "y = compute_everything(x)\n\t\x1cpass"]) == ["py_trivial", "py_trivial", None]
    assert values(spark, c, ["int main(int argc, char **argv) {\r\n\treturn 0;\r\n}\t", "\t// { return 0; } and more of it\r\n"]) == ["c_trivial", "short"]


def test_well_formed(spark):
    assert values(spark, text.well_formed_prompt("x"), ["Write it. Return only code.", "Fix ```c\nx", "Write it", "The rewriter ```c"]) == [True, True, False, False]


def test_signature_and_language(spark):
    assert values(spark, text.signature_hint("x"), ["// f(x)\n#define A(x)\nint f(int x) {\n", "\t// call(me)\nint f(int x) {", "\r\n\t/* a(b) */\r\tint g(void)\t{{\r\n", "none"]) == ["int f(int x)", "int f(int x)", "int g(void)", None]
    assert values(spark, text.cpp_or_c("x"), ["std::x", "class A", "template <T>", "int f()"]) == ["cpp", "cpp", "cpp", "c"]


def test_wilson(spark):
    row = spark.range(1).select(*[c.alias(n) for n, c in zip("ab", stats.wilson(F.lit(34), F.lit(156)), strict=True)], *[c.alias(n) for n, c in zip("cd", stats.wilson(F.lit(0), F.lit(0)), strict=True)]).first()
    assert (round(row.a, 3), round(row.b, 3), row.c, row.d) == (0.160, 0.289, 0, 0)


def test_mcnemar_keeps_the_correction(spark):
    df = spark.createDataFrame([(5, 5), (0, 0), (10, 2)], "b int, c int")
    assert [round(r[0], 6) for r in df.select(stats.mcnemar_chi2("b", "c")).collect()] == [0.1, 0.0, round(49 / 12, 6)]
    assert [round(r[0], 6) for r in df.select(code.chi2_p(stats.mcnemar_chi2("b", "c"))).collect()] == [round(math.erfc(math.sqrt(x / 2)), 6) for x in (0.1, 0, 49 / 12)]


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    assert [round(r[0], 6) for r in df.select(stats.cosine("a", "b")).collect()] == [0.707107, 0.0]
    with pytest.raises(Exception, match="different sizes"):
        spark.createDataFrame([([1.0], [1.0, 1.0])], "a array<float>, b array<float>").select(stats.cosine("a", "b")).collect()


def test_ast_forms():
    assert code.ast_form("def f(a):\n    return a + 1") == code.ast_form("def g(b):\n    return b + 1")
    assert code.ast_form("x = 1") != code.ast_form("x = 2") and code.ast_form("x =") is None and code.ast_form(None) is None
    assert code.multiset_jaccard("x = 1", "x = 1") == 1 and code.multiset_jaccard("x =", "y =") == 0


def test_code_walks():
    assert code.cut_after_top_level("int f() { return 0; }\n// The rest is prose") == "int f() { return 0; }"
    assert code.cut_after_top_level("int f() { }\nint g() { }") == "int f() { }\nint g() { }"
    assert code.cut_after_top_level('int f() { char *s = "}"; /* } */ }\nThis program is safe') == 'int f() { char *s = "}"; /* } */ }'
    assert code.body_of("void f() { if (x) { y(); } } z") == "{ if (x) { y(); } }" and code.body_of("no") is None


def test_hash_vector():
    v = code.hash_vector("a", 64)
    assert len(v) == 64 and math.isclose(sum(x * x for x in v), 1) and code.hash_vector("a") == code.hash_vector("a")


def test_more_code_rules(spark):
    two = "int main() { a(); }\nint main() { b(); }"
    assert values(spark, text.drop_second_main("x"), [two, "int main() { }", "x"]) == ["int main() { a(); }", "int main() { }", "x"]
    py = F.lit("python")
    assert values(spark, text.is_stub("x", py), ["t\n```python\ndef compute_all(values):\n    # TODO: Implement\n    total = 0\n    pass\n```", "```python\ndef compute(x):\n    y = x * 2\n    return y + 1\n```"]) == [True, False]
    assert values(spark, text.reframe("x", py, F.lit("CWE-79")), ["a\n```\nb\n```"]) == ["# Secure against CWE-79\nb\n"]
    assert values(spark, text.with_exemplar(F.lit("p"), "x", "Be safe."), ["e", None]) == ["Example of a secure solution:\ne\n\np", "Be safe.\n\np"]
    assert code.splice("int g();\nvoid f(int x) { y(); }\nend", "f") == ("int g();\nvoid f(int x) {", " y(); ", "}\nend") and code.splice("x", "f") is None
    found = code.marked_split("#include <a>\n// BEGIN PROMPT\ndo it\n// BEGIN SOLUTION\nint f(char *s) { return '}' == *s; }\nint g() {}")
    assert found == {"prompt": "do it", "signature": "int f(char *s)", "prefix": "#include <a>", "suffix": "\nint g() {}"} and code.marked_split("x") is None
    assert spark.range(1).select(code.spliced(F.lit("f() { a }"), F.lit("f")).alias("s")).first().s == ["f() {", " a ", "}"]
