"""Text rules as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words, markers and phrases that the rules name.
INSTRUCTION_VERBS = ("complete", "implement", "write", "rewrite", "fix", "patch", "produce", "generate", "create", "modify", "refactor", "review", "return", "respond")
CODE_ONLY_MARKERS = ("return only", "respond with only", "no commentary", "no preamble", "no markdown fences", "only return the code", "wrap your code in")
CONTINUATION_MARKERS = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|file_separator|>", "<|fim_prefix|>", "<|fim_middle|>", "<|fim_suffix|>", "<|fim_pad|>", "<|endofcompletion|>", "<|end|>", "<|user|>", "<|assistant|>", "</s>", "<eos>", "<|EOT|>", "/* Original program", "# Original program", "// Original program", "/* The above program")
REFUSALS = ("i cannot", "i can't", "i will not", "i won't", "i'm not able to", "i am not able to", "as an ai", "sorry, but", "i'm sorry, but")
CODE_MARKERS = ("def ", "class ", "import ", "#include", "int main")
PY_TRIVIAL = ("pass", "...", "return", "return none", "return 0", 'return ""', "return ''", "return []", "return {}", "raise notimplementederror", "raise notimplementederror()")
C_TRIVIAL = ("", "return 0;", "return;", "return 1;", "return -1;", "exit(0);")
CPP_HINTS = (r"\bclass\s+\w+", r"\bnamespace\s+\w+", r"\btemplate\s*<", "::", r"\bstd::")
FENCE = r"(?s)```(?:python|py|cpp|c\+\+|c)?[ \t]*\n(.*?)```"
OPEN_FENCE = r"(?s)```(?:python|py|cpp|c\+\+|c)?[ \t]*\n(.*)$"
#: White space and line ends in Unicode's sense, as classes that Java's expressions and RE2 both read.
WHITE = r"[\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
LINE_END = r"\r\n|[\n-\r\x1c-\x1e\x85\x{2028}\x{2029}]"
TOKEN = r"cwe-[0-9]+|cve-[0-9]+(?:-[0-9]+)+|[a-z_][a-z0-9_]*|[0-9]+"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def string_normalize(text) -> Column:
    """Comments out, blanks collapsed, trimmed, lower case."""
    c = F.regexp_replace(col(text), r"(?s)/\*.*?\*/", " ")
    c = F.regexp_replace(F.regexp_replace(c, r"//[^\n]*", ""), r"#[^\n]*", "")
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def content_id(source, *parts) -> Column:
    """source, a colon and 16 hex digits of the SHA-256 of the parts, each behind it a NUL."""
    joined = F.concat(*[x for p in parts for x in (col(p), F.char(F.lit(0)))])
    return F.concat(col(source), F.lit(":"), F.substring(F.sha2(joined, 256), 1, 16))


def canonical_hash(text) -> Column:
    """SHA-256 with line ends unified, trailing blanks cut, one line feed at the end."""
    body = F.regexp_replace(F.replace(col(text), F.lit("\r\n"), F.lit("\n")), r"\s+$", "")
    return F.sha2(F.concat(body, F.lit("\n")), 256)


def retrieval_tokens(text) -> Column:
    """camelCase split, lower case, identifiers, numbers, and weakness ids whole."""
    return F.regexp_extract_all(F.lower(F.regexp_replace(col(text), "([a-z])([A-Z])", "$1 $2")), F.lit(TOKEN), F.lit(0))


def identifiers(text) -> Column:
    return F.array_distinct(F.regexp_extract_all(col(text), F.lit(r"[A-Za-z_][A-Za-z0-9_]*"), F.lit(0)))


def well_formed_prompt(text) -> Column:
    """An instruction verb in the first 200 characters, and a code-only marker or a fence."""
    verb = F.substring(col(text), 1, 200).rlike(r"(?i)\b(?:" + "|".join(INSTRUCTION_VERBS) + r")\b")
    marker = any_of([F.lower(col(text)).contains(m) for m in CODE_ONLY_MARKERS])
    return verb & (marker | col(text).rlike(r"```\s*(?:python|py|c|cpp|c\+\+)?\b"))


def truncate_continuation(text) -> Column:
    """The text before the first continuation marker."""
    places = [F.when(F.instr(col(text), m) > 0, F.instr(col(text), m)) for m in CONTINUATION_MARKERS]
    return F.substr(col(text), F.lit(1), F.coalesce(F.least(*places) - 1, F.length(col(text))))


def strip_open_comment(text) -> Column:
    """Without a block comment that is opened last and never closed."""
    back = F.reverse(col(text))
    opened = F.when(F.instr(back, "*/") > 0, F.length(col(text)) - F.instr(back, "*/")).otherwise(0)
    closed = F.when(F.instr(back, "/*") > 0, F.length(col(text)) - F.instr(back, "/*")).otherwise(0)
    return F.when((opened == 0) | (closed > opened), col(text)).otherwise(F.regexp_replace(F.substr(col(text), F.lit(1), opened - 1), r"\s+$", ""))


def fenced_code(text) -> Column:
    """All closed fences, trimmed, with a blank line between; else what follows an open fence; else the text."""
    found = F.transform(F.regexp_extract_all(col(text), F.lit(FENCE), F.lit(1)), lambda m: F.regexp_replace(m, r"^\s+|\s+$", ""))
    tail = F.regexp_replace(F.regexp_extract(col(text), OPEN_FENCE, 1), r"\s*(```)?\s*$", "")
    return F.when(F.size(found) > 0, F.array_join(found, "\n\n")).when(col(text).rlike(OPEN_FENCE), tail).otherwise(col(text))


def strip(text) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(col(text), rf"^{WHITE}+|{WHITE}+\z", "")


def lines(text) -> Column:
    """The lines that are not blank, whatever ends them."""
    return F.filter(F.split(col(text), LINE_END), lambda x: strip(x) != "")


def code_lines(text) -> Column:
    """The lines that are neither blank nor a comment."""
    return F.filter(lines(text), lambda x: ~strip(x).startswith("#") & ~strip(x).startswith("//"))


def _python_inner(kept: Column) -> Column:
    """What these lines hold below a def or class in the first of them, else all of it; lower case."""
    trimmed = F.transform(kept, lambda x: strip(x))
    head = F.coalesce(F.try_element_at(trimmed, F.lit(1)), F.lit(""))
    below = F.array_join(F.slice(trimmed, 2, 1000000), " ")
    return F.lower(strip(F.when(head.startswith("def ") | head.startswith("class "), below).otherwise(F.array_join(kept, "\n"))))


def refusal(text) -> Column:
    """The first line that is not blank begins with a refusal, and no code marker is in the text."""
    first = F.lower(strip(F.coalesce(F.try_element_at(lines(text), F.lit(1)), F.lit(""))))
    return ~any_of([col(text).contains(m) for m in CODE_MARKERS]) & any_of([first.startswith(p) for p in REFUSALS])


def stub_reason(text, language) -> Column:
    """Why a completion counts as a stub, or null: too little code, or a trivial body."""
    kept = code_lines(text)
    body = F.lower(strip(F.array_join(kept, "\n")))
    short = F.length(F.regexp_replace(F.array_join(kept, "\n"), "[ \\t]", "")) < 20
    inner = _python_inner(kept)
    trivial_py = any_of([inner.endswith(t) & (F.length(inner) <= len(t) + 4) for t in PY_TRIVIAL])
    opened, closed = F.instr(body, "{"), F.length(body) - F.instr(F.reverse(body), "}") + 1
    has_body = (opened > 0) & (F.instr(F.reverse(body), "}") > 0) & (opened < closed)
    between = F.when(has_body, strip(F.substr(body, opened + 1, closed - opened - 1))).otherwise(body)
    return F.when(short, F.lit("short")).when((F.lower(col(language)) == "python") & trivial_py, F.lit("py_trivial")).when(F.lower(col(language)).isin("c", "cpp", "c++") & between.isin(*C_TRIVIAL), F.lit("c_trivial"))


def cpp_or_c(text) -> Column:
    return F.when(any_of([col(text).rlike(p) for p in CPP_HINTS]), F.lit("cpp")).otherwise(F.lit("c"))


def signature_hint(text) -> Column:
    """The first line with a parenthesis that is no comment and no directive, without a brace at its end."""
    found = F.filter(F.transform(lines(text), lambda x: strip(x)), lambda x: ~x.startswith("//") & ~x.startswith("/*") & ~x.startswith("*") & ~x.startswith("#") & x.contains("("))
    return strip(F.regexp_replace(F.try_element_at(found, F.lit(1)), r"\{+\z", ""))


def drop_second_main(text) -> Column:
    """The text before the second main function."""
    pattern = r"\b(?:int|void)\s+main\s*\("
    head = F.regexp_extract(col(text), rf"(?s)^(.*?{pattern}.*?){pattern}", 1)
    return F.when(head != "", F.regexp_replace(head, r"\s+$", "")).otherwise(col(text))


def first_fence(text) -> Column:
    """The first closed fence of any language, else the text."""
    found = F.regexp_extract_all(col(text), F.lit(r"(?s)```(?:[a-zA-Z0-9_+-]+)?\n(.*?)```"), F.lit(1))
    return F.coalesce(F.try_element_at(found, F.lit(1)), col(text))


def is_stub(text, language) -> Column:
    """The evaluation's rule: the first fence counts, and a scaffold left to do with hardly more than pass is a stub too."""
    code = first_fence(text)
    inner = _python_inner(code_lines(code))
    left = F.length(strip(F.replace(inner, F.lit("pass"), F.lit(""))))
    scaffold = (F.lower(col(language)) == "python") & code.rlike(r"(?i)#\s*TODO[: ]\s*Implement") & inner.contains("pass") & (left < 30)
    return stub_reason(code, language).isNotNull() | scaffold


def reframe(text, language, cwe) -> Column:
    """A prompt for a model that only goes on: the fenced body behind a comment that names the weakness."""
    mark = F.when(col(language) == "python", "# ").otherwise("// ")
    return F.concat(mark, F.lit("Secure against "), col(cwe), F.lit("\n"), first_fence(text))


def with_exemplar(text, exemplar, instruction: str | None = None) -> Column:
    """A retrieved exemplar, or else an instruction, in front of the prompt; nothing where there is neither."""
    shown = F.concat(F.lit("Example of a secure solution:\n"), col(exemplar), F.lit("\n\n"))
    return F.concat(F.coalesce(shown, F.lit("" if instruction is None else instruction + "\n\n")), col(text))
