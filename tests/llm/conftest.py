import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n, words=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(words)}" for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Documents with nulls, empty and long texts, copies, near copies, shared passages and repeated rows."""
    base = prose(1, 300)
    near = base.split()
    near[150] = "changed"
    passage = prose(2, 60)
    long = prose(3, 6000, 100000)
    texts = [base, base, " ".join(near), prose(4, 30) + "\n" + passage + "\n" + prose(5, 30), prose(6, 40) + " " + passage + " " + prose(7, 10), long, long[2000:9000], "", None, "short text", "der " * 200, "der " * 150, "aaaa" * 300, "  \n\t ", "one", "One", "été élan ça " * 20, prose(8, 90).upper(), "x y " + prose(9, 25)]
    out = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    out.append(out[3])  # a repeated row
    out.append((None, prose(10, 80), None, None, 1))
    out.append((None, base, "en", "s", 1))
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(docs):
    """Extra columns whose names operators may use themselves."""
    from pyspark.sql import functions as F

    names = ["k", "th", "key", "component", "n", "s", "a", "b", "base", "runs", "hits", "score", "kept", "signature", "range", "shard", "size", "h", "p", "id", "y", "grams", "payload", "digest"]
    return docs.select("*", *[F.lit(7).alias(n) for n in names])
