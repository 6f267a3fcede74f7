"""Archives, tokens, shards, leaks and the pipeline."""

import base64
import hashlib
import random
import re
from zlib import crc32

import public_tokenizers
import pyarrow.fs
import pytest
import tiktoken

from tesseral.llm import bpe, decontaminate, sharding, warc


def sha1(text):
    return hashlib.sha1((text or "").encode()).hexdigest()


def test_archives_resolve_revisits(spark):
    big, other = "é" * 800, "b" * 999
    rows = [(1, "http://a", big), (5, "http://b\r\nx", big), (3, None, big), (2, "u", other), (9, "u", other), (4, "u", None), (6, "u", ""), (7, "u", "c" * 1000), (8, "u", "c" * 1000), (None, "u", big), (5, "again", big), (10, "u", "x\r\n\r\ny" * 400)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", pyspark_lit(1)).withColumn("id", pyspark_lit(2))
    got = warc.archive(pages).collect()
    original = {big: 5, "c" * 1000: 8}

    def want(page, html):
        n = len((html or "").encode())
        to = original.get(html) if n >= 1000 else None
        visits = to is not None and to != page
        return (page, n, sha1(html), "revisit" if visits else "response", to if visits else None)

    assert sorted(map(str, [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got])) == sorted(str(want(p, h)) for p, _, h in rows)
    assert warc.archive(pages.limit(0)).count() == 0


def pyspark_lit(x):
    from pyspark.sql import functions as F

    return F.lit(x)


def test_archives_hold_what_was_written(spark, tmp_path):
    """Payloads round-trip byte by byte, over several files."""
    r = random.Random(1)
    rows = [(i, f"http://h/{i}", "".join(chr(r.randrange(1, 500)) for _ in range(r.randrange(0, 3000)))) for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    manifest = warc.write_archives(pages, f"file://{tmp_path}/w", file_bytes=20_000).collect()
    assert len(manifest) > 4 and sum(m.records for m in manifest) == 60
    found = {}
    for m in manifest:
        store, place = pyarrow.fs.FileSystem.from_uri(m.path)
        with store.open_input_stream(place, compression=None) as f:
            for head, block in warc.Records(f):
                if head["WARC-Type"] == "response":
                    found[int(head["X-Page-Id"])] = block.split(b"\r\n\r\n", 1)[1].decode()
    assert found == {i: h for i, _, h in rows}


@pytest.fixture(scope="module")
def encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def hard_texts():
    r = random.Random(7)
    pools = ["ab ", " \n\t\r 　 \x85", "0123½²Ⅷ", "'sd'll've", "éÀñ中文字ßﬁ", "😀👩‍👩\U0001f1e9", "!?#%&**", "aaaa", "\x00\x01\x7f", "<|endoftext|>"]
    out = ["".join(r.choice(r.choice(pools)) for _ in range(r.randrange(1, 200))) for _ in range(300)]
    return [*out, "", None, " ", "   x", "a" * 3000, " " * 3000, "word " * 1000, "".join(map(chr, range(1, 0x3000)))]


def test_bpe_like_tiktoken(spark, encoding, monkeypatch):
    texts = hard_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 AS ids", "2 AS n_tokens")
    monkeypatch.setattr(bpe, "PART", 500)
    for r in bpe.round_trip(docs).collect():
        text = texts[r.doc_id] or ""
        ids = encoding.encode_ordinary(text)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()), text
    assert bpe.round_trip(docs.limit(0)).count() == 0


def test_bpe_parts_and_small_cache(encoding, monkeypatch):
    codec = bpe.Codec(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    monkeypatch.setattr(bpe, "PART", 50)
    monkeypatch.setattr(bpe, "CACHE", 20)
    for text in hard_texts():
        if text:
            assert codec.encode(text) == encoding.encode_ordinary(text)


def test_bpe_parts_at_the_real_limit(encoding):
    """Long texts are cut only where the pattern begins a match: not at characters that it does not hold for blanks."""
    codec = bpe.Codec(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    for blank in ("\x1c", "\x1f", "\x85", "\u3000", " ", "\n\n"):
        text = "ab! " * (bpe.PART // 4 - 3) + "!" * 20 + blank + "!" * 10 + " é" * 20 + blank * 3 + "end"
        parts = list(codec.parts(text))
        assert "".join(parts) == text
        assert [m for p in parts for m in codec.find(p)] == codec.find(text)
        assert codec.encode(text) == encoding.encode_ordinary(text)
    assert len(list(codec.parts("ab! " * bpe.PART))) > 2
    other = bpe.Codec(public_tokenizers.path("byte_bpe_50k.tiktoken"), r"\s*\S+\s*|\s+")
    assert len(list(other.parts("ab! " * bpe.PART))) == 1


def test_bpe_offsets_and_decoding(spark):
    texts = ["a 😀 b", "中文", "é", None, "plain text"]
    tokens = bpe.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    for r in tokens.collect():
        text = texts[r.doc_id] or ""
        assert all(0 <= a < b <= len(text) for a, b in zip(r.starts, r.ends, strict=True))
        assert not text or (r.starts[0] == 0 and r.ends[-1] == len(text))
    for r in bpe.decode(tokens).collect():
        assert r.text == (texts[r.doc_id] or "") and bytes(r.bytes) == r.text.encode()
    broken = spark.createDataFrame([(1, tokens.where("doc_id = 0").first().ids[:3]), (2, None)], "doc_id long, ids array<int>")
    assert {r.doc_id for r in bpe.decode(broken).collect()} == {1, 2}


def shard_laws(rows, got, n):
    assert sorted(str((r.doc_id, r.size, r.text_crc32)) for r in got) == sorted(str((i, len((t or "").encode()) + 1, crc32((t or "").encode()))) for i, t in rows)
    for s in range(n):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert all(r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < n for r in got)


def test_shards_of_equal_size(spark):
    r = random.Random(2)
    rows = [(i, "t" * r.randrange(0, 400)) for i in range(3000)] + [(9000 + i, "hot " * 50) for i in range(1500)] + [(None, None), (None, None), (7, "x")] + [(1, "same")] * 5
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS k", "2 AS shard", "3 AS size", "4 AS h")
    got = sharding.assign_shards(df, 8).collect()
    shard_laws(rows, got, 8)
    sizes = [sum(x.size for x in got if x.shard == s) for s in range(8)]
    assert max(sizes) - min(sizes) < 0.05 * sum(sizes) / 8
    again = {(x.doc_id, x.text_crc32): x.shard for x in sharding.assign_shards(df.repartition(5), 8).collect() if x.doc_id not in (None, 1)}
    assert again == {(x.doc_id, x.text_crc32): x.shard for x in got if x.doc_id not in (None, 1)}


def test_shards_of_few_rows(spark, docs, rows):
    shard_laws([(r[0], r[1]) for r in rows], sharding.assign_shards(docs, 8).collect(), 8)
    assert sharding.assign_shards(docs.limit(0)).count() == 0
    one = spark.createDataFrame([(1, None)], "doc_id long, text string")
    assert [(r.slot, r.size, r.text_crc32) for r in sharding.assign_shards(one).collect()] == [(0, 1, 0)]


def test_shards_use_no_python(spark, docs):
    plan = sharding.assign_shards(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def distance_in(pattern, text):
    """The least edits between the pattern and any part of the text."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != t), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def normal(text):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_leaks_like_brute_force(spark):
    r = random.Random(4)
    prose = lambda n: [f"w{r.randrange(60)}" for _ in range(n)]
    items = [(i, " ".join(prose(r.randrange(1, 40)))) for i in range(25)] + [(90, ""), (91, None), (None, "w1 w2"), (92, "One, two; THREE.")]
    rows = []
    for i in range(150):
        own = prose(r.randrange(0, 60))
        leak = items[r.randrange(25)][1].split()
        for _ in range(r.randrange(0, 2 + len(leak) // 5)):
            at = r.randrange(len(leak)) if leak else 0
            leak[at : at + r.randrange(0, 2)] = prose(r.randrange(0, 2))
        rows.append((i, " ".join(own + leak + prose(20)) if i % 2 else " ".join(own)))
    rows += [(500, None), (501, ""), (502, "xx one two -- three yy"), (502, "xx one two -- three yy"), (None, "ONE TWO THREE")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS item_id", "2 AS hits")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = []
    for doc, text in rows:
        words = normal(text)
        found = sorted((i for i, t in items if normal(t) and distance_in(normal(t), words) <= len(normal(t)) // 5), key=lambda i: (i is None, i or 0))
        want.append(str((doc, bool(found), found)))
    got = decontaminate.leaks(docs, bench).collect()
    assert sorted(str((x.doc_id, x.contaminated, x["items"])) for x in got) == sorted(want)
    small = decontaminate.Block.of
    assert small is decontaminate.Block.of and decontaminate.leaks(docs.limit(0), bench).count() == 0
    assert not any(x.contaminated for x in decontaminate.leaks(docs, bench.limit(0)).collect())


def test_leaks_in_many_blocks(spark):
    rows = [(i, f"start here a{i} b{i} c{i} d{i} e{i} end") for i in range(20)]
    items = [(i, f"a{i} b{i} c{i} d{i} e{i}") for i in range(0, 20, 2)]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    old = decontaminate.blocks.__defaults__
    decontaminate.blocks.__defaults__ = (30,)
    try:
        assert {x.doc_id: x["items"] for x in decontaminate.leaks(docs, bench).collect()} == {i: [i] if i % 2 == 0 else [] for i in range(20)}
        assert {x.doc_id for x in decontaminate.drop_leaks(docs, bench).collect()} == set(range(1, 20, 2))
    finally:
        decontaminate.blocks.__defaults__ = old


def test_myers_like_table():
    r = random.Random(9)
    for _ in range(200):
        pattern, text = ([r.randrange(4) for _ in range(r.randrange(1, 90))], [r.randrange(4) for _ in range(r.randrange(0, 60))])
        masks = {}
        for i, w in enumerate(pattern):
            masks[w] = masks.get(w, 0) | 1 << i
        found = decontaminate.myers(masks, len(pattern), text, len(pattern))
        best = min([d for _, d in found], default=len(pattern))
        assert min(best, len(pattern)) == distance_in(pattern, text)
