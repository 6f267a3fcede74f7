"""MinHash near-duplicates by a multi-index Hamming join.

A set's signature has 48 slots of 16 bits. Two sets are candidates if at most 23 slots differ; at a similarity of 0.85 a
slot differs with probability 0.15, and more than 23 of 48 do so about once in 10**8 pairs. The slots are split into 12
chunks of 4: of at most 23 differing slots, some chunk has at most one (pigeonhole). Leaving out each slot of a chunk in
turn enumerates all chunk errors, so such a pair shares one of 48 keys for certain.

Pairs of a bucket are never all emitted. First every member is compared with the bucket's smallest id; links that hold
on the full sets join components. Only buckets that still span components are looked at again, in blocks, for pairs of
different components whose signatures are close enough and whose sketches leave a link open; those that hold on the full
sets join components in a second pass. So no link that could join two components is missed (but for the odds of the
signatures and sketches), and a group of copies costs one comparison for each member.

The odds: a pair at the limit is missed by its signature with 1.4 in 10**8 at a similarity of 0.85, and with 3.4 in 10**6
at 0.8; a sketch, which counts only for sets of more than SKETCH shingles, refuses such a pair with less than 1 in 10**6.
deviations=None leaves the sketches out, so that every close pair is compared in full.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .common import drop_stash, id_of, key, stash, text_of
from .components import components

SLOTS, CHUNK, MAX_DIFFERENT = 48, 4, 23
#: Members of a bucket on either side of one task's comparisons, and rows of a hot set that one task verifies.
BLOCK = 1024
SALT_ROWS = 512
#: Least hashes of a set that stand for it where buckets span components; smaller sets are held whole.
SKETCH = 256
#: How far below the limit a sketch's share may lie for the pair to be compared in full.
DEVIATIONS = 5.0

_rng = np.random.default_rng(6)
_MULTIPLY = (_rng.integers(1, 2**63, SLOTS, dtype=np.uint64) << K.U(1)) | K.U(1)
_ADD = _rng.integers(0, 2**63, SLOTS, dtype=np.uint64)


def shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes row by row, and where each row's begin. A row with fewer words has all of them as one."""
    starts, ends, bounds = K.words(data, offsets)
    hashes = K.word_hashes(K.LOWER[data], starts, ends)
    at = np.flatnonzero(K.valid_starts(bounds, size, len(hashes)))
    grams = K.ngram_hashes(hashes, size)[at] if len(at) else np.zeros(0, K.U)
    rows = K.row_of(bounds[:-1], at)
    count = np.diff(bounds)
    for row in np.flatnonzero((count > 0) & (count < size)):
        own = hashes[bounds[row] : bounds[row + 1]]
        grams = np.append(grams, K.mix(K.ngram_hashes(own, len(own)) + K.U(len(own))))
        rows = np.append(rows, row)
    order = np.lexsort((grams, rows))
    grams, rows = grams[order], rows[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (rows[1:] != rows[:-1])
    grams, rows = grams[new], rows[new]
    return grams, np.searchsorted(rows, np.arange(len(offsets)))


def signatures(grams: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Row by row the 16-bit minima; rows without shingles have zeros."""
    out = np.zeros((len(bounds) - 1, SLOTS), np.uint16)
    some = np.flatnonzero(np.diff(bounds))
    if len(some):
        for slot in range(SLOTS):
            values = grams * _MULTIPLY[slot] + _ADD[slot]
            values ^= values >> K.U(32)
            values *= K.U(0xD6E8FEB86659FD93)
            out[some, slot] = (np.minimum.reduceat(values, bounds[some]) >> K.U(24)).astype(np.uint16)
    return out


def keys_of(signature: np.ndarray) -> np.ndarray:
    """The 48 keys of each row: chunk, left-out slot, and the chunk's other slots."""
    out = np.empty(signature.shape, np.uint64)
    for chunk in range(SLOTS // CHUNK):
        own = signature[:, chunk * CHUNK : (chunk + 1) * CHUNK].astype(np.uint64)
        for gap in range(CHUNK):
            rest = [i for i in range(CHUNK) if i != gap]
            out[:, chunk * CHUNK + gap] = own[:, rest[0]] | own[:, rest[1]] << K.U(16) | own[:, rest[2]] << K.U(32) | K.U(chunk * CHUNK + gap) << K.U(48)
    return out


def describe(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(k, n, s1, s2, signature): size and a 128-bit digest of the set, order-free."""

    def run(batches):
        for batch in batches:
            for i, j, data, offsets in K.chunks(batch.column(1)):
                grams, bounds = shingles(data, offsets, size)
                sums = [np.concatenate([np.zeros(1, K.U), np.cumsum(K.mix(grams + K.U(add)))]) for add in (1, 0x5851F42D4C957F2D)]
                sums = [K.signed(s[bounds[1:]] - s[bounds[:-1]]) for s in sums]
                packed = signatures(grams, bounds)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(bounds)), *sums, pa.array([row.tobytes() for row in packed], pa.binary())], names=["k", "n", "s1", "s2", "signature"])

    return docs.select(key(id_col, text_col).alias("k"), text_of(text_col).alias("text")).mapInArrow(run, "k long, n long, s1 long, s2 long, signature binary")


def _buckets(sets: DataFrame) -> DataFrame:
    """(key, k, a) for every key that two or more of the sets have; a is its least k.

    One shuffle of the keys; each partition is read sorted, so a key's first row and its next one decide.
    """

    def enumerate_keys(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                part = batch.slice(i, 4096)
                signature = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint16).reshape(-1, SLOTS)
                yield pa.RecordBatch.from_arrays([K.signed(keys_of(signature).reshape(-1)), pa.array(np.repeat(part.column(0).to_numpy(), SLOTS))], names=["key", "k"])

    def shared(batches):
        last = None  # key, first k, whether the first row was given out
        for batch in batches:
            key, k = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(key):
                continue
            if last is not None:  # the open key's first row stands before the batch
                key, k = np.concatenate([[last[0]], key]), np.concatenate([[last[1]], k])
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            heads = np.flatnonzero(new)
            head = heads[np.cumsum(new) - 1]
            many = np.diff(np.append(heads, len(key)))[np.cumsum(new) - 1] > 1
            if last is not None and last[2]:
                many[0] = False
            given = bool(many[heads[-1]]) or (last is not None and last[2] and heads[-1] == 0)
            last = (key[heads[-1]], k[heads[-1]], given)
            many &= ~((np.arange(len(key)) != head) & (k == k[head]))  # one id under two sets is no pair
            yield pa.RecordBatch.from_arrays([pa.array(key[many]), pa.array(k[many]), pa.array(k[head][many])], names=["key", "k", "a"])

    parts = max(1, int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = sets.select("k", "signature").mapInArrow(enumerate_keys, "key long, k long")
    return keys.repartition(parts, "key").sortWithinPartitions("key", "k").mapInArrow(shared, "key long, k long, a long")


def _sketches(texts: DataFrame, size: int) -> DataFrame:
    """(k, sketch): the SKETCH least shingle hashes of each text, cut to 32 bits, ascending."""

    def run(batches):
        for batch in batches:
            for i, j, data, offsets in K.chunks(batch.column("text")):
                grams, bounds = shingles(data, offsets, size)
                least = (grams >> K.U(32)).astype(np.uint32)
                yield pa.RecordBatch.from_arrays([batch.column("k").slice(i, j - i), pa.array([least[a : min(b, a + SKETCH)].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())], names=["k", "sketch"])

    return texts.select("k", "text").mapInArrow(run, "k long, sketch binary")


def promising(a: np.ndarray, b: np.ndarray, percent: int, deviations: float | None = DEVIATIONS) -> bool:
    """Whether two sketches leave a similarity of percent open: sure for whole sets, else by so many standard deviations."""
    if deviations is None:
        return True
    both = np.intersect1d(a, b)
    if len(a) < SKETCH and len(b) < SKETCH:
        return 100 * (len(both) + 1) >= percent * (len(a) + len(b) - len(both))
    union = np.union1d(a, b)[:SKETCH]
    share, wanted = np.searchsorted(both, union[-1], "right") / len(union), percent / 100
    return share >= wanted - deviations * np.sqrt(wanted * (1 - wanted) / len(union))


def _close(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose signatures differ in at most MAX_DIFFERENT slots."""
    own = sets.select("k", "signature")
    both = pairs.join(own.withColumnsRenamed({"k": "a", "signature": "x"}), "a").join(own.withColumnsRenamed({"k": "b", "signature": "y"}), "b").select("a", "b", "x", "y")

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, SLOTS) for c in ("x", "y"))
                yield batch.select(["a", "b"]).filter(pa.array((x != y).sum(axis=1) <= MAX_DIFFERENT))

    return both.mapInArrow(run, "a long, b long")


def _verify(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union.

    Each text goes once to the tasks of every partner that it is compared with; a partner with many rows is dealt to
    several tasks. A task holds one such partner's set at a time and reads the others past it. Pairs and counts are
    tables, so that a join with a hot partner stands alone in its stage, where skewed partitions are split.
    """
    pairs = stash(pairs, "near-pairs")
    salts = F.greatest(F.lit(1), F.ceil(F.count("*") / SALT_ROWS).cast("int"))
    per = stash(pairs.groupBy("a").agg(salts.alias("salts")), "near-partners")
    hubs = per.join(texts, per["a"] == texts["k"]).select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "a", "text", F.lit(False).alias("past")).toDF("a", "salt", "b", "text", "past")
    dealt = pairs.join(per, "a").select("a", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), "b")
    rows = dealt.join(texts, dealt["b"] == texts["k"]).select("a", "salt", "b", "text", F.lit(True).alias("past")).unionAll(hubs)
    parts = max(1, int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.repartition(parts, "a", "salt").sortWithinPartitions("a", "salt", "past")

    def run(batches):
        hub, held = None, np.zeros(0, K.U)
        for batch in batches:
            linked = ([], [])
            a_all, salt_all, b_all = (batch.column(c).to_numpy() for c in ("a", "salt", "b"))
            past = batch.column("past").to_pylist()
            for i, _, data, offsets in K.chunks(batch.column("text")):
                grams, bounds = shingles(data, offsets, size)
                for row in range(len(offsets) - 1):
                    own = grams[bounds[row] : bounds[row + 1]]
                    a, salt, b = a_all[i + row], salt_all[i + row], b_all[i + row]
                    if not past[i + row]:
                        hub, held = (a, salt), own.copy()
                    elif hub == (a, salt) and len(held) and len(own):
                        at = np.minimum(np.searchsorted(held, own), len(held) - 1)
                        both = int((held[at] == own).sum())
                        if 100 * both >= percent * (len(held) + len(own) - both):
                            linked[0].append(a)
                            linked[1].append(b)
            yield pa.RecordBatch.from_arrays([pa.array(linked[0], pa.int64()), pa.array(linked[1], pa.int64())], names=["u", "v"])

    out = rows.mapInArrow(run, "u long, v long")
    out._used = (pairs, per)
    return out


def _verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int, more: DataFrame | None = None) -> DataFrame:
    """_verify's links and those of more, as a table."""
    found = _verify(pairs, texts, size, percent)
    out = stash(found.unionAll(more) if more is not None else found, "near-links")
    drop_stash(*found._used)
    return out


def _across(buckets: DataFrame, percent: int, deviations: float | None) -> DataFrame:
    """Pairs (a, b) of different components in the buckets (key, k, component, signature, sketch) that may be links.

    A bucket's most common component, and its other members, are cut in blocks. Every pair of blocks is a task of its
    own: other members against the most common component, and other members among themselves; so no task holds more
    than two blocks. Of the buckets that a pair shares only the first gives it.
    """
    per = buckets.groupBy("key", "component").agg(F.count("*").alias("rows")).groupBy("key").agg(F.max_by("component", F.struct("rows", "component")).alias("most"), F.max("rows").alias("rows"), F.sum("rows").alias("all"))
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(n / BLOCK).cast("int"))
    per = stash(per.select("key", "most", blocks(F.col("rows")).alias("blocks"), blocks(F.col("all") - F.col("rows")).alias("others")), "near-blocks")
    rows = buckets.join(per, "key").withColumn("major", F.col("component") == F.col("most"))
    own = F.pmod(F.xxhash64("k"), F.when(F.col("major"), F.col("blocks")).otherwise(F.col("others"))).cast("int")
    rows = rows.withColumn("own", own)
    to = lambda n, f: F.transform(F.sequence(F.lit(0), F.col(n) - 1), f)
    task = lambda kind, a, b, left: F.struct(F.lit(kind).alias("kind"), a.alias("x"), b.alias("y"), left.alias("left"))
    yes, no, o = F.lit(True), F.lit(False), F.col("own")
    with_major = F.when(F.col("major"), to("others", lambda i: task(0, o, i, no))).otherwise(to("blocks", lambda i: task(0, i, o, yes)))
    among = F.when(F.col("major"), F.array().cast("array<struct<kind:int,x:int,y:int,left:boolean>>")).otherwise(to("others", lambda i: task(1, F.least(i, o), F.greatest(i, o), o <= i)))
    rows = rows.select("key", F.explode(F.concat(with_major, among)).alias("t"), "k", "component", "signature", "sketch")
    rows = rows.select("key", "t.kind", "t.x", "t.y", "t.left", "k", "component", "signature", "sketch")
    parts = max(1, int(buckets.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.repartition(parts, "key", "kind", "x", "y").sortWithinPartitions("key", "kind", "x", "y")

    def close(key, signature, mine):
        """Rows of signature close to mine that no earlier key has put together with it."""
        apart = (signature != mine).reshape(len(signature), -1, CHUNK)
        per_chunk = apart.sum(axis=2)
        good = per_chunk <= 1
        chunk, gap = divmod((int(key) >> 48) & 0xFF, CHUNK)
        first = good.argmax(axis=1) == chunk
        own_gap = np.where(per_chunk[:, chunk] == 0, 0, apart[:, chunk].argmax(axis=1)) == gap
        return (per_chunk.sum(axis=1) <= MAX_DIFFERENT) & good[:, chunk] & first & own_gap

    def pairs(now, left, right):
        """Each of the left rows against the right ones; a block met with itself has left rows only."""
        key, kind, x, y = now
        found, itself = [], kind == 1 and x == y
        other = left if itself else right
        if left and other:
            k, c = (np.array([r[f] for r in other]) for f in (0, 1))
            signature = np.frombuffer(b"".join(r[2] for r in other), np.uint16).reshape(-1, SLOTS)
            for i, (own, component, mine, sketch) in enumerate(left):
                a = i + 1 if itself else 0
                if a == len(k):
                    break
                sketch = np.frombuffer(sketch, np.uint32)
                near = np.flatnonzero((c[a:] != component) & close(key, signature[a:], np.frombuffer(mine, np.uint16)))
                found += [(min(own, int(k[a + x])), max(own, int(k[a + x]))) for x in near if promising(sketch, np.frombuffer(other[a + x][3], np.uint32), percent, deviations)]
        return pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], names=["a", "b"])

    def run(batches):
        now, left, right = None, [], []
        for batch in batches:
            for key, kind, x, y, is_left, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (key, kind, x, y) != now:
                    if left:
                        yield pairs(now, left, right)
                    now, left, right = (key, kind, x, y), [], []
                (left if is_left else right).append(row)
        if left:
            yield pairs(now, left, right)

    out = rows.mapInArrow(run, "a long, b long")
    out._used = (per,)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, percent: int = 85, deviations: float | None = DEVIATIONS) -> DataFrame:
    """(k, n_shingles, component) for every row; k is the id, or a key above all ids for null.

    Words are [^\\x20\\x09-\\x0D]+ with A-Z lower-cased. A text of fewer words than a shingle has all of them as its one
    shingle; a null or empty text, or one of blanks, has none and is a component of its own. Rows that share an id get the
    smallest component that a row of that id is in (of different texts under one id that are first of their equals, one
    is searched); rows with a null id are told apart by their texts.
    """
    described = stash(describe(docs, id_col, text_col, size), "near-sets")
    equal = described.where("n > 0").groupBy("s1", "s2", "n").agg(F.min("k").alias("rep"), F.first("signature").alias("signature"))
    equal = stash(equal, "near-equal")  # one row for each different set
    sets = equal.groupBy(F.col("rep").alias("k")).agg(F.first("signature").alias("signature"))
    buckets = stash(_buckets(equal.select(F.col("rep").alias("k"), "signature")), "near-buckets")
    members = buckets.select("k").distinct()
    one = docs.select(key(id_col, text_col).alias("k"), text_of(text_col).alias("text"))
    texts = stash(one.join(members, "k", "left_semi"), "near-texts")  # the only pass that moves texts of all documents
    stars = buckets.where("k > a").select("a", F.col("k").alias("b")).distinct()
    first = _verified(_close(stars, sets), texts, size, percent)
    labels = stash(components(first), "near-labels")
    labelled = buckets.select("key", "k").join(labels.withColumnRenamed("id", "k"), "k", "left").select("key", "k", F.coalesce("component", "k").alias("component"))
    open_keys = labelled.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
    still = stash(labelled.join(open_keys, "key", "left_semi"), "near-open")
    asked = still.select("k").distinct()
    sketches = stash(_sketches(texts.join(asked, "k", "left_semi"), size).groupBy("k").agg(F.first("sketch").alias("sketch")), "near-sketches")
    rest = _across(still.join(sets, "k").join(sketches, "k"), percent, deviations)
    more = _verified(rest, texts, size, percent, first)
    drop_stash(*rest._used)
    copies = described.where("n > 0").join(equal.select("s1", "s2", "n", "rep"), ["s1", "s2", "n"]).where("k > rep").select(F.col("rep").alias("u"), F.col("k").alias("v"))
    labels2 = stash(components(more), "near-labels")
    # a copy follows its set's first row
    hung = copies.join(labels2.withColumnRenamed("id", "u"), "u", "left").select(F.col("v").alias("k"), F.coalesce("component", "u").alias("component"))
    found = hung.unionAll(labels2.select(F.col("id").alias("k"), "component")).groupBy("k").agg(F.min("component").alias("component"))
    out = stash(described.select("k", F.col("n").alias("n_shingles")).join(found, "k", "left").select("k", "n_shingles", F.coalesce("component", "k").alias("component")), "near-components")
    drop_stash(described, equal, buckets, texts, first, labels, still, sketches, more)
    return out


def clusters(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, percent: int = 85) -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row."""
    found = near_duplicates(docs, id_col, text_col, size, percent)
    return found.select(id_of("k").alias(id_col), "n_shingles", id_of("component").alias("component_id"), (F.col("k") == F.col("component")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """docs without the rows whose document is not the first of its component. Of rows that repeat an id all stay.

    A column named k may be among those of docs.
    """
    found = near_duplicates(docs, id_col, text_col, size, percent)
    gone = found.where("k <> component").select(F.col("k").alias("_near_k")).distinct()
    return docs.join(gone, key(id_col, text_col) == F.col("_near_k"), "left_anti")
