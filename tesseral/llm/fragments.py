"""Finding all repeated windows of a fixed length, with content-routed shards.

A text is a sequence of symbols (words or bytes). Every window of `window` symbols has an anchor: its k-gram with the
least hash, the leftmost of equal ones. Equal windows have equal anchors, so they meet if consecutive windows with one
anchor (a fragment) are routed by the anchor's hash. Only hashes are shuffled at first:

* fragments whose anchor no other fragment has hold no repeated window, and are dropped;
* of equal fragments the first stands for all (already within a batch, before the shuffle), so copies cost nothing more;
* different fragments under one anchor go, with their text, to a shard, where an index decides window by window;
* an anchor with very many different fragments is cut again with longer k-grams, at last with whole windows, so a common
  passage in ever new surroundings never meets in one task.

A window's place is (k, th, s): document key, hash of the text, first symbol. Rows that repeat id and text are one document.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import drop_stash, key_columns, stash

_SEGMENT = 1 << 20
_LOW = K.U((1 << 21) - 1)
#: Different fragments under one anchor that go to a shard; more are cut again.
HOT = 64
REMOVED, SHARD, CUT, MARKED = 1, 2, 3, 4
SLOT = "a long, fh long, k long, th long, base long, s long, n int, c int, kind int"


@dataclass(frozen=True)
class Plan:
    """window: length in symbols; anchors: k of each level, the last one the window itself; shard_rows: fragments a shard.

    symbols(data, offsets) gives hashes per symbol, the rows' bounds in symbols, and the bytes where symbols start and end.
    first_stays: of equal windows the first is not removed. search(contents, n, places, plan) gives for a shard's fragments,
    in the order of their places, the mask of the windows to remove, one after the other, and None; or, with a mark (a
    shorter length), a second mask of the symbols where a match of that length begins. places are (document, first symbol).
    """

    window: int
    anchors: tuple[int, ...]
    shard_rows: int
    first_stays: bool
    symbols: Callable
    search: Callable
    mark: int = 0


def anchor_places(grams: np.ndarray, width: int) -> np.ndarray:
    """For each run of width grams the place of the least, the leftmost of equal ones."""
    m = len(grams) - width + 1
    out = np.empty(max(0, m), np.int64)
    for a in range(0, m, _SEGMENT):
        b = min(m, a + _SEGMENT)
        own = grams[a : b + width - 1]
        out[a:b] = a + (K.sliding_min((own & ~_LOW) | np.arange(len(own), dtype=K.U), width) & _LOW).astype(np.int64)
    return out


def slice_hashes(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Hashes of slices of the values (which are hashes themselves); starts ascend, slices may overlap."""
    out = np.empty(len(starts), K.U)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + _SEGMENT)))
        a, b = int(starts[i]), int((starts[i:j] + sizes[i:j]).max())
        up, down = K.WORD_POWERS.get(b - a + 1)
        sums = np.zeros(b - a + 1, K.U)
        np.cumsum(values[a:b] * up[:-1], out=sums[1:])
        s = starts[i:j] - a
        out[i:j] = (sums[s + sizes[i:j]] - sums[s]) * down[s] + sizes[i:j].astype(K.U)
        i = j
    return K.mix(out)


def _batch(columns: dict) -> pa.RecordBatch:
    kinds = {"n": pa.int32(), "c": pa.int32(), "kind": pa.int32()}
    return pa.RecordBatch.from_arrays([pa.array(columns[c].view(np.int64) if columns[c].dtype == K.U else columns[c], kinds.get(c, pa.int64())) for c in ("a", "fh", "k", "th", "base", "s", "n", "c", "kind")], names=["a", "fh", "k", "th", "base", "s", "n", "c", "kind"])


def _merged(rows: dict, at: np.ndarray) -> dict:
    """The rows at these indices as removed runs, neighbouring ones joined."""
    at = at[np.lexsort((rows["s"][at], rows["base"][at], rows["th"][at], rows["k"][at]))]
    k, th, s, n = (rows[c][at] for c in ("k", "th", "s", "n"))
    new = np.ones(len(at), bool)
    new[1:] = (k[1:] != k[:-1]) | (th[1:] != th[:-1]) | (s[1:] > s[:-1] + n[:-1])
    first = np.flatnonzero(new)
    end = np.maximum.reduceat(s + n, first) if len(first) else s
    zero = np.zeros(len(first), np.int64)
    return {"a": zero, "fh": zero, "k": k[first], "th": th[first], "base": zero, "s": s[first], "n": end - s[first], "c": zero, "kind": zero + REMOVED}


def _scan(pieces: DataFrame, plan: Plan, k: int) -> DataFrame:
    """The fragments of pieces (k, th, base, text), without text; and removed runs, where a batch alone shows them."""

    def run(batches):
        for batch in batches:
            keys, hashes, bases = (batch.column(c).to_numpy() for c in ("k", "th", "base"))
            for i, j, data, offsets in K.chunks(batch.column("text")):
                values, bounds, _, _ = plan.symbols(data, offsets)
                total = len(values)
                windows = np.flatnonzero(K.valid_starts(bounds, plan.window, total))
                if not len(windows):
                    continue
                grams = K.ngram_hashes(values, k)
                place = anchor_places(grams, plan.window - k + 1)[windows]
                new = np.ones(len(windows), bool)
                new[1:] = (place[1:] != place[:-1]) | (windows[1:] != windows[:-1] + 1)
                first = np.flatnonzero(new)
                start, n = windows[first], np.diff(np.append(first, len(windows)))
                row = K.row_of(bounds[:-1], start)
                rows = {"a": grams[place[first]], "fh": slice_hashes(values, start, n + plan.window - 1), "k": keys[i + row], "th": hashes[i + row], "base": bases[i + row], "s": bases[i + row] + start - bounds[row], "n": n, "c": np.ones(len(n), np.int64), "kind": np.zeros(len(n), np.int64)}
                both = K.mix(rows["a"]) ^ rows["fh"]
                order = np.argsort(both, kind="stable")
                same = both[order][1:] == both[order][:-1]
                if same.any():
                    twin = np.zeros(len(n), bool)
                    twin[order[1:][same]] = twin[order[:-1][same]] = True
                    some = np.flatnonzero(twin)
                    some = some[np.lexsort((rows["s"][some], rows["th"][some], rows["k"][some], both[some]))]
                    head = np.ones(len(some), bool)
                    head[1:] = both[some][1:] != both[some][:-1]
                    lead = some[np.flatnonzero(head)[np.cumsum(head) - 1]]
                    repeat = (rows["k"][some] == rows["k"][lead]) & (rows["th"][some] == rows["th"][lead]) & (rows["s"][some] == rows["s"][lead])
                    np.add.at(rows["c"], lead[~repeat], 1)
                    yield _batch(_merged(rows, some[~repeat]))
                    keep = np.ones(len(n), bool)
                    keep[some[~head]] = False
                    rows = {c: v[keep] for c, v in rows.items()}
                yield _batch(rows)

    return pieces.mapInArrow(run, SLOT)


def _settler(plan: Plan):
    """Over a partition's batches in order of (a, fh, k, th, s): rows of a kind each. Holds at most HOT different fragments of one anchor."""
    names = ["a", "fh", "k", "th", "base", "s", "n", "c", "kind"]

    def step(rows: dict, hot: bool, last: bool):
        """Output rows, and what is carried over: the last anchor's different fragments, and whether it is hot."""
        a, fh = rows["a"], rows["fh"]
        new_a = np.ones(len(a), bool)
        new_a[1:] = a[1:] != a[:-1]
        new = new_a.copy()
        new[1:] |= fh[1:] != fh[:-1]
        heads = np.flatnonzero(new)
        lead = heads[np.cumsum(new) - 1]
        repeat = (rows["k"] == rows["k"][lead]) & (rows["th"] == rows["th"][lead]) & (rows["s"] == rows["s"][lead])
        others = np.flatnonzero(~repeat)
        count = np.add.reduceat(rows["c"] - (repeat & ~new), heads)
        out = [_merged(rows, others)]
        own = {c: v[heads] for c, v in rows.items()} | {"c": count}
        group = np.cumsum(new_a[heads]) - 1
        size = np.bincount(group)
        is_hot = size > HOT
        is_hot[0] |= hot
        open_group = np.zeros(len(heads), bool) if last else group == group[-1]
        hold = open_group.copy()
        if not last and (size[-1] > HOT or is_hot[-1]):
            hold[:-1] = False  # the anchor is hot, whatever follows; its last fragment may get more copies
        done = ~hold
        kind = np.where(is_hot[group], CUT, np.where(size[group] > 1, SHARD, 0))
        some = np.flatnonzero(done & (kind > 0))
        out.append({c: v[some] for c, v in own.items()} | {"kind": kind[some]})
        if not plan.first_stays:
            out.append(_merged(own, np.flatnonzero(done & (count > 1))))
        carry = {c: v[hold] for c, v in own.items()}
        return out, carry, bool(not last and is_hot[-1])

    def run(batches):
        carry, hot = None, False
        for batch in batches:
            rows = {c: batch.column(c).to_numpy().astype(np.int64) for c in names}
            if carry is not None:
                hot = hot and len(carry["a"]) > 0
                rows = {c: np.concatenate([carry[c], rows[c]]) for c in names}
            if len(rows["a"]):
                out, carry, hot = step(rows, hot, False)
                for x in out:
                    yield _batch(x)
        if carry is not None and len(carry["a"]):
            for x in step(carry, hot, True)[0]:
                yield _batch(x)

    return run


def _settle(fragments: DataFrame, plan: Plan) -> DataFrame:
    """What the fragments' hashes alone decide, and which fragments need more: rows of a kind each."""
    parts = max(1, int(fragments.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return fragments.repartition(parts, "a").sortWithinPartitions("a", "fh", "k", "th", "s").mapInArrow(_settler(plan), SLOT)


def _contents(slots: DataFrame, pieces: DataFrame, plan: Plan) -> DataFrame:
    """The slots that need more, with their text: (kind, a, k, th, s, n, content)."""
    wanted = slots.where(F.col("kind") > REMOVED).groupBy("k", "th", "base").agg(F.collect_list(F.struct("kind", "a", "s", "n")).alias("slots"))
    rows = pieces.join(wanted, ["k", "th", "base"]).select("k", "th", "base", "text", "slots")

    def run(batches):
        for batch in batches:
            for i, j, data, offsets in K.chunks(batch.column("text")):
                _, bounds, first, end = plan.symbols(data, offsets)
                lists = batch.column("slots").slice(i, j - i)
                flat, row = lists.flatten(), np.repeat(np.arange(j - i), lists.value_lengths().to_numpy())
                kind, a, s, n = (flat.field(x).to_numpy() for x in range(4))
                at = bounds[row] + s - batch.column("base").to_numpy()[i + row]
                raw = data.tobytes()
                for lo in range(0, len(at), 8192):
                    o = slice(lo, lo + 8192)
                    content = [raw[x:y] for x, y in zip(first[at[o]].tolist(), end[at[o] + n[o] + plan.window - 2].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(kind[o], pa.int32()), pa.array(a[o]), pa.array(batch.column("k").to_numpy()[i + row[o]]), pa.array(batch.column("th").to_numpy()[i + row[o]]), pa.array(s[o], pa.int64()), pa.array(n[o], pa.int32()), pa.array(content, pa.binary())], names=["kind", "a", "k", "th", "s", "n", "content"])

    return rows.mapInArrow(run, "kind int, a long, k long, th long, s long, n int, content binary")


def _runs_of(mask: np.ndarray, sizes: np.ndarray, k: np.ndarray, th: np.ndarray, s: np.ndarray, kind: int) -> pa.Table:
    """The runs of a mask over rows of these sizes, where the rows begin at s: (k, th, s, n, kind)."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    within = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    new = mask.copy()
    new[1:] &= ~(mask[:-1] & (row[1:] == row[:-1]))
    first = np.flatnonzero(new)
    run_of = np.cumsum(new)[mask] - 1
    return pa.table({"k": k[row[first]], "th": th[row[first]], "s": s[row[first]] + within[first], "n": pa.array(np.bincount(run_of, minlength=len(first)), pa.int32()), "kind": pa.array(np.full(len(first), kind), pa.int32())})


def _shards(contents: DataFrame, rows: int, plan: Plan) -> DataFrame:
    """Runs that the shards' indices find: (k, th, s, n, kind), of windows to remove and of starts of marked matches."""
    n_shards = max(1, -(-rows // plan.shard_rows))

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by([("k", "ascending"), ("th", "ascending"), ("s", "ascending")])
        k, th, s = (table.column(c).to_numpy() for c in ("k", "th", "s"))
        once = np.ones(len(k), bool)  # rows that repeat id and text are one document
        once[1:] = (k[1:] != k[:-1]) | (th[1:] != th[:-1]) | (s[1:] != s[:-1])
        if not once.all():
            table = table.filter(pa.array(once)).combine_chunks()
        k, th, s, n = (table.column(c).to_numpy() for c in ("k", "th", "s", "n"))
        doc = np.ones(len(k), bool)
        doc[1:] = (k[1:] != k[:-1]) | (th[1:] != th[:-1])
        mask, marked = plan.search(table.column("content"), n, (np.cumsum(doc), s), plan)
        out = [_runs_of(mask, n, k, th, s, REMOVED)]
        if marked is not None:
            out.append(_runs_of(marked, n + plan.window - 1, k, th, s, MARKED))
        return pa.concat_tables(out)

    shard = F.pmod(F.xxhash64("a"), F.lit(n_shards))
    return contents.withColumn("shard", shard).groupBy("shard").applyInArrow(run, "k long, th long, s long, n int, kind int")


def removed_runs(docs: DataFrame, plan: Plan, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(k, th, runs, marks): by document the runs (s, n) of windows to remove and of marked starts, unsorted.

    Documents without any are left out.
    """
    pieces = docs.select(*key_columns(id_col, text_col), F.lit(0).cast("long").alias("base"))
    found, used = [], []
    for level, k in enumerate(plan.anchors):
        scanned = stash(_scan(pieces, plan, k), "fragments")
        settled = stash(_settle(scanned.where("kind = 0"), plan), "settled")
        early = stash(scanned.where(F.col("kind") == REMOVED).select("k", "th", "s", "n", "kind"), "early")
        drop_stash(scanned)
        used += [settled, early]
        found += [early, settled.where(F.col("kind") == REMOVED).select("k", "th", "s", "n", "kind")]
        rows = {r["kind"]: r["n"] for r in settled.groupBy("kind").agg(F.count("*").alias("n")).collect()}
        if not rows.get(SHARD) and not rows.get(CUT):
            break
        contents = stash(_contents(settled, pieces, plan), "contents")
        used.append(contents)
        if rows.get(SHARD):
            found.append(stash(_shards(contents.where(F.col("kind") == SHARD), rows[SHARD], plan), "shard-runs"))
            used.append(found[-1])
        if not rows.get(CUT) or level + 1 == len(plan.anchors):
            break
        pieces = contents.where(F.col("kind") == CUT).select("k", "th", F.col("s").alias("base"), F.col("content").alias("text"))
    out = found[0]
    for x in found[1:]:
        out = out.unionAll(x)
    listed = lambda kind: F.collect_list(F.when(F.col("kind") == kind, F.struct("s", "n")))
    out = stash(out.groupBy("k", "th").agg(listed(REMOVED).alias("runs"), listed(MARKED).alias("marks")), "runs")
    drop_stash(*used)
    return out


def with_runs(docs: DataFrame, plan: Plan, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """All rows of docs: the columns to keep, with _ before their names, then k, text, runs and marks (null if there are none)."""
    runs = removed_runs(docs, plan, id_col, text_col)
    own = docs.select(*[F.col(f"`{c}`").alias(f"_{c}") for c in keep], *key_columns(id_col, text_col))
    return own.join(runs, ["k", "th"], "left").select(*[F.col(f"`_{c}`") for c in keep], "k", "text", "runs", "marks")


def covered_symbols(lists: pa.Array, first_row: int, rows: int, bounds: np.ndarray, window: int) -> np.ndarray:
    """Mask of a batch's symbols that lie in removed windows, from the runs of its rows."""
    own = lists.slice(first_row, rows)
    sizes = own.value_lengths().fill_null(0).to_numpy()
    flat = own.flatten()
    s, n = flat.field(0).to_numpy(), flat.field(1).to_numpy()
    return K.covered(bounds[np.repeat(np.arange(rows), sizes)] + s, n + window - 1, int(bounds[-1]))
