"""Substring dedup by word windows, with a compressed FM-index for each shard.

Windows of 20 words are routed by content (see fragments); each shard indexes its fragments and streams them against the
index: backward search over the wavelet matrix gives matching statistics, and places where they reach the window's
length are windows that occur elsewhere in the shard. All but the earliest go.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import id_of
from .fragments import Plan, covered_symbols, with_runs
from .indexes import FMIndex

WINDOW = 20
ANCHORS = (6, WINDOW)
SHARD_ROWS = 4096


def word_symbols(data: np.ndarray, offsets: np.ndarray):
    starts, ends, bounds = K.words(data, offsets)
    return K.word_hashes(data, starts, ends), bounds, starts, ends


def search(contents: pa.Array, n: np.ndarray, places: tuple, plan: Plan) -> tuple[np.ndarray, None]:
    """For the fragments in the order of their places: which windows also start at an earlier one."""
    data, offsets = K.flat(contents)
    hashes, bounds, _, _ = word_symbols(data, offsets)
    distinct, symbols = np.unique(hashes, return_inverse=True)
    rows = len(offsets) - 1
    row = np.repeat(np.arange(rows), np.diff(bounds))
    text = np.empty(len(symbols) + rows, np.int64)
    text[np.arange(len(symbols)) + row] = symbols + rows  # each fragment ends with a symbol of its own
    text[bounds[1:] + np.arange(rows)] = np.arange(rows)
    starts = np.repeat(bounds[:-1] + np.arange(rows), n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    index = FMIndex(text, rows + len(distinct))
    matched, lo, hi = index.matching(text, starts + plan.window, plan.window)
    out = np.zeros(len(starts), bool)
    some = np.flatnonzero(matched == plan.window)
    out[some] = index.earliest(lo[some], hi[some]) != starts[some]
    return out, None


def plan_of(window: int = WINDOW) -> Plan:
    return Plan(window, (min(ANCHORS[0], window), window) if window > ANCHORS[0] else (window,), SHARD_ROWS, True, word_symbols, search)


def _kept(data: np.ndarray, offsets: np.ndarray, gone: np.ndarray, starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray):
    """The kept words of each row, joined by one space: bytes and offsets."""
    keep = ~gone
    order = np.concatenate([[0], np.cumsum(keep)])
    kept_row = order[bounds[1:]] - order[bounds[:-1]]
    s, e = starts[keep], ends[keep]
    sizes = e - s + 1  # with a space, which the row's last word does without
    begin = np.cumsum(sizes) - sizes
    out = np.full(int(sizes.sum()), 0x20, np.uint8)
    flat = np.arange(len(out))
    word = np.repeat(np.arange(len(s)), sizes)
    within = flat - begin[word]
    real = within < sizes[word] - 1
    out[real] = data[s[word[real]] + within[real]]
    edge = np.concatenate([begin, [len(out)]])
    first = np.concatenate([[0], np.cumsum(kept_row)])
    return out, edge[first[:-1]], np.maximum(edge[first[1:]] - 1, edge[first[:-1]])


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: the columns to keep (with _ before their names), k, n_words, n_removed, kept (the words left, joined by one space)."""
    plan = plan_of(window)
    rows = with_runs(docs, plan, id_col, text_col, keep)

    def run(batches):
        for batch in batches:
            text, lists = batch.column("text"), batch.column("runs")
            own = batch.drop_columns(["text", "runs", "marks"])
            for i, j, data, offsets in K.chunks(text):
                starts, ends, bounds = K.words(data, offsets)
                gone = covered_symbols(lists, i, j - i, bounds, window)
                sums = np.concatenate([[0], np.cumsum(gone, dtype=np.int64)])
                out, lo, hi = _kept(data, offsets, gone, starts, ends, bounds)
                raw = out.tobytes()
                kept = pa.array([raw[a:b].decode() for a, b in zip(lo.tolist(), hi.tolist(), strict=True)], pa.string())
                part = own.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.diff(bounds)), pa.array(sums[bounds[1:]] - sums[bounds[:-1]]), kept], names=[*part.schema.names, "n_words", "n_removed", "kept"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name not in ("text", "runs", "marks"))
    return rows.mapInArrow(run, f"{fields}, n_words long, n_removed long, kept string")


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256) for every row.

    Words are [^\\x20\\x09-\\x0D]+. Null and empty texts have none and the digest of no bytes. Null ids are above all
    others, told apart and ordered by a hash of the text. Rows that repeat id and text are one document and lose nothing to each other.
    """
    return removals(docs, id_col, text_col, window).select(id_of("k").alias(id_col), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """docs with all their columns; a text that loses words becomes its kept words joined by one space, others stay."""
    names = tuple(c for c in docs.columns)
    rows = removals(docs, id_col, text_col, window, names)
    changed = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col(f"`_{text_col}`"))
    return rows.select(*[(changed if c == text_col else F.col(f"`_{c}`")).alias(c) for c in names])
