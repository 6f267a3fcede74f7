"""Suffix-array dedup by byte windows, with a run-length index for each shard.

Windows of 400 bytes are routed by content (see fragments). A shard's fragments are indexed by their run-compressed
Burrows-Wheeler transform with the suffixes sampled at run ends. Streaming the places, the samples give each suffix's
neighbours in suffix order; one of them shares the longest match that the place has anywhere in the shard, so the place
starts a repeated window if it shares the window's bytes. Every occurrence goes, the first too.

The same neighbours mark long matches that are shorter than a window: of 256 bytes or more. A window that overlaps such
a match is nearly always routed by a k-gram inside it, and so meets the other occurrences; matches of a whole window are
found for certain, shorter ones as far as they meet.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import kernels as K
from .common import id_of
from .fragments import Plan, covered_symbols, with_runs
from .indexes import RunLengthIndex

WINDOW = 400
#: Matches of so many bytes are marked, those of a window are removed.
MARK = 256
#: Anchors of 64 bytes; where one has very many fragments of a little less than a mark, of all but 16 bytes of the window, and the window.
ANCHORS = (64, 240, 384, WINDOW)
SHARD_ROWS = 1024


def byte_symbols(data: np.ndarray, offsets: np.ndarray):
    at = np.arange(len(data), dtype=np.int64)
    return K.mix(data.astype(K.U) + K.U(1)), offsets, at, at + 1


def search(contents: pa.Array, n: np.ndarray, places: tuple[np.ndarray, np.ndarray], plan: Plan) -> tuple[np.ndarray, np.ndarray | None]:
    """For the fragments: which of their windows, and which of their bytes as starts of a mark, also start anywhere else in the shard."""
    data, offsets = K.flat(contents)
    rows = len(offsets) - 1
    row = np.repeat(np.arange(rows), np.diff(offsets))
    text = np.empty(len(data) + rows, np.int64)
    text[np.arange(len(data)) + row] = data.astype(np.int64) + rows  # each fragment ends with a symbol of its own
    text[offsets[1:] + np.arange(rows)] = np.arange(rows)
    index = RunLengthIndex(text)
    symbols = K.mix(text.astype(K.U))
    at = np.flatnonzero(text >= rows)  # every byte of every fragment
    sides = [index.neighbour(at, side) for side in (index.before, index.after)]
    starts = K.covered(offsets[:-1], n, len(data))  # the bytes where windows start
    windows = K.ngram_hashes(symbols, plan.window)
    out = np.zeros(int(starts.sum()), bool)
    for there in sides:
        ok = (there[starts] >= 0) & (there[starts] < len(windows))
        out |= ok & (windows[np.where(ok, there[starts], 0)] == windows[at[starts]])
    if not plan.mark:
        return out, None
    doc, first = places
    place = np.full(len(text), -1)  # fragments of one document overlap: a match at its own place is none
    place[at] = doc[row] << 40 | (first[row] + np.arange(len(data)) - offsets[row])
    short = K.ngram_hashes(symbols, plan.mark)
    marked = np.zeros(len(at), bool)
    for there, side in zip(sides, (index.before, index.after), strict=True):
        asks = np.flatnonzero(at < len(short))
        to = there[asks]
        while len(asks):
            same = (to >= 0) & (to < len(short))
            same &= short[np.where(same, to, 0)] == short[at[asks]]
            asks, to = asks[same], to[same]
            other = place[to] != place[at[asks]]
            marked[asks[other]] = True
            asks, to = asks[~other], index.neighbour(to[~other], side)
    return out, marked


def plan_of(window: int = WINDOW, mark: int = MARK) -> Plan:
    anchors = tuple(k for k in (ANCHORS[0], mark - 16, window - 16) if 0 < k < window)
    return Plan(window, (*dict.fromkeys(sorted(anchors)), window), SHARD_ROWS, False, byte_symbols, search, mark if mark < window else 0)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, mark: int = MARK) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, n_marked, kept) for every row; kept holds the bytes that are left.

    n_marked counts the bytes in matches of mark bytes or more: all that are removed, and those of shorter matches that
    the indexes meet. Null and empty texts have no bytes. Rows that repeat id and text are one document, not repeats of
    each other; null ids are told apart by their texts. Removed spans may cut a character, so what is left is bytes and
    not always text.
    """
    plan = plan_of(window, mark)
    rows = with_runs(docs, plan, id_col, text_col)

    def run(batches):
        for batch in batches:
            for i, j, data, offsets in K.chunks(batch.column("text")):
                gone = covered_symbols(batch.column("runs"), i, j - i, offsets, window)
                sums = np.concatenate([[0], np.cumsum(gone, dtype=np.int64)])
                marked = gone | covered_symbols(batch.column("marks"), i, j - i, offsets, plan.mark) if plan.mark else gone
                marks = np.concatenate([[0], np.cumsum(marked, dtype=np.int64)])
                begin = gone.copy()
                begin[1:] &= ~gone[:-1]
                inner = offsets[1:-1][offsets[1:-1] < len(data)]
                begin[inner] = gone[inner]  # a run does not go on into the next row
                spans = np.concatenate([[0], np.cumsum(begin, dtype=np.int64)])
                left = data[~gone].tobytes()
                edge = offsets - sums[offsets]
                kept = [left[a:b] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
                per = lambda x: pa.array(x[offsets[1:]] - x[offsets[:-1]])
                yield pa.RecordBatch.from_arrays([batch.column("k").slice(i, j - i), pa.array(np.diff(offsets)), per(sums), per(spans), pa.array([hashlib.sha256(x).hexdigest() for x in kept]), per(marks), pa.array(kept, pa.binary())], names=["k", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_marked", "kept"])

    out = rows.mapInArrow(run, "k long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_marked long, kept binary")
    return out.select(id_of("k").alias(id_col), "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_marked", "kept")
