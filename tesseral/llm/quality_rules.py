"""Quality rules: counts of each text, and the hashed n-gram log-likelihood ratio of a trusted target to the raw corpus.

Both multinomials are over hashed byte 4-grams. The raw one counts all documents, the target all that a label trusts. A
text's score is its mean log ratio per n-gram; the threshold is a quantile of all trusted rows' scores, so every
document's verdict is fixed by the tables alone.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import drop_stash, stash, text_of
from .features import BITS, buckets

SIZE = 1 << BITS
#: The part of the trusted rows that the threshold may refuse, and how much below their quantile it lies, as a part of their spread.
REFUSED = 0.005
MARGIN = 0.25
MIN_WORDS = 50
MAX_REPEATED = 50
#: The characters that count as symbols.
SYMBOLS = "#*$%&|<>"


@dataclass
class Ratio:
    weights: np.ndarray
    threshold: float

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Mean weight of each row's n-grams; 0 for a row without any."""
        found = self.weights[buckets(data, 4)]
        sums = np.concatenate([[0.0], np.cumsum(found, dtype=np.float64)])
        lo = np.minimum(offsets[:-1], len(found))
        hi = np.minimum(np.maximum(offsets[1:] - 3, offsets[:-1]), len(found))
        return (sums[hi] - sums[lo]) / np.maximum(1, hi - lo)


def _counts(texts: DataFrame) -> np.ndarray:
    """How often each bucket occurs in all the texts. What reaches the driver has a fixed size."""

    def run(batches):
        total = np.zeros(SIZE, np.int64)
        for batch in batches:
            for _, _, data, offsets in K.chunks(batch.column(0)):
                found = buckets(data, 4)
                inside = K.valid_starts(offsets, 4, len(data))
                total += np.bincount(found[inside], minlength=SIZE)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["bucket", "n"])

    out = np.zeros(SIZE)
    got = texts.mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out[got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    return out


def _ordered(values: np.ndarray) -> np.ndarray:
    """Doubles' bits as integers in the doubles' order; the sign bit stays, so a second call on the bits undoes it."""
    bits = values.view(np.int64)
    return bits ^ ((bits >> 63) & np.int64(2**63 - 1))


def _at_ranks(keys: DataFrame, ranks: list[int]) -> list[int]:
    """The keys at these ranks of their order, from 0: 16 bits a pass, so the driver gets counts, at most 65,536 a rank."""
    found = [(0, rank) for rank in ranks]
    for shift in (48, 32, 16, 0):
        top = keys.select(F.shiftright("key", shift).alias("top"))
        if shift < 48:
            top = top.where(F.shiftright("top", 16).isin(sorted({prefix for prefix, _ in found})))
        got = top.groupBy("top").agg(F.count("*").alias("n")).toArrow().sort_by("top")
        tops, counts = got.column("top").to_numpy(), got.column("n").to_numpy()
        for i, (prefix, rank) in enumerate(found):
            inside = np.flatnonzero(tops >> 16 == prefix) if shift < 48 else np.arange(len(tops))
            ends = np.cumsum(counts[inside])
            at = np.searchsorted(ends, rank, side="right")
            found[i] = int(tops[inside[at]]), rank - int(ends[at - 1] if at else 0)
    return [key for key, _ in found]


def _quantiles(keys: DataFrame, parts: list[float]) -> list[float]:
    """Exact quantiles of the doubles behind _ordered keys, between two of them in proportion, as numpy's."""
    n = keys.count()
    places = [part * (n - 1) for part in parts]
    ranks = [min(n - 1, int(place) + more) for place in places for more in (0, 1)]
    values = _ordered(np.array(_at_ranks(keys, ranks), np.int64)).view(np.float64)
    return [float(np.quantile(values[2 * i : 2 * i + 2], place - int(place))) for i, place in enumerate(places)]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Ratio:
    """Without trusted rows all weights are 0 and every score equals the threshold, so the rules alone decide.

    Counts and threshold are of all trusted rows. Their number is not bounded, so their ids are joined by a shuffle: once
    with the texts, which are counted, and once with the scores.
    """
    trusted = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id IS NOT NULL").groupBy("id").agg(F.min("y").alias("y")).where("y = 1").select("id")
    texts = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    raw, target = _counts(texts.select("text")), _counts(texts.join(trusted.hint("shuffle_hash"), "id", "left_semi").select("text"))
    if not target.sum():
        return Ratio(np.zeros(SIZE), 0.0)
    smooth = 0.5
    weights = np.log((target + smooth) / (target.sum() + smooth * SIZE)) - np.log((raw + smooth) / (raw.sum() + smooth * SIZE))
    ratio = Ratio(weights, 0.0)

    def run(batches):
        for batch in batches:
            for i, j, data, offsets in K.chunks(batch.column(1)):
                long = offsets[1:] - offsets[:-1] >= 4
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).filter(pa.array(long)), pa.array(_ordered(ratio.scores(data, offsets)[long]))], names=["id", "key"])

    scored = texts.mapInArrow(run, f"id {dict(texts.dtypes)['id']}, key long")
    keys = stash(scored.join(trusted.hint("shuffle_hash"), "id", "left_semi").select("key"), "trusted-scores")
    low, middle = _quantiles(keys, [REFUSED, 0.5])
    drop_stash(keys)
    ratio.threshold = low - MARGIN * (middle - low)
    return ratio


def count_rules(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of each row: words, code points in words, symbols, repeated lines, words in repeated windows."""
    n = len(offsets) - 1
    starts, ends, bounds = K.words(data, offsets)
    out = {"n_words": np.diff(bounds)}

    def per_row(mask):
        sums = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return sums[offsets[1:]] - sums[offsets[:-1]]

    out["word_chars"] = per_row(((data & 0xC0) != 0x80) & ~K.SPACE[data])
    symbol = np.zeros(256, bool)
    symbol[[ord(c) for c in SYMBOLS]] = True
    out["n_symbols"] = per_row(symbol[data])
    cut = np.flatnonzero(data == 10)
    first = np.sort(np.concatenate([offsets[:-1], cut + 1]))  # each row's first line, and one after each line feed
    line_row = np.concatenate([np.arange(n), K.row_of(offsets[:-1], cut)])
    order = np.argsort(np.concatenate([offsets[:-1], cut + 1]), kind="stable")
    line_row = line_row[order]
    last = np.concatenate([first[1:], [len(data)]])
    same = np.concatenate([line_row[1:] == line_row[:-1], [False]])
    last = np.where(same, np.maximum(last - 1, first), offsets[1:][line_row] if n else last)
    ink = np.concatenate([[0], np.cumsum(~K.SPACE[data], dtype=np.int64)])
    wordy = ink[last] > ink[np.minimum(first, last)]
    first, last, line_row = first[wordy], last[wordy], line_row[wordy]
    line = K.mix(K.word_hashes(data, first, last) ^ K.mix(line_row.astype(K.U)))
    distinct = np.unique(line, return_index=True)[1]
    out["n_dup_lines"] = np.bincount(line_row, minlength=n) - np.bincount(line_row[distinct], minlength=n)
    hashes = K.word_hashes(data, starts, ends)
    three = K.ngram_hashes(hashes, 3)
    at = np.flatnonzero(K.valid_starts(bounds, 3, len(hashes)))
    key = K.mix(three[at] ^ K.mix(K.row_of(bounds[:-1], at).astype(K.U)))
    _, back, count = np.unique(key, return_inverse=True, return_counts=True)
    twice = at[count[back] > 1]
    mask = np.concatenate([[0], np.cumsum(K.covered(twice, np.full(len(twice), 3), len(hashes)), dtype=np.int64)])
    out["n_repeat_words"] = mask[bounds[1:]] - mask[bounds[:-1]]
    return out


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge(docs: DataFrame, ratio: Ratio, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, score and verdict for every row; no shuffle.

    A null or empty text has counts of 0 and fails the base. Null ids and repeated rows pass through as they are.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def run(batches):
        ratio = shared.value
        for batch in batches:
            for i, j, data, offsets in K.chunks(batch.column(1)):
                found = count_rules(data, offsets)
                failed = (found["n_words"] < MIN_WORDS) | (100 * found["n_repeat_words"] > MAX_REPEATED * found["n_words"])
                score = ratio.scores(data, offsets)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *(pa.array(found[c].astype(np.int64)) for c in COUNTS), pa.array(failed), pa.array(~failed & (score >= ratio.threshold)), pa.array(score)], names=[id_col, *COUNTS, "base_failed", "kept", "score"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_of(text_col).alias("text")).mapInArrow(run, f"`{id_col}` {kind}, {', '.join(f'{c} long' for c in COUNTS)}, base_failed boolean, kept boolean, score double")
