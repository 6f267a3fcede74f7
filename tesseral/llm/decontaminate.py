"""Benchmark decontamination by pigeonhole edit matching.

Texts are sequences of words (ASCII letters lower-cased, other ASCII signs as separators). An item of n words may be
found with up to n // 5 word edits. It is split into one piece more than that, so any such occurrence holds one piece
unchanged; exact hits of the pieces' hashes give places to verify with Myers' bit-parallel distance.
Items are broadcast in blocks of bounded size, and all blocks are applied to a text in one pass over the documents.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import kernels as K
from .common import text_of

#: One edit is allowed for so many words of an item.
WORDS_PER_EDIT = 5
#: Bytes of item text in one broadcast block.
BLOCK_BYTES = 8 << 20

SEPARATOR = np.ones(256, bool)
SEPARATOR[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def normal_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words and where each row's begin."""
    starts, ends, bounds = K.words(data, offsets, SEPARATOR)
    return K.word_hashes(K.LOWER[data], starts, ends), bounds


def myers(pattern: dict[int, int], m: int, text: list[int], most: int) -> list[tuple[int, int]]:
    """(end, distance) of the places in text where the pattern ends with at most so many edits."""
    mask, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, found = mask, 0, m, []
    for at, word in enumerate(text):
        eq = pattern.get(word, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph = down | (~(xh | up) & mask)
        mh = up & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1) & mask
        mh = (mh << 1) & mask
        up = mh | (~(xv | ph) & mask)
        down = ph & xv
        if score <= most:
            found.append((at + 1, score))
    return found


@dataclass
class Block:
    """Items of one block: their words, budgets, and the pieces by length."""

    ids: list[int]
    words: list[list[int]]
    budgets: list[int]
    pieces: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # length: sorted hashes, item, place in the item

    @staticmethod
    def of(items: list[tuple[int, str]], words_per_edit: int) -> "Block":
        data, offsets = K.flat(pa.array([t or "" for _, t in items], pa.string()))
        hashes, bounds = normal_words(data, offsets)
        ids, words, budgets, found = [], [], [], {}
        for row, (item, _) in enumerate(items):
            own = hashes[bounds[row] : bounds[row + 1]]
            n = len(own)
            if not n:
                continue
            budget = n // words_per_edit
            cuts = [n * i // (budget + 1) for i in range(budget + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                found.setdefault(b - a, []).append((int(K.ngram_hashes(own[a:b], b - a)[0]), len(ids), a))
            ids.append(item)
            words.append(own.tolist())
            budgets.append(budget)
        pieces = {}
        for size, rows in found.items():
            rows.sort()
            pieces[size] = (np.array([r[0] for r in rows], K.U), np.array([r[1] for r in rows]), np.array([r[2] for r in rows]))
        return Block(ids, words, budgets, pieces)

    def patterns(self) -> list[dict[int, int]]:
        out = []
        for words in self.words:
            masks: dict[int, int] = {}
            for i, w in enumerate(words):
                masks[w] = masks.get(w, 0) | 1 << i
            out.append(masks)
        return out

    def search(self, hashes: np.ndarray, bounds: np.ndarray, patterns: list[dict[int, int]]) -> dict[int, list[tuple]]:
        """By row, the verified occurrences: (item id, first word, end word, edits), the best of each place."""
        places: dict[tuple, list] = {}
        for size, (pieces, item, offset) in self.pieces.items():
            grams = K.ngram_hashes(hashes, size)
            lo = np.searchsorted(pieces, grams, "left")
            hit = np.flatnonzero((pieces[np.minimum(lo, len(pieces) - 1)] == grams) & K.valid_starts(bounds, size, len(hashes)))
            for at, row in zip(hit.tolist(), K.row_of(bounds[:-1], hit).tolist(), strict=True):
                p = lo[at]
                while p < len(pieces) and pieces[p] == grams[at]:
                    i = int(item[p])
                    begin = at - int(offset[p])
                    places.setdefault((row, i), []).append((max(int(bounds[row]), begin - self.budgets[i]), min(int(bounds[row + 1]), begin + len(self.words[i]) + self.budgets[i])))
                    p += 1
        out: dict[int, list[tuple]] = {}
        for (row, i), spans in places.items():
            spans.sort()
            merged = [list(spans[0])]
            for a, b in spans[1:]:
                if a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            n, budget = len(self.words[i]), self.budgets[i]
            for a, b in merged:
                ends = myers(patterns[i], n, hashes[a:b].tolist(), budget)
                best = None
                for end, edits in ends:  # of ends close to each other the best one
                    if best and end - best[0] > n:
                        out.setdefault(row, []).append((self.ids[i], max(int(bounds[row]), a + best[0] - n) - int(bounds[row]), a + best[0] - int(bounds[row]), best[1]))
                        best = None
                    if best is None or edits < best[1]:
                        best = (end, edits)
                if best:
                    out.setdefault(row, []).append((self.ids[i], max(int(bounds[row]), a + best[0] - n) - int(bounds[row]), a + best[0] - int(bounds[row]), best[1]))
        return out


def blocks(items: DataFrame, id_col: str, text_col: str, words_per_edit: int, block_bytes: int = BLOCK_BYTES):
    """The items in blocks; the driver holds one item's text and one block at a time."""
    rows, size = [], 0
    for item, text in items.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).where(F.col(text_col).isNotNull()).toLocalIterator():
        rows.append((item, text))
        size += len(text)
        if size >= block_bytes:
            yield Block.of(rows, words_per_edit)
            rows, size = [], 0
    if rows:
        yield Block.of(rows, words_per_edit)


HIT = pa.struct([("item_id", pa.int64()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("edits", pa.int32())])


def find_leaks(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", words_per_edit: int = WORDS_PER_EDIT, hits_col: str = "hits") -> DataFrame:
    """docs with a column hits: array of (item_id, first_word, end_word, edits), empty for a clean row; no shuffle.

    All columns stay, but for one of that name. Null and empty texts have no hits; items without a word are never found,
    those without an id are, with a null. Items that occur twice under one id are searched twice. Words are numbered within
    the row's text, and first_word is the end less the item's length. Each block of items is a pass of its own over the
    batches, so time and the workers' memory grow with the items' text; it suits benchmarks of up to some hundred MB.
    """
    out = docs
    at = docs.columns.index(text_col)
    names = []
    for number, block in enumerate(blocks(items, item_id_col, item_text_col, words_per_edit)):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches, shared=shared, name=f"_leak_hits_{number}"):
            block = shared.value
            patterns = block.patterns()
            for batch in batches:
                hits = [[] for _ in range(batch.num_rows)]
                for i, _, data, offsets in K.chunks(batch.column(at).cast(pa.string())):
                    for row, found in block.search(*normal_words(data, offsets), patterns).items():
                        hits[i + row] = [dict(zip(("item_id", "first_word", "end_word", "edits"), h, strict=True)) for h in sorted(found, key=lambda h: (h[0] is None, h[0] or 0, *h[1:]))]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hits, pa.list_(HIT))], names=[*batch.schema.names, name])

        kind = "array<struct<item_id:bigint,first_word:bigint,end_word:bigint,edits:int>>"
        out = out.mapInArrow(run, StructType([*out.schema.fields, *StructType.fromDDL(f"_leak_hits_{number} {kind}").fields]))
        names.append(f"_leak_hits_{number}")
    hits = F.concat(*[F.col(n) for n in names]) if names else F.array().cast("array<struct<item_id:bigint,first_word:bigint,end_word:bigint,edits:int>>")
    return out.withColumn(hits_col, hits).drop(*names)


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, contaminated, n_items, items) for every row; items are the distinct ids found, ascending."""
    found = find_leaks(docs.select(id_col, F.col(text_col).cast("string").alias("text")), items, "text", item_id_col, item_text_col)
    ids = F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["item_id"])))
    return found.select(id_col, (F.size("hits") > 0).alias("contaminated"), F.size(ids).alias("n_items"), ids.alias("items"))


def drop_leaks(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs in which no item is found."""
    return find_leaks(docs, items, text_col, item_id_col, item_text_col, hits_col="_leak_hits").where(F.size("_leak_hits") == 0).drop("_leak_hits")
