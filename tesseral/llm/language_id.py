"""Language identification by unigram piece models whose segmentations are summed out.

Pieces come from a fixed public vocabulary, lower-cased, plus all single bytes. Each language has a probability for each
piece, fitted by expectation maximisation. A word's likelihood is the sum over all its segmentations, by the forward
algorithm; a text's is the product over its words. Words are runs of ASCII letters and non-ASCII bytes and start with the
vocabulary's word mark. A run of over 40 bytes counts as several words, divided where a character starts, so that
scripts without spaces are scored whole.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import text_of, uniform
from .quality_nbsvm import held_out

MAX_WORD = 40
FLOOR = 1e-7
#: Documents of each language that the model is fitted on, at most about so many.
FIT_ROWS = 500
ROUNDS = 3
#: Words that a Python worker remembers the likelihoods of.
KNOWN = 300_000
GROUP_BYTES = 1 << 18

SEPARATOR = np.ones(256, bool)
SEPARATOR[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False


def vocabulary(path: str | None = None) -> list[bytes]:
    """The model file's pieces as bytes with a space for the word mark, and all single bytes."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
    plain = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    pieces = {p.replace("▁", " ").lower().encode() for p in plain}
    return sorted({p for p in pieces if 0 < len(p) <= MAX_WORD and b" " not in p[1:]} | {bytes([b]) for b in range(256)})


@dataclass
class Model:
    pieces: list[bytes]
    langs: list[str]
    p: np.ndarray  # piece, language; a last row of zeros for what is no piece
    prior: np.ndarray
    tables: dict = field(default_factory=dict)

    def __post_init__(self):
        sizes = np.array([len(x) for x in self.pieces])
        for size in np.unique(sizes):
            own = np.flatnonzero(sizes == size)
            data = np.frombuffer(b"".join(self.pieces[i] for i in own), np.uint8)
            at = np.arange(len(own)) * size
            hashes = K.byte_ngram_hashes(data, int(size))[at]
            order = np.argsort(hashes)
            self.tables[int(size)] = (hashes[order], own[order].astype(np.int32))

    def find(self, data: np.ndarray) -> dict[int, np.ndarray]:
        """For each piece length, the piece that starts at each byte, or the row of zeros."""
        out = {}
        for size, (hashes, index) in self.tables.items():
            got = np.full(len(data), len(self.pieces), np.int32)
            wanted = K.byte_ngram_hashes(data, size)
            at = np.minimum(np.searchsorted(hashes, wanted), len(hashes) - 1)
            got[: len(wanted)] = np.where(hashes[at] == wanted, index[at], len(self.pieces))
            out[size] = got
        return out

    def forward(self, starts: np.ndarray, sizes: np.ndarray, found: dict[int, np.ndarray]) -> np.ndarray:
        """alpha[word, end, language]: all segmentations of the word's first bytes. Words come longest first."""
        alpha = np.zeros((len(starts), int(sizes[0]) + 1, len(self.langs)))
        alpha[:, 0] = 1.0
        for t in range(1, alpha.shape[1]):
            n = int(np.searchsorted(-sizes, -t, "right"))  # words of t bytes or more
            for size, index in found.items():
                if size <= t:
                    piece = index[starts[:n] + t - size]
                    some = np.flatnonzero(piece != len(self.pieces))
                    if len(some):
                        alpha[some, t] += alpha[some, t - size] * self.p[piece[some]]
        return alpha

    def expected(self, starts, sizes, found, counts) -> np.ndarray:
        """How often each piece is used in counts of the words, on average over the segmentations."""
        alpha = self.forward(starts, sizes, found)
        beta = np.zeros_like(alpha)
        beta[np.arange(len(sizes)), sizes] = counts / np.maximum(alpha[np.arange(len(sizes)), sizes], 1e-300)
        out = np.zeros_like(self.p)
        for t in range(alpha.shape[1] - 1, 0, -1):
            n = int(np.searchsorted(-sizes, -t, "right"))
            for size, index in found.items():
                if size <= t:
                    piece = index[starts[:n] + t - size]
                    some = np.flatnonzero(piece != len(self.pieces))
                    if len(some):
                        flow = beta[some, t] * self.p[piece[some]]
                        beta[some, t - size] += flow
                        np.add.at(out, piece[some], flow * alpha[some, t - size])
        return out

    def groups(self, words: list[bytes]):
        """Words, longest first, in groups of bounded size: (indices, starts, sizes, found)."""
        order = sorted(range(len(words)), key=lambda i: -len(words[i]))
        i = 0
        while i < len(order):
            j = min(len(order), i + max(1, GROUP_BYTES // (len(words[order[i]]) + 1)))
            own = order[i:j]
            data = np.frombuffer(b"".join(words[k] for k in own), np.uint8)
            sizes = np.array([len(words[k]) for k in own])
            yield np.array(own), np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes, self.find(data)
            i = j

    def word_scores(self, words: list[bytes]) -> np.ndarray:
        out = np.zeros((len(words), len(self.langs)))
        for own, starts, sizes, found in self.groups(words):
            alpha = self.forward(starts, sizes, found)
            out[own] = np.log(np.maximum(alpha[np.arange(len(own)), sizes], 1e-300))
        return out


def normal(word: bytes) -> bytes:
    """Lower case behind a word mark; nothing if the word has no letter."""
    if word.isascii():
        return b" " + word.lower()
    text = word.decode(errors="ignore")
    return b" " + text.lower().encode() if any(c.isalpha() for c in text) else b""


def spans(data: np.ndarray, offsets: np.ndarray):
    """Words as K.words has them; the long ones are divided at every 40th byte, or where the character there starts."""
    starts, ends, bounds = K.words(data, offsets, SEPARATOR)
    if len(starts) and (ends - starts).max() > MAX_WORD:
        parts = -(-(ends - starts) // MAX_WORD)
        place = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        starts, ends = np.repeat(starts, parts) + place * MAX_WORD, np.repeat(ends, parts)
        inner = place > 0
        for _ in range(3):
            starts = starts - (inner & ((data[starts] & 0xC0) == 0x80))
        ends[:-1] = np.where(inner[1:], starts[1:], ends[:-1])
        bounds = np.searchsorted(starts, offsets)
    return starts, ends, bounds


class Scorer:
    """Sums of word likelihoods by row, remembering words."""

    def __init__(self, model: Model):
        self.model = model
        self.hashes = np.zeros(0, K.U)
        self.scores = np.zeros((0, len(model.langs) + 1))

    def learn(self, hashes: np.ndarray, words: list[bytes]) -> None:
        shown = [normal(w) for w in words]
        real = [i for i, w in enumerate(shown) if w]
        new = np.zeros((len(words), self.scores.shape[1]))
        if real:
            new[real, :-1] = self.model.word_scores([shown[i] for i in real])
            new[real, -1] = 1
        at = np.searchsorted(self.hashes, hashes)
        self.hashes, self.scores = np.insert(self.hashes, at, hashes), np.insert(self.scores, at, new, axis=0)

    def rows(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """For each row the log likelihood in each language, and the number of words with a letter."""
        starts, ends, bounds = spans(data, offsets)
        found, first, back = np.unique(K.word_hashes(data, starts, ends), return_index=True, return_inverse=True)
        at = np.searchsorted(self.hashes, found)
        new = np.flatnonzero((at == len(self.hashes)) | (self.hashes[np.minimum(at, len(self.hashes) - 1)] != found)) if len(self.hashes) else np.arange(len(found))
        if len(self.hashes) + len(new) > KNOWN:
            self.hashes, self.scores, new = self.hashes[:0], self.scores[:0], np.arange(len(found))
        if len(new):
            raw = data.tobytes()
            self.learn(found[new], [raw[starts[i] : ends[i]] for i in first[new]])
        table = self.scores[np.searchsorted(self.hashes, found)]
        sums = np.concatenate([np.zeros((1, table.shape[1])), np.cumsum(table[back], axis=0)])
        return sums[bounds[1:]] - sums[bounds[:-1]]


def fit_counts(counts: dict[str, dict[bytes, int]], rows: dict[str, int], pieces: list[bytes], rounds: int = ROUNDS) -> Model:
    """The model of these word counts by language."""
    langs = sorted(counts)
    words = sorted({w for c in counts.values() for w in c})
    n = np.array([[counts[x].get(w, 0) for x in langs] for w in words], np.float64).reshape(len(words), len(langs))
    p = np.full((len(pieces) + 1, len(langs)), 1 / max(1, len(pieces)))
    p[-1] = 0
    prior = np.log(np.array([rows[x] for x in langs], np.float64) / max(1, sum(rows.values()))) if langs else np.zeros(0)
    model = Model(pieces, langs, p, prior)
    for _ in range(rounds if words else 0):
        used = np.zeros_like(model.p)
        for own, starts, sizes, found in model.groups(words):
            used += model.expected(starts, sizes, found, n[own])
        p = used[:-1] + 0.05
        model.p[:-1] = np.maximum(p / p.sum(axis=0), FLOOR)
    return model


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = FIT_ROWS, seed: int = 3, path: str | None = None) -> Model:
    """Learns from a bounded draw of the documents that have a lang and are not held out (crc32(id as text) mod 4 is 2)."""
    known = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), text_of(text_col).alias("text")).where("lang IS NOT NULL").where(~held_out(F.col("id"), 4, 2))
    total = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not total:
        return fit_counts({}, {}, vocabulary(path))
    share = F.create_map(*[F.lit(x) for lang, n in total.items() for x in (lang, min(1.0, rows / n))])

    def run(batches):
        counts: dict[tuple, int] = {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for i, _, data, offsets in K.chunks(batch.column("text")):
                starts, ends, bounds = spans(data, offsets)
                raw, row = data.tobytes(), K.row_of(bounds[:-1], np.arange(len(starts)))
                for s, e, r in zip(starts.tolist(), ends.tolist(), row.tolist(), strict=True):
                    if word := normal(raw[s:e]):
                        counts[langs[i + r], word] = counts.get((langs[i + r], word), 0) + 1
        keys = list(counts)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.binary()), pa.array([counts[k] for k in keys], pa.int64())], names=["lang", "word", "n"])

    drawn = known.where(uniform(F.col("id"), seed=seed) < share[F.col("lang")])
    got = drawn.select("lang", "text").mapInArrow(run, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).toArrow()
    counts: dict[str, dict[bytes, int]] = {lang: {} for lang in total}
    for lang, word, n in zip(*(got.column(c).to_pylist() for c in ("lang", "word", "n")), strict=True):
        counts[lang][bytes(word)] = n
    return fit_counts(counts, total, vocabulary(path))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) for every row, by the text alone; no shuffle.

    A text without a letter (null and empty ones too) is `und` with score 0, as is every text if nothing was learned.
    score is the posterior of the predicted language; of equal ones the first by name wins.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        scorer = Scorer(model)
        for batch in batches:
            for i, j, data, offsets in K.chunks(batch.column(1)):
                found = scorer.rows(data, offsets)
                if model.langs:
                    log = found[:, :-1] + model.prior
                    log -= log.max(axis=1, keepdims=True)
                    post = np.exp(log) / np.exp(log).sum(axis=1, keepdims=True)
                    best = post.argmax(axis=1)
                    some = found[:, -1] > 0
                    lang = [model.langs[b] if s else "und" for b, s in zip(best, some, strict=True)]
                    score = np.where(some, post[np.arange(len(best)), best], 0.0)
                else:
                    lang, score = ["und"] * (j - i), np.zeros(j - i)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(lang, pa.string()), pa.array(score)], names=[id_col, "lang_pred", "score"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_of(text_col).alias("text")).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double")
