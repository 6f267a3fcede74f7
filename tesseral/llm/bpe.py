"""Byte-level BPE with the tokenizers library over Arrow batches.

The split pattern is applied first and each match is encoded alone, so a bounded cache of matches serves most of a text.
Merges come from the rank file: every pair of tokens whose bytes make a third is a merge of that token's rank, which is
the rule that rank files imply.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Matches remembered by each Python worker; the cache is emptied when full.
CACHE = 200_000
#: Texts are split in parts of about so many characters, at places where a match of the default pattern must begin.
PART = 1 << 18

_loaded: dict[str, "Codec"] = {}


def byte_table() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Codec:
    def __init__(self, path: str, pattern: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer, models

        ranks = read_ranks(path)
        chars = byte_table()
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        shown = {token: "".join(chars[b] for b in token) for token in ranks}
        merges = [(shown[t[:i]], shown[t[i:]]) for t in sorted(ranks, key=ranks.get) for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        self.model = Tokenizer(models.BPE(vocab={shown[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
        self.find = regex.compile(pattern).findall
        self.space = regex.compile(r"\s").match
        self.divisible = pattern == default_ranks()[1]
        self.chars = str.maketrans({b: c for b, c in enumerate(chars)})
        self.cache: dict[str, tuple] = {}

    @staticmethod
    def load(path: str, pattern: str) -> "Codec":
        if (path, pattern) not in _loaded:
            _loaded[path, pattern] = Codec(path, pattern)
        return _loaded[path, pattern]

    def parts(self, text: str) -> Iterator[str]:
        """The text in parts whose matches are those of the whole.

        In the default pattern \\s begins a match wherever it follows a character that is none; other patterns need not
        keep to that, and for them the whole text is one part.
        """
        start = 0
        while self.divisible and len(text) - start > PART:
            at = start + PART
            while at < len(text) and not (self.space(text, at) and not self.space(text, at - 1)):
                at += 1
            yield text[start:at]
            start = at
        yield text[start:]

    def learn(self, pieces: set[str]) -> None:
        todo = list(pieces)
        shown = [p.encode().decode("latin-1").translate(self.chars) for p in todo]
        for piece, found in zip(todo, self.model.encode_batch_fast(shown, add_special_tokens=False), strict=True):
            ids = found.ids
            self.cache[piece] = (ids, " ".join(map(str, ids)), len(ids), self.decode(ids))

    def pieces(self, text: str) -> Iterator[tuple]:
        """For each match of the pattern: ids, their decimal text, their number, and the bytes they decode to."""
        for part in self.parts(text):
            found = self.find(part)
            new = set(found).difference(self.cache)
            if len(self.cache) + len(new) > CACHE:
                self.cache.clear()
                new = set(found)
            self.learn(new)
            yield from map(self.cache.__getitem__, found)

    def encode(self, text: str) -> list[int]:
        return [i for piece in self.pieces(text) for i in piece[0]]

    def offsets(self, ids: list[int]) -> tuple[list[int], list[int]]:
        """Character spans of the tokens in the text that they decode to.

        A token that holds part of a character spans that whole character, as the byte-to-character map says.
        """
        data = np.frombuffer(self.decode(ids), np.uint8)
        ends = np.cumsum([len(self.bytes_of[i]) for i in ids]).astype(np.int64) if ids else np.zeros(0, np.int64)
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if ids else ends
        char_at = np.cumsum((data & 0xC0) != 0x80) - 1  # the character that each byte belongs to
        return char_at[starts].tolist() if ids else [], (char_at[ends - 1] + 1).tolist() if ids else []

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.bytes_of[i] for i in ids])

    def decode_stream(self, ids) -> Iterator[str]:
        """Text token by token; bytes of a character that is split over tokens wait for its last one."""
        import codecs

        decoder = codecs.getincrementaldecoder("utf-8")("replace")
        for i in ids:
            yield decoder.decode(self.bytes_of[i])
        if rest := decoder.decode(b"", True):
            yield rest


def default_ranks() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(id, ids, starts, ends) for every row: token ids and their character spans. A null text counts as empty."""
    path, pattern = path or default_ranks()[0], pattern or default_ranks()[1]

    def run(batches):
        codec = Codec.load(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                ids = [codec.encode(text or "") for text in part.column(1).to_pylist()]
                spans = [codec.offsets(x) for x in ids]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([s[0] for s in spans], pa.list_(pa.int32())), pa.array([s[1] for s in spans], pa.list_(pa.int32()))], names=[id_col, "ids", "starts", "ends"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>, starts array<int>, ends array<int>")


def decode(tokens: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """(id, bytes, text) for every row; null ids count as none. Bytes that are no UTF-8 become U+FFFD in text."""
    path, pattern = path or default_ranks()[0], default_ranks()[1]

    def run(batches):
        codec = Codec.load(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                data = [codec.decode(ids or []) for ids in part.column(1).to_pylist()]
                text = ["".join(codec.decode_stream(ids or [])) for ids in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(data, pa.binary()), pa.array(text, pa.string())], names=[id_col, "bytes", "text"])

    kind = dict(tokens.dtypes)[id_col]
    return tokens.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, bytes binary, text string")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Encodes every whole text and decodes the ids: (id, n_tokens, ids_sha256, decoded_sha256).

    A null or empty text has no tokens and the digests of no bytes. Null ids and repeated rows pass through as they are.
    """
    path, pattern = path or default_ranks()[0], pattern or default_ranks()[1]

    def run(batches):
        codec = Codec.load(path, pattern)
        for batch in batches:
            rows = []
            for text in batch.column(1):
                n, first, ids, back = 0, True, hashlib.sha256(), hashlib.sha256()
                for part in codec.parts(text.as_py() or ""):
                    found = list(codec.pieces(part))
                    if not found:
                        continue
                    n += sum([x[2] for x in found])
                    ids.update((("" if first else " ") + " ".join([x[1] for x in found])).encode())
                    back.update(b"".join([x[3] for x in found]))
                    first = False
                rows.append((n, ids.hexdigest(), back.hexdigest()))
            columns = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string())], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
