"""Hashed byte n-grams of whole texts, for the classifier and the quality rules, and labelled samples to fit them on."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import keep_fraction, uniform

BITS = 16


def buckets(data: np.ndarray, n: int) -> np.ndarray:
    """The bucket of every n-gram of the bytes, n up to 4."""
    m = len(data) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint32)
    out = np.zeros(m, np.uint32)
    for i in range(n):
        out = (out << np.uint32(8)) | data[i : i + m]
    return (out * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)


def sample(docs: DataFrame, labels: DataFrame, rows: int, seed: int, id_col: str = "doc_id") -> DataFrame:
    """documents joined to a bounded draw of the labels.

    At most about rows labels are drawn (each by its own hash, so any recomputation draws the same ones), which bounds
    what is broadcast; the documents are not shuffled.
    """
    total = labels.count()
    drawn = labels.where(uniform(F.col(id_col), seed=seed) < keep_fraction(rows, total))
    return docs.join(F.broadcast(drawn), id_col)
