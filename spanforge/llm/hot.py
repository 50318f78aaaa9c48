"""Hashes that are so frequent that their rows are dealt to several tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Documents, about, in the sample that hot hashes are told by, and how many of those there are at most.
SAMPLE, MOST_HOT = 20_000, 4096


class HotHashes:
    """Hashes that are estimated to have more than ``hot_rows`` rows, each with its number of parts."""

    def __init__(self, parts: dict[int, int]) -> None:
        self.hashes = np.array(sorted(parts), np.int64)
        self.parts = np.array([parts[h] for h in sorted(parts)], np.int64)

    def __bool__(self) -> bool:
        return bool(len(self.hashes))

    def part(self, h: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """For each row 0, or for a hot hash the part of its document, from 1 on."""
        if not self:
            return np.zeros(len(h), np.int32)
        i = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[i] == h, 1 + doc % self.parts[i], 0).astype(np.int32)


    def holds(self, h: np.ndarray) -> np.ndarray:
        return np.isin(h, self.hashes)

    def dealt(self, h: str, doc: str) -> Column:
        """As :meth:`part`, as an expression to deal rows by; all hot hashes have as many parts as the most frequent one."""
        if not self:
            return F.lit(0)
        return F.when(F.col(h).isin(self.hashes.tolist()), 1 + F.pmod(F.col(doc), F.lit(int(self.parts.max())))).otherwise(0)


def hot_hashes(docs: DataFrame, hashes: Callable[[pa.RecordBatch], np.ndarray], hot_rows: int, doc: str = "doc") -> HotHashes:
    """The hot ones among the ``hashes`` of the rows of ``docs``, from a bounded sample of documents.

    They decide only how rows are dealt to tasks, never what is found.
    """
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, n = np.unique(hashes(batch), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(n, pa.int64())], ["h", "n"])

    total = docs.count()
    if total <= hot_rows // 100:
        return HotHashes({})
    share = min(1.0, SAMPLE / total)
    sample = docs.where(F.pmod(F.xxhash64(doc), F.lit(1 << 20)) < int(share * (1 << 20)))
    often = sample.mapInArrow(counted, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") > hot_rows * share)
    return HotHashes({r.h: -(-int(r.n / share) // hot_rows) for r in often.orderBy(F.desc("n"), "h").limit(MOST_HOT).collect()})
