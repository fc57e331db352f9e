"""MinHash near-dedup by a multi-index Hamming join.

1. *Signatures.* Each of ``chunks * width`` hash functions orders all n-grams; a set's least one under each
   gives ``bits`` bits of the signature. Two sets of Jaccard similarity J differ in each of these values
   with probability 1 - J (and a chance of 2^-bits to agree by accident).
2. *Multi-index by pigeonhole.* The signature is split into chunks. Two signatures that differ in at most
   ``chunks * (errors + 1) - 1`` values differ in at most ``errors`` of some chunk. So each chunk is entered
   once for each choice of ``errors`` values that may be wrong, which are left out: signatures within that
   distance share an entry, without exception.
3. *Confirm.* Sets that share an entry are candidates. Whether they link is decided on the full sets
   alone, by exact intersection, so that no wrong link is made and none is lost once the sets have met.
   That is shared with the n-gram join (``parity_join``), from leaders of entries, in rounds, to components.

With the defaults (20 chunks of 5 values, one error) the threshold is 39 of 100 values, where 20 are
expected at J = 0.8; past it, a pair is still found unless each chunk has two errors. For J = 0.8 the
chance to miss a pair is (1 - 0.8^5 - 5 * 0.2 * 0.8^4)^20 = 2.5e-12.

Sets too small for any other set to be similar enough have no entries. Defined results are those of
``parity_join``: null text, and text without a word, has an empty set and links with nothing; shorter
texts have their whole word sequence as one n-gram; rows of equal sets are always linked; rows without
an id, or with a repeated one, stand for themselves; other columns are not read. Nothing is capped.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import parity_join
from .common import mix64

#: N-grams that are hashed at a time.
STEP = 4096
_ODD = np.uint64(1)


@dataclass(frozen=True)
class NearDedup(parity_join.Join):
    """A join whose candidates share an entry of the multi-index; see the module."""

    ngram: int = 4
    chunks: int = 20
    width: int = 5
    errors: int = 1
    bits: int = 16

    @property
    def distance(self) -> int:
        """Signatures that differ in at most so many values are all found."""
        return self.chunks * (self.errors + 1) - 1

    def _multipliers(self) -> np.ndarray:
        return mix64(np.arange(1, self.chunks * self.width + 1, dtype=np.uint64)) | _ODD

    def signature(self, s: np.ndarray) -> np.ndarray:
        """The values of a set that is not empty, ``bits`` bits each."""
        by, least = self._multipliers(), None
        with np.errstate(over="ignore"):
            for at in range(0, len(s), STEP):
                # The high bits of a product depend on all bits of the n-gram's hash.
                part = (s[at : at + STEP, None] * by[None, :]).min(axis=0)
                least = part if least is None else np.minimum(least, part)
            return mix64(least ^ by) & np.uint64((1 << self.bits) - 1)

    def entries(self, signature: np.ndarray) -> np.ndarray:
        """Keys of each chunk without each choice of values that may be wrong."""
        rows, out = signature.reshape(self.chunks, self.width), []
        number = np.arange(self.chunks, dtype=np.uint64) << np.uint64(32)
        for kept in combinations(range(self.width), self.width - self.errors):
            key = mix64(number + np.uint64(sum(1 << k for k in kept)))
            for k in kept:
                with np.errstate(over="ignore"):
                    key = mix64((key ^ rows[:, k]) * np.uint64(0x9E3779B97F4A7C15))
            out.append(key)
        return np.concatenate(out).view(np.int64)

    def keys(self, s: np.ndarray) -> np.ndarray:
        # A linked set of another size, or of another n-gram, needs this much room.
        if not self.differing(len(s) * self.den // self.num):
            return np.zeros(0, np.int64)
        return self.entries(self.signature(s))


def deduplicated(df: DataFrame, join: NearDedup = NearDedup(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_shingles``, ``component_id`` and ``kept`` of every row.

    ``kept``: the id is the smallest of its component; rows without an id are kept if they have no component.
    """
    out = parity_join.groups(df, join, id_col, text_col)
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.col("component_id").isNull()))
