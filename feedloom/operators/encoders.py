"""Text encoder: words and character n-grams hashed into signed buckets."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHARACTERS = 1 << 20     # that are hashed together
LONGEST_GRAM = 3         # three code points fit into 63 bits
DENSE = 1 << 22          # numbers of grams up to which a table finds the distinct ones; above, they are sorted
KEPT_GRAMS = 1 << 18     # whose places a worker keeps


def spaced(text: Column) -> Column:
    """Lower case, white space as single spaces, one space at either end; null counts as empty."""
    blanks = F.translate(F.lower(F.coalesce(text, F.lit(""))), "\t\n\x0b\f\r", " " * 5)
    flat = F.regexp_replace(blanks, " {2,}", " ")       # only runs are replaced, not the space after every word
    return F.concat(F.lit(" "), F.trim(flat), F.lit(" "))


@lru_cache(KEPT_GRAMS)
def bucket_and_sign(kind: str, gram: str, n: int) -> tuple[int, int]:
    """First 32 bits of the digest choose the bucket, the next one the sign."""
    digest = hashlib.md5(f"{kind}:{gram}".encode()).digest()
    return int.from_bytes(digest[:4], "big") % n, 1 - 2 * (digest[4] >> 7)


def by_distinct(values: np.ndarray, size: int, found: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """`found(values)`, worked out once per distinct value; all values lie below `size`."""
    if size > DENSE:
        distinct, which = np.unique(values, return_inverse=True)
        return found(distinct)[which]
    seen = np.zeros(size, bool)
    seen[values] = True
    distinct = np.flatnonzero(seen)
    table = np.zeros(size, np.int64)
    table[distinct] = found(distinct)
    return table[values]


def hashed(texts: pa.Array, sizes: list[int], words: bool, n: int) -> np.ndarray:
    """Row per text: signed counts of its grams by bucket, scaled to unit length (all zero if they cancel out)."""
    # Cells of a text: n buckets of added grams, n of subtracted ones; the last cell takes what is not counted.
    cells, dropped = np.zeros(len(texts) * 2 * n + 1, np.int64), len(texts) * 2 * n

    def places(kind: str, grams: Iterable[str]) -> np.ndarray:
        return np.array([b if s > 0 else b + n for b, s in (bucket_and_sign(kind, g, n) for g in grams)], np.int64)

    joined = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), "<u4")
    lengths = pc.utf8_length(texts).to_numpy(zero_copy_only=False)
    ends, first = np.cumsum(lengths), np.arange(len(texts)) * 2 * n
    start = np.repeat(first, lengths)
    alphabet = np.flatnonzero(np.bincount(joined, minlength=1))
    letter = by_distinct(joined, 0x110000, lambda distinct: np.arange(len(distinct)))
    of = max(1, len(alphabet))
    for size in sizes:
        last = len(joined) - size + 1
        if last < 1:
            continue

        def grams(distinct: np.ndarray, size: int = size) -> np.ndarray:
            letters = [map(chr, alphabet[distinct // of ** (size - 1 - k) % of].tolist()) for k in range(size)]
            return places("c", map("".join, zip(*letters, strict=True)))

        packed = sum(letter[k:last + k] * of ** (size - 1 - k) for k in range(size))
        cell = start[:last] + by_distinct(packed, of ** size, grams)
        crossing = (ends[:, None] - np.arange(1, size)).ravel()     # starts of grams that would end in a later text
        cell[crossing[(crossing >= 0) & (crossing < last)]] = dropped
        cells += np.bincount(cell, minlength=len(cells))
    if words:
        split = pc.split_pattern(pc.utf8_trim(texts, " "), " ")
        found = split.flatten().dictionary_encode()
        distinct, which = found.dictionary.to_pylist(), found.indices.to_numpy()
        cell = np.repeat(first, pc.list_value_length(split).to_numpy(zero_copy_only=False)) + places("w", distinct)[which]
        if "" in distinct:
            cell[which == distinct.index("")] = dropped
        cells += np.bincount(cell, minlength=len(cells))
    cells = cells[:-1].reshape(len(texts), 2, n)
    out = (cells[:, 0] - cells[:, 1]).astype(float)
    length = np.sqrt((out * out).sum(1, keepdims=True))
    return np.divide(out, length, out=np.zeros_like(out), where=length > 0)


class NgramEncoder(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Adds the hashed words and character n-grams of a text column as array<double>.

    It learns nothing, so a saved pipeline encodes alike everywhere. `sizes` are the lengths
    of the character n-grams, which may span words; `numFeatures` the buckets of a dense row.
    """

    sizes = Param(Params._dummy(), "sizes", "lengths of the character n-grams", TypeConverters.toListInt)
    words = Param(Params._dummy(), "words", "whether words are hashed too", TypeConverters.toBoolean)
    numFeatures = Param(Params._dummy(), "numFeatures", "number of buckets", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, sizes=None, words=None, numFeatures=None):
        super().__init__()
        self._setDefault(inputCol="review_text", outputCol="features", sizes=[2, 3], words=True, numFeatures=1024)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})
        if not all(1 <= s <= LONGEST_GRAM for s in self.getOrDefault("sizes")):
            raise ValueError(f"character n-grams have 1 to {LONGEST_GRAM} characters")

    def _transform(self, dataset: DataFrame) -> DataFrame:
        sizes, words, n = (self.getOrDefault(p) for p in ("sizes", "words", "numFeatures"))

        @F.arrow_udf("array<double>")
        def encode(texts: pa.Array) -> pa.Array:
            texts = texts.cast(pa.string())
            ends = np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False))
            parts, start = [], 0
            while start < len(texts):
                stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + CHARACTERS, "right")))
                parts.append(hashed(texts.slice(start, stop - start), sizes, words, n))
                start = stop
            rows = np.concatenate(parts) if parts else np.zeros((0, n))
            return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * n, pa.int32()), pa.array(rows.ravel()))

        return dataset.withColumn(self.getOutputCol(), encode(spaced(F.col(self.getInputCol()))))
