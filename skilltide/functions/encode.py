"""A deterministic encoder without a model: hashes give the dense vector, words the sparse one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .similarity import bound, l2_normalize

DIMENSION = 1024


def fake_dense(text: Column) -> Column:
    """The 32 bytes of the text's SHA-256 scaled to [-0.5, 0.5], repeated to 1024 and normalised."""
    def values_of(digest: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.conv(F.substring(digest, i * 2 + 1, F.lit(2)), 16, 10).cast("double") / 255 - 0.5)

    values = bound(F.sha2(text, 256), values_of)
    return l2_normalize(F.flatten(F.array_repeat(values, DIMENSION // 32)))


def words(text: Column) -> Column:
    """Different lower-case words of more than two characters, in order."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda w: F.length(w) > 2))


def fake_sparse(text: Column) -> Column:
    """A half for each word, or one entry that stands for a text without words."""
    found = words(text)
    return F.when(F.size(found) > 0, F.map_from_arrays(found, F.array_repeat(F.lit(0.5), F.size(found)))).otherwise(F.create_map(F.lit("default"), F.lit(1.0)))
