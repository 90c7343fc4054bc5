"""Small helpers the corpus operators share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F


def texts(batch: pa.RecordBatch, column: str = "text") -> Iterator[str]:
    """The texts of a batch one by one; null reads as empty."""
    for value in batch.column(column):
        text = value.as_py()
        yield "" if text is None else text


def unused(name: str, df: DataFrame) -> str:
    """The name, lengthened until ``df`` has no column of that name."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def bucket_of(key: Column | str, remainder: int, parts: int) -> Column:
    """True where crc32 of the key as text leaves ``remainder``; false for a null key."""
    key = F.col(key) if isinstance(key, str) else key
    return F.coalesce(F.crc32(key.cast("string")) % parts == remainder, F.lit(False))
