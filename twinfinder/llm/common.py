"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from twinfinder.session import configure

# Texts are worked on in slices of about this many characters, whatever the size of the Arrow batch.
SLICE_CHARS = 300_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column: Column | str, folds: int = 5) -> Column:
    """The remainder of the CRC of an id as text; -1 for null ids."""
    return F.coalesce(F.crc32(F.col(column).cast("string") if isinstance(column, str) else column) % folds, F.lit(-1))


def slices(texts: list[str], chars: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts with about `chars` characters in total; a longer text is alone."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        if i > start and held + len(text) > chars:
            yield start, i
            start, held = i, 0
        held += len(text)
    if start < len(texts):
        yield start, len(texts)
