"""Fingerprints that stay alike when a text changes a little, and the likeness of two of them.

Every window of four bytes gives three byte triplets, each hashed into one of 256 buckets. The digest tells for every
bucket in which quarter of all counts its own lies (two bits), the length on a logarithmic scale, and how far the
quartiles are apart. Two digests are compared by a difference score with a fixed maximum; likeness is one minus the
score as a share of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from twinfinder.llm.common import SLICE_CHARS

BUCKETS = 256
# Multipliers of the three bytes of a triplet, for each of the three ways to choose them.
TRIPLETS = (((0, 1, 2), 0x9E3779B1), ((0, 1, 3), 0x85EBCA6B), ((0, 2, 3), 0xC2B2AE35))
BYTE_FACTORS = (0x01000193, 0x0001C9D5, 0x27D4EB2F)
LENGTH_BASE = 1.1
# Difference of two quarters: far apart counts more than twice as much as neighbours.
STEP = np.array([0, 1, 3, 6])
LENGTH_WEIGHT, MOST_LENGTH = 4, 100
RATIO_WEIGHT = 3
# Texts without anything in common differ by about two a bucket; from there on they are not alike at all.
MOST = 2 * BUCKETS + MOST_LENGTH
RANGE_ROWS = 2048
MOST_RANGES = 1 << 16
LOWEST = -(1 << 63)


def digest(text: bytes) -> str:
    """132 hexadecimal digits: length, quartile ratios, two bits a bucket. Defined for any text, the empty one too."""
    size = len(text)
    counts = np.zeros(BUCKETS, dtype=np.int64)
    # Zero bytes at both ends, so that the shortest texts have triplets as well; long texts go slice by slice.
    padded = np.frombuffer(b"\0\0" + text + b"\0\0\0", dtype=np.uint8)
    for a in range(0, size + 2, SLICE_CHARS):
        part = padded[a : a + SLICE_CHARS + 3].astype(np.uint32)
        n = len(part) - 3
        for places, salt in TRIPLETS:
            mixed = np.full(n, salt, dtype=np.uint32)
            for at, factor in zip(places, BYTE_FACTORS):
                mixed ^= part[at : at + n] * np.uint32(factor)
                mixed *= np.uint32(salt)
                mixed ^= mixed >> np.uint32(15)
            counts += np.bincount(mixed >> np.uint32(24), minlength=BUCKETS)
    q1, q2, q3 = np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    quarter = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    four = quarter.reshape(-1, 4)
    body = (four[:, 0] << 6 | four[:, 1] << 4 | four[:, 2] << 2 | four[:, 3]).astype(np.uint8).tobytes()
    length = min(255, int(np.log(size + 1) / np.log(LENGTH_BASE)))
    ratios = (16 * int(15 * q1 / q3) + int(15 * q2 / q3)) if q3 else 0
    return bytes([length, ratios]).hex() + body.hex()


def _codes(digests: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(bytes.fromhex("".join(digests)), dtype=np.uint8).reshape(len(digests), -1)
    body = raw[:, 2:, None] >> np.array([6, 4, 2, 0], dtype=np.uint8) & 3
    return raw[:, :2].astype(np.int64), body.reshape(len(digests), -1).astype(np.int64)


def likenesses(left: list[str], right: list[str]) -> np.ndarray:
    """From 0 (nothing in common) to 1 (equal digests) for each pair."""
    if not left:
        return np.zeros(0)
    (head_a, body_a), (head_b, body_b) = _codes(left), _codes(right)
    score = STEP[np.abs(body_a - body_b)].sum(axis=1)
    score = score + np.minimum(LENGTH_WEIGHT * np.abs(head_a[:, 0] - head_b[:, 0]), MOST_LENGTH)
    for shift in (4, 0):
        score = score + RATIO_WEIGHT * np.abs((head_a[:, 1] >> shift & 15) - (head_b[:, 1] >> shift & 15))
    return 1.0 - np.minimum(score, MOST) / MOST


@F.arrow_udf(T.StringType())
def fingerprint(texts: pa.Array) -> pa.Array:
    """The digest of every whole text; a null text counts as empty."""
    return pa.array([digest((t or "").encode("utf-8", "surrogatepass")) for t in texts.to_pylist()], pa.string())


@F.arrow_udf(T.DoubleType())
def likeness(left: pa.Array, right: pa.Array) -> pa.Array:
    """Likeness of two columns of digests; null where either is null."""
    a, b = left.to_pylist(), right.to_pylist()
    known = [i for i, (x, y) in enumerate(zip(a, b)) if x is not None and y is not None]
    found: list[float | None] = [None] * len(a)
    for i, value in zip(known, likenesses([a[i] for i in known], [b[i] for i in known]).tolist()):
        found[i] = value
    return pa.array(found, pa.float64())


def with_next(docs: DataFrame, key: str, columns: dict[str, Column]) -> DataFrame:
    """Every row with `columns` of the row after it in descending `key`; after the last row comes the first.

    The keys are cut into ranges of about RANGE_ROWS rows. The first row of each range is also sent to the range
    before it, so rows are shuffled once and no task sorts more than a range. Only the bounds of ranges (at most
    MOST_RANGES) reach the driver. Null keys come last. Rows of equal keys follow the order of `columns`. A single
    row is followed by itself.
    """
    order_key = F.coalesce(F.col(key).cast("bigint"), F.lit(LOWEST))
    keys = docs.select(order_key.alias("_key"))
    ranges = int(min(MOST_RANGES, max(1, keys.count() // RANGE_ROWS)))
    shares = [i / ranges for i in range(1, ranges)]
    found = keys.approxQuantile("_key", shares, 0.2 / ranges) if shares else []
    bounds = np.unique(np.array(found, dtype=np.float64))
    shared = docs.sparkSession.sparkContext.broadcast(bounds)

    @F.arrow_udf(T.IntegerType())
    def range_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            values = batch.to_numpy(zero_copy_only=False).astype(np.float64)
            yield pa.array(np.searchsorted(shared.value, values, side="right"), pa.int32())

    tops = keys.withColumn("_range", range_of("_key")).groupBy("_range").agg(F.max("_key").alias("_top")).collect()
    tops = sorted((r["_range"], r["_top"]) for r in tops)
    before = [*(r for r, _ in tops[1:]), *(r for r, _ in tops[:1])]  # the range that each first row follows
    sent = docs.sparkSession.createDataFrame(
        [(top, to) for (_, top), to in zip(tops, before)], "_key bigint, _sent int"
    )
    # The only row of a table is sent to its own range; so is the first row if there is one range.
    rows = docs.withColumn("_key", order_key).withColumn("_range", range_of("_key"))
    rows = rows.join(F.broadcast(sent), "_key", "left")
    places = F.when(F.col("_sent").isNull(), F.array(F.struct(F.col("_range").alias("range"), F.lit(0).alias("tail"))))
    places = places.otherwise(
        F.array(
            F.struct(F.col("_range").alias("range"), F.lit(0).alias("tail")),
            F.struct(F.col("_sent").alias("range"), F.lit(1).alias("tail")),
        )
    )
    rows = rows.withColumn("_place", F.explode(places))
    order = [F.col("_place.tail"), F.col("_key").desc(), *columns.values()]
    window = Window.partitionBy("_place.range").orderBy(*order)
    rows = rows.withColumns({f"next_{name}": F.lead(column).over(window) for name, column in columns.items()})
    kept = [c for c in docs.columns if c not in {f"next_{name}" for name in columns}]
    return rows.filter(F.col("_place.tail") == 0).select(*kept, *[f"next_{name}" for name in columns])
