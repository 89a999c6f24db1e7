"""Vector code compression: product codes whose codebooks are trained by exact ball k-means on whole numbers.

Vectors are cut into equal parts, and every part position has a codebook. In a round each part is a member of the ball
of one entry: the entry in the middle, the farthest member as radius. Three facts save work, none changes a result:

* entry j can only take members of ball i if it is closer than twice the radius of i: the neighbours of i;
* a member whose distance is below half of that to the nearest neighbour is in the stable core and stays;
* the others lie in rings between the halves of the sorted neighbour distances; in ring m only the first m neighbours
  are tried, exactly.

A ball that did not move, with neighbours that did not move, is not looked at at all. Distances are squares of whole
numbers, so that "below" and ties are exact. Radii are those of the rows at hand, which are smaller than the whole
ball's; the radii of whole balls only decide which balls rest.

Vectors are packed into blocks once and stored in buckets. Each round joins the small table of codes to its blocks
without an exchange of the vectors, writes new codes, and sums up what changed; the driver holds the codebooks alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from twinfinder.plans.skew import skewed_join
from twinfinder.session import bucketed, checkpointed

LIMIT = 2.0**28  # a scaled component must be below, so that squared distances fit into a long
BLOCK_BYTES = 1 << 16
AT_ONCE = 16_384  # vectors that are worked on together in a task
BUCKET_BYTES = 1 << 26
BROADCAST_LABELS = 100_000  # sums of at most so many labels are broadcast; more are joined by shuffling


@dataclass(frozen=True)
class Codes:
    """`rows`: `vec`, `label`, `code` (hexadecimal, one byte a part), `error`, `label_error`; `books`: parts x entries x width."""

    rows: DataFrame
    books: np.ndarray

    def digest(self) -> str:
        """Digest of all entries' components by part, entry and place."""
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()


def usable(vector: Column, scale: float) -> Column:
    """Whether a vector takes part: it has components, none of them null, non-finite or too large to be squared."""
    small = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) * scale < LIMIT))
    return F.coalesce((F.size(vector) > 0) & small, F.lit(False))


# --- in a task ---------------------------------------------------------------------------------------------------


def squares(rows: np.ndarray, entry: np.ndarray) -> np.ndarray:
    apart = rows - entry
    return np.einsum("ij,ij->i", apart, apart)


def assign(rows: np.ndarray, own: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry (the lower index of equal ones) and its squared distance, starting from any entries `own`."""
    between = ((book[:, None, :] - book[None, :, :]) ** 2).sum(axis=2)
    distance = squares(rows, book[own])
    best, least = own.copy(), distance.copy()
    for entry in range(len(book)):
        members = np.flatnonzero(own == entry)
        if not len(members):
            continue
        reach = 4 * distance[members]
        others = np.array([j for j in np.argsort(between[entry], kind="stable") if j != entry], dtype=np.int64)
        others = others[between[entry][others] <= reach.max()]  # the neighbours of this ball
        rings = np.searchsorted(between[entry][others], reach, side="right")  # 0: the stable core
        order = np.argsort(-rings, kind="stable")
        members, tried = members[order], np.cumsum(np.bincount(rings, minlength=len(others) + 1)[::-1])[::-1]
        for place, other in enumerate(others.tolist()):
            inside = members[: tried[place + 1]]  # all rings that begin beyond this neighbour
            if not len(inside):
                break
            found = squares(rows[inside], book[other])
            closer = (found < least[inside]) | (found == least[inside]) & (other < best[inside])
            taken = inside[closer]
            best[taken], least[taken] = other, found[closer]
    return best, least


def summed(rows: np.ndarray, entries: np.ndarray, count: int) -> np.ndarray:
    """Component sums and number of the rows of each entry; sums of so few whole numbers are exact in doubles."""
    columns = [np.bincount(entries, weights=rows[:, c], minlength=count) for c in range(rows.shape[1])]
    return np.column_stack([*columns, np.bincount(entries, minlength=count)]).astype(np.int64)


def groups(batch: pa.RecordBatch, dims: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Ranges of the blocks of a batch, and their vectors (n x dims), about AT_ONCE at a time."""
    data = batch.column("data")
    sizes = [len(x.as_buffer()) // (4 * dims) for x in data]
    start = held = 0
    for at, size in enumerate(sizes):
        if at > start and held + size > AT_ONCE:
            yield start, at, _vectors(data[start:at], dims)
            start, held = at, 0
        held += size
    if sizes:
        yield start, len(sizes), _vectors(data[start:], dims)


def _vectors(data: pa.Array, dims: int) -> np.ndarray:
    raw = b"".join(x.as_py() for x in data)
    return np.frombuffer(raw, dtype="<i4").reshape(-1, dims).astype(np.int64)


def _old(batch: pa.RecordBatch, start: int, end: int, n: int, parts: int) -> np.ndarray:
    codes = batch.column("codes")[start:end]
    if codes.null_count:  # before the first round all parts belong to the first entry
        return np.zeros((n, parts), dtype=np.uint8)
    return np.frombuffer(b"".join(x.as_py() for x in codes), dtype=np.uint8).reshape(n, parts)


# --- on the cluster ----------------------------------------------------------------------------------------------


def _pack(rows: DataFrame, dims: int, padded: int, scale: float) -> DataFrame:
    """Blocks: `ids` and `labels` as arrays, `data` as little-endian 32-bit numbers, `total` the sum of its vectors."""
    size = max(1, BLOCK_BYTES // (4 * padded))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            values = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            whole = np.zeros((batch.num_rows, padded), dtype="<i4")
            whole[:, :dims] = np.floor(values.reshape(-1, dims) * scale)
            starts = list(range(0, len(whole), size))
            cuts = pa.array([*starts, len(whole)], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.ListArray.from_arrays(cuts, batch.column(0)), pa.ListArray.from_arrays(cuts, batch.column(1)),
                 pa.array([whole[a : a + size].tobytes() for a in starts], pa.binary()),
                 pa.array([whole[a : a + size].sum(axis=0, dtype=np.int64).tolist() for a in starts], pa.list_(pa.int64()))],
                ["ids", "labels", "data", "total"],
            )

    vec, label = (rows.schema[c].dataType.simpleString() for c in ("_vec", "_label"))
    packed = rows.mapInArrow(blocks, f"ids array<{vec}>, labels array<{label}>, data binary, total array<bigint>")
    return packed.withColumn("block", F.monotonically_increasing_id())


def _sums(rows: DataFrame, column: str) -> dict[int, tuple[int, int]]:
    """Sum and greatest value of every place of an array column; the number of places does not depend on the data."""
    places = rows.filter(F.col(column).isNotNull()).select(F.posexplode(column).alias("pos", "x"))
    found = places.groupBy("pos").agg(F.sum("x").alias("sum"), F.max("x").alias("most")).collect()
    return {r["pos"]: (r["sum"], r["most"]) for r in found}


def _round(blocks: DataFrame, books: np.ndarray, resting: np.ndarray) -> DataFrame:
    """New `codes` of every block, and `moved`: changes of sums and counts, then the radii, of a group of blocks."""
    parts, entries, width = books.shape

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes: list[bytes] = []
            moved: list[list[int] | None] = []
            for start, end, vectors in groups(batch, parts * width):
                old = _old(batch, start, end, len(vectors), parts)
                new = old.copy()
                change = np.zeros((parts, entries, width + 1), dtype=np.int64)
                radii = np.zeros((parts, entries), dtype=np.int64)
                for part in range(parts):
                    awake = np.flatnonzero(~resting[part][old[:, part]])
                    rows = vectors[awake, part * width : (part + 1) * width]
                    before = old[awake, part].astype(np.int64)
                    after, least = assign(rows, before, books[part])
                    new[awake, part] = after
                    np.maximum.at(radii[part], after, least)
                    other = before != after
                    change[part] = summed(rows[other], after[other], entries) - summed(rows[other], before[other], entries)
                sizes = [len(x.as_buffer()) // (4 * parts * width) for x in batch.column("data")[start:end]]
                codes += [x.tobytes() for x in np.split(new, np.cumsum(sizes)[:-1])]
                moved += [np.concatenate([change.ravel(), radii.ravel()]).tolist(), *[None] * (end - start - 1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("block"), pa.array(codes, pa.binary()), pa.array(moved, pa.list_(pa.int64()))],
                ["block", "codes", "moved"],
            )

    return blocks.select("block", "data", "codes").mapInArrow(step, "block bigint, codes binary, moved array<bigint>")


def _result(blocks: DataFrame, books: np.ndarray) -> DataFrame:
    """Every vector with its final code and error."""
    parts, _, width = books.shape

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end, vectors in groups(batch, parts * width):
                old = _old(batch, start, end, len(vectors), parts)
                new, error = np.empty_like(old), np.zeros(len(vectors), dtype=np.int64)
                for part in range(parts):
                    rows = vectors[:, part * width : (part + 1) * width]
                    new[:, part], least = assign(rows, old[:, part].astype(np.int64), books[part])
                    error += least
                yield pa.RecordBatch.from_arrays(
                    [batch.column("ids")[start:end].flatten(), batch.column("labels")[start:end].flatten(),
                     pa.array([x.tobytes().hex() for x in new], pa.string()), pa.array(error)],
                    ["vec", "label", "code", "error"],
                )

    vec, label = (blocks.schema[c].dataType.elementType.simpleString() for c in ("ids", "labels"))
    rows = blocks.select("ids", "labels", "data", "codes")
    return rows.mapInArrow(last, f"vec {vec}, label {label}, code string, error bigint")


def _at_rest(books: np.ndarray, before: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """Balls that did not move and whose neighbours did not: the last round already chose among them."""
    still = (books == before).all(axis=2)
    between = ((books[:, :, None, :] - books[:, None, :, :]) ** 2).sum(axis=3)
    near = between <= 4 * radii[:, :, None]  # an entry is its own neighbour
    return still & ~(near & ~still[:, None, :]).any(axis=2)


def compress(
    vectors: DataFrame, vec: str = "vec_id", label: str = "label", vector: str = "embedding", scale: float = 4096.0,
    parts: int = 8, entries: int = 16, rounds: int = 6,
) -> Codes:
    """Trains the codebooks on all vectors and gives the code of each.

    Components become floor(scale * x). Vectors that are null or empty, or hold a null, non-finite or too large
    component (2^28 or more after scaling), take no part, nor do those of another length than the one of the smallest
    id. If the length is no multiple of `parts`, zeros are added. Codebooks start as the parts of the vectors with the
    smallest ids (nulls last, equal ids by vector and label; fewer than `entries` if there are fewer vectors). Means
    go down to whole numbers; an entry without members stays. `label_error` is the sum of the errors of equal labels,
    nulls being equal. Repeated rows count as often as they are there. An empty table gives no rows and empty books.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec).alias("_vec"), F.col(label).alias("_label"), F.col(vector).alias("_vector"))
    rows = rows.filter(usable(F.col("_vector"), scale))
    order = [F.col("_vec").asc_nulls_last(), F.col("_vector"), F.col("_label")]
    first = rows.orderBy(*order).limit(1).collect()
    dims = len(first[0]["_vector"]) if first else 0
    width = ceil(dims / parts)
    rows = rows.filter(F.size("_vector") == dims)
    seeds = np.zeros((0, parts * width))
    if first:
        taken = rows.orderBy(*order).limit(entries).collect()
        seeds = np.zeros((len(taken), parts * width))
        seeds[:, :dims] = [r["_vector"] for r in taken]
    books = np.floor(seeds * scale).astype(np.int64).reshape(len(seeds), parts, width).transpose(1, 0, 2)
    if not first:
        empty = rows.select(F.col("_vec").alias("vec"), F.col("_label").alias("label"), F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error"))
        return Codes(empty.withColumn("label_error", F.col("error")), books)

    buckets = max(spark.sparkContext.defaultParallelism, ceil(vectors.count() * parts * width * 4 / BUCKET_BYTES))
    blocks = bucketed(_pack(rows, dims, parts * width, scale), ["block"], buckets)
    totals = _sums(blocks, "total")
    sums = np.zeros((*books.shape[:2], width + 1), dtype=np.int64)
    sums[:, 0, :width] = np.array([totals[i][0] for i in range(parts * width)]).reshape(parts, width)
    sums[:, 0, width] = rows.count()

    def with_codes(codes: DataFrame | None) -> DataFrame:
        if codes is None:
            return blocks.withColumn("codes", F.lit(None).cast("binary"))
        return blocks.join(codes.select("block", "codes").hint("shuffle_hash"), "block")

    codes = None
    resting, radii = np.zeros(books.shape[:2], dtype=bool), np.zeros(books.shape[:2], dtype=np.int64)
    for _ in range(rounds):
        codes = bucketed(_round(with_codes(codes), books, resting), ["block"], buckets)
        found = _sums(codes, "moved")
        sums += np.array([found[i][0] for i in range(sums.size)]).reshape(sums.shape)
        reached = np.array([found[sums.size + i][1] for i in range(radii.size)]).reshape(radii.shape)
        radii = np.where(resting, np.maximum(radii, reached), reached)
        counts = sums[:, :, width:]
        before, books = books, np.where(counts > 0, sums[:, :, :width] // np.maximum(counts, 1), books)
        resting = _at_rest(books, before, radii)
    found = checkpointed(_result(with_codes(codes), books))
    key = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit(""))
    keyed = found.withColumn("_key", key)
    by_label = checkpointed(keyed.groupBy("_key").agg(F.sum("error").alias("label_error")))
    if by_label.count() <= BROADCAST_LABELS:
        joined = keyed.join(F.broadcast(by_label), "_key")
    else:
        joined = skewed_join(keyed, by_label, ["_key"], "inner", ["code", "error"])
    return Codes(joined.select("vec", "label", "code", "error", "label_error"), books)
