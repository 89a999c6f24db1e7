"""Exact search for the highest inner products, by branch and bound over columnar blocks.

Vectors lie in blocks in vertical layout: one array per dimension. A block of candidates is scored for a query a few
dimensions at a time. After each step the inequality of Cauchy and Schwarz bounds what the remaining dimensions (their
mass in query and candidate) can add; candidates that cannot reach the best scores found so far are dropped, and the
survivors are moved together before the next step.

Query blocks meet candidate blocks in groups of fixed size, so memory is bounded and the work is spread evenly.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from twinfinder.session import checkpointed

BLOCK = 4096  # vectors in a block
QUERY_GROUP, CANDIDATE_GROUP = 4, 32  # blocks in a group, at most
STEP = 16  # dimensions scored between two bounds
EXACT = 2.0**53


def pack(vectors: DataFrame, vec: str, vector: str) -> DataFrame:
    """Blocks (`block`, `dims`, `ids`, `data`): ids and vertical data of up to BLOCK vectors of one length."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int, np.ndarray]]] = {}

        def emit(dims: int) -> pa.RecordBatch:
            rows = held.pop(dims)
            ids = np.array([r[0] for r in rows], dtype="<i8")
            data = np.array([r[1] for r in rows], dtype="<f8").reshape(len(rows), dims)
            return pa.RecordBatch.from_pydict(
                {"dims": pa.array([dims], pa.int32()), "n": pa.array([len(rows)], pa.int32()),
                 "ids": pa.array([ids.tobytes()], pa.binary()),
                 "data": pa.array([np.ascontiguousarray(data.T).tobytes()], pa.binary())}
            )

        for batch in batches:
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                values = x.values.to_numpy(zero_copy_only=False)
                rows = held.setdefault(len(values), [])
                rows.append((i, values))
                if len(rows) == BLOCK:
                    yield emit(len(values))
        for dims in list(held):
            yield emit(dims)

    packed = vectors.select(vec, vector).mapInArrow(blocks, "dims int, n int, ids binary, data binary")
    return packed.withColumn("block", F.monotonically_increasing_id())


class Block:
    """An unpacked block with the mass that is left after every step."""

    def __init__(self, ids: bytes, data: bytes, dims: int):
        self.ids = np.frombuffer(ids, dtype="<i8")
        self.columns = np.frombuffer(data, dtype="<f8").reshape(dims, len(self.ids))
        squares = np.cumsum((self.columns**2)[::-1], axis=0)[::-1] if dims else np.zeros((0, len(self.ids)))
        cuts = list(range(STEP, dims, STEP))
        self.left = [np.sqrt(squares[c]) for c in cuts] + [np.zeros(len(self.ids))]
        self.cuts = [0, *cuts, dims]
        self.largest = float(np.abs(self.columns).sum(axis=0).max()) if dims and len(self.ids) else 0.0


def best_in_block(
    query: np.ndarray, masses: list[float], block: Block, own: int, k: int, floor: float
) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores in `block` that can be among the `k` best, given the k-th score `floor` from elsewhere.

    `own` is the place of the query itself in this block, or -1.
    """
    at = np.arange(len(block.ids))
    if own >= 0:
        at = np.delete(at, own)
    score = np.zeros(len(at))
    compact = len(at) < len(block.ids)
    for step, (a, b) in enumerate(zip(block.cuts, block.cuts[1:])):
        part = block.columns[a:b]
        score = score + query[a:b] @ (part[:, at] if compact else part)
        rest = masses[step] * block.left[step][at]
        if len(at) > k:
            # The k-th best lower bound is a floor too. Slack covers the rounding of the roots.
            low = np.partition(score - rest, len(at) - k)[len(at) - k]
            floor = max(floor, low - 1e-9 * (abs(low) + 1))
        keep = score + rest + 1e-9 * (np.abs(score) + rest + 1) >= floor
        if not keep.all():
            at, score, compact = at[keep], score[keep], True
    return block.ids[at], score


def exact_scores(query: np.ndarray, block: Block, own: int) -> tuple[np.ndarray, list[int]]:
    """All candidates with scores as integers of any size, for components too large for doubles."""
    whole = [int(x) for x in query]
    at = [i for i in range(len(block.ids)) if i != own]
    scores = [sum(q * int(c) for q, c in zip(whole, block.columns[:, i])) for i in at]
    return block.ids[at], scores


def _search(queries: list[dict], candidates: list[dict], k: int) -> pa.Table:
    out: dict[str, list] = {"query_block": [], "query_place": [], "query_id": [], "vec_id": [], "score": []}
    blocks: dict[int, list[tuple[int, Block]]] = {}
    for row in candidates:
        blocks.setdefault(row["dims"], []).append((row["block"], Block(row["ids"], row["data"], row["dims"])))
    for row in queries:
        mine = Block(row["ids"], row["data"], row["dims"])
        for place, query_id in enumerate(mine.ids.tolist()):
            query = mine.columns[:, place]
            masses = [float(m[place]) for m in mine.left]
            ids, scores = np.zeros(0, dtype=np.int64), np.zeros(0)
            for name, block in blocks.get(row["dims"], []):
                own = -1
                if row["origins"] is not None and name == row["origins"][place]["block"]:
                    own = row["origins"][place]["place"]
                if np.abs(query).max(initial=0.0) * block.largest >= EXACT:
                    more, found = exact_scores(query, block, own)
                    found = np.array(found, dtype=object)
                else:
                    floor = float(scores[k - 1]) if len(scores) == k else -np.inf
                    more, found = best_in_block(query, masses, block, own, k, floor)
                ids, scores = np.concatenate([ids, more]), np.concatenate([scores, found])
                order = sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:k] if len(ids) else []
                ids, scores = ids[order], scores[order]
            n = len(ids)
            out["query_block"] += [row["block"]] * n
            out["query_place"] += [place] * n
            out["query_id"] += [query_id] * n
            out["vec_id"] += ids.tolist()
            out["score"] += [max(-(2**63), min(2**63 - 1, int(s))) for s in scores.tolist()]
    return pa.table(out, schema=pa.schema([(n, pa.int64()) for n in out]))


def top_k(
    vectors: DataFrame, is_query: str, k: int, vec: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """The `k` highest inner products of every query row with all other rows: query_id, rank, vec_id, score.

    `vector` holds whole numbers as array<double>; `is_query` is an SQL condition on the rows. Ties go to the smaller
    id. Rows with a null id, or with a vector that is null or has null or non-finite components, take no part. Vectors
    of different lengths are never compared; empty ones score 0 with each other. A repeated id is another row: it is
    found, and searches, on its own. Scores beyond a long become the nearest long. Queries without candidates, and
    empty tables, give no rows.
    """
    spark = vectors.sparkSession
    usable = F.col(vec).isNotNull() & F.col(vector).isNotNull() & F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    )
    rows = vectors.filter(usable).select(F.col(vec).cast("bigint").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    count = rows.count()
    # Round robin: blocks are full whatever the ids are, and the same on each attempt.
    packed = checkpointed(pack(rows.repartition(max(1, ceil(count / BLOCK))), "vec_id", "v"))
    blocks = packed.count()
    groups = max(1, ceil(blocks / CANDIDATE_GROUP), min(blocks, spark.sparkContext.defaultParallelism))
    asked = _query_blocks(packed, is_query)
    query_blocks = asked.count()
    query_groups = max(1, ceil(query_blocks / QUERY_GROUP))

    def group_of(n: int):
        return F.pmod(F.xxhash64("block"), F.lit(n)).cast("int")

    def all_of(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = asked.withColumn("qg", group_of(query_groups)).withColumn("cg", all_of(groups))
    right = packed.withColumn("cg", group_of(groups)).withColumn("qg", all_of(query_groups))

    def search(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        return _search(queries.to_pylist(), candidates.to_pylist(), k)

    found = (
        left.groupBy("qg", "cg")
        .cogroup(right.groupBy("qg", "cg"))
        .applyInArrow(search, "query_block bigint, query_place bigint, query_id bigint, vec_id bigint, score bigint")
    )
    best = Window.partitionBy("query_block", "query_place").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _query_blocks(packed: DataFrame, is_query: str) -> DataFrame:
    """The queries among the packed vectors, packed again with the place each came from."""
    places = packed.select("block", "dims", "n", "ids", "data")

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                data = np.frombuffer(row["data"], dtype="<f8").reshape(row["dims"], row["n"])
                ids = np.frombuffer(row["ids"], dtype="<i8")
                yield pa.RecordBatch.from_pydict(
                    {"vec_id": pa.array(ids), "block": pa.array([row["block"]] * len(ids), pa.int64()),
                     "place": pa.array(np.arange(len(ids)), pa.int64()),
                     "v": pa.array(list(np.ascontiguousarray(data.T)), pa.list_(pa.float64()))}
                )

    rows = places.mapInArrow(choose, "vec_id bigint, block bigint, place bigint, v array<double>").filter(is_query)
    counted = rows.count()
    tasks = max(1, ceil(counted / BLOCK))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[dict]] = {}

        def emit(dims: int) -> pa.RecordBatch:
            rows = held.pop(dims)
            data = np.array([r["v"] for r in rows], dtype="<f8").reshape(len(rows), dims)
            origins = [{"block": r["block"], "place": r["place"]} for r in rows]
            return pa.RecordBatch.from_pydict(
                {"dims": pa.array([dims], pa.int32()),
                 "ids": pa.array([np.array([r["vec_id"] for r in rows], dtype="<i8").tobytes()], pa.binary()),
                 "data": pa.array([np.ascontiguousarray(data.T).tobytes()], pa.binary()),
                 "origins": pa.array([origins], pa.list_(pa.struct([("block", pa.int64()), ("place", pa.int64())])))}
            )

        for batch in batches:
            for row in batch.to_pylist():
                held.setdefault(len(row["v"]), []).append(row)
                if len(held[len(row["v"])]) == BLOCK:
                    yield emit(len(row["v"]))
        for dims in list(held):
            yield emit(dims)

    schema = "dims int, ids binary, data binary, origins array<struct<block: bigint, place: bigint>>"
    packed_queries = rows.repartition(tasks).mapInArrow(gather, schema)
    return checkpointed(packed_queries.withColumn("block", F.monotonically_increasing_id()))
