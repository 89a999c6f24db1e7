"""Similar fingerprints by comparing all of them in tiles, for distances at which buckets meet about all pairs anyway.

A tile is a block of earlier nodes against a block of later ones. Its rows arrive as one sorted stream, the earlier ones
first; a task keeps that block, at most BLOCK nodes of a few words each, and meets the later rows batch by batch, so
neither its memory nor the shuffle depends on how many pairs are compared or found. Comparing costs about a nanosecond a
word, a hundredth of a candidate that comes from a join.

Leader clusters need only nodes x leaders comparisons: the first undecided nodes, at most BLOCK, are decided among
themselves; what their leaders take is final, because all leaders of later rounds lie behind them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from twinfinder.session import checkpointed

# Nodes of a block; smaller tables are cut into BLOCKS blocks of at least LEAST nodes, so that there are tasks enough.
BLOCK, BLOCKS, LEAST = 32_768, 16, 512
# Comparisons of a task, as long as there are fewer tasks than shuffle partitions, and beyond.
FEW_TESTS, MANY_TESTS = 1 << 27, 1 << 31
# Comparisons of one numpy step, nodes decided at once, pairs of an output batch, and spans looked at for the next nodes.
STEP, STRIDE, PAIRS, SPANS = 1 << 16, 64, 1 << 16, 1024

Words = list[np.ndarray]


@dataclass(frozen=True)
class Tiles:
    """Comparison of nodes (`pos`, 64-bit `words`) that differ in at most `k` bits."""

    words: list[str]
    k: int

    def pairs(self, nodes: DataFrame, count: int, carried: list[str]) -> DataFrame:
        """All similar pairs: `pos`, `earlier`, `distance`; words and `carried` numbers of both, the earlier's as `_e_…`.

        `pos` counts the nodes from 0 to `count` - 1.
        """
        columns, k, n_words = ["pos", *self.words, *carried], self.k, len(self.words)
        side = min(BLOCK, max(LEAST, ceil(count / BLOCKS)))
        blocks = ceil(count / side) or 1
        block = F.floor(F.col("pos") / side)
        later = nodes.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("bigint"), block)))
        earlier = nodes.withColumn("_other", F.explode(F.sequence(block, F.lit(blocks - 1).cast("bigint"))))
        rows = later.select((block * blocks + F.col("_other")).alias("_tile"), F.lit(1).alias("_late"), *columns)
        rows = rows.unionByName(earlier.select((F.col("_other") * blocks + block).alias("_tile"), F.lit(0).alias("_late"), *columns))
        names = [*columns, "earlier", *[f"_e_{c}" for c in columns[1:]], "distance"]

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found, n = [], 0
            for held, met in _meetings(batches):
                step = max(1, STEP // len(held[0]))
                for at in range(0, len(met[0]), step):
                    part = [c[at:at + step] for c in met]
                    apart = _apart(_words(part, n_words), _words(held, n_words))
                    i, j = np.nonzero(apart <= k)
                    before = held[0][j] < part[0][i]
                    i, j = i[before], j[before]
                    if len(i):
                        found.append([*[c[i] for c in part], *[c[j] for c in held], apart[i, j].astype(np.int32)])
                        n += len(i)
                    if n >= PAIRS:
                        yield _batch(found, names)
                        found, n = [], 0
            if n:
                yield _batch(found, names)

        kinds = ", ".join(f"{c} {'int' if c == 'distance' else 'bigint'}" for c in names)
        return _dealt(rows, blocks * (blocks + 1) // 2).mapInArrow(compare, kinds)

    def clusters(self, nodes: DataFrame, heads: int | None = None) -> DataFrame:
        """(pos, leader) for every node; a leader is its own leader.

        The first round decides among `heads` nodes, the next among twice as many, up to BLOCK.
        """
        size = min(heads or BLOCK, BLOCK)
        undecided, found = checkpointed(nodes.select("pos", *self.words)), []
        while left := undecided.count():
            leaders = checkpointed(self._leading(undecided.filter(F.col("pos") < _cut(undecided, size))))
            # A node without a leader among these stays for the next round.
            seen = checkpointed(self._first(undecided, leaders, left))
            found.append(seen.filter(F.col("leader").isNotNull()).select("pos", "leader"))
            undecided = seen.filter(F.col("leader").isNull()).drop("leader")
            size = min(2 * size, BLOCK)
        if not found:
            return nodes.select("pos", F.col("pos").alias("leader"))
        return reduce(DataFrame.unionByName, found)

    def _leading(self, front: DataFrame) -> DataFrame:
        """Which of a block of nodes lead, given that none of them has an earlier leader outside."""
        k, columns = self.k, ["pos", *self.words]

        def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = [[c.to_numpy() for c in b.columns] for b in batches]
            if not held:
                return
            held = [np.concatenate(c) for c in zip(*held)]
            words, waiting = _words(held, len(held) - 1), np.arange(len(held[0]))
            leads: list[int] = []
            while len(waiting):
                head, rest = waiting[:STRIDE], waiting[STRIDE:]
                near = _apart([w[head] for w in words], [w[head] for w in words]) <= k
                new: list[int] = []
                for i in range(len(head)):
                    if not near[i, new].any():
                        new.append(i)
                leads += head[new].tolist()
                chosen, step = [w[head[new]] for w in words], STEP // STRIDE
                parts = [rest[at:at + step] for at in range(0, len(rest), step)]
                free = [p[~(_apart([w[p] for w in words], chosen) <= k).any(1)] for p in parts]
                waiting = np.concatenate(free) if free else rest
            yield _batch([[c[leads] for c in held]], columns)

        kinds = ", ".join(f"{c} bigint" for c in columns)
        return front.select(*columns).repartition(1).sortWithinPartitions("pos").mapInArrow(lead, kinds)

    def _first(self, nodes: DataFrame, leaders: DataFrame, count: int) -> DataFrame:
        """`nodes` with the first of the similar `leaders` (at most a block of them), or null, as `leader`."""
        k, columns, n_words = self.k, ["pos", *self.words], len(self.words)
        tests = count * leaders.count()
        least = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        tasks = max(min(ceil(tests / FEW_TESTS), least), ceil(tests / MANY_TESTS), 1)
        rows = nodes.select((F.col("pos") % tasks).alias("_tile"), F.lit(1).alias("_late"), *columns)
        copies = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(tasks - 1).cast("bigint"))).alias("_tile")
        rows = rows.unionByName(leaders.select(copies, F.lit(0).alias("_late"), *columns))

        def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for held, met in _meetings(batches):
                leader, waiting = np.full(len(met[0]), -1), np.arange(len(met[0]))
                at, mine, theirs = 0, _words(met, n_words), _words(held, n_words)
                while at < len(held[0]) and len(waiting):
                    step = max(1, STEP // len(waiting))
                    near = _apart([w[waiting] for w in mine], [w[at:at + step] for w in theirs]) <= k
                    hit = near.any(1)
                    leader[waiting[hit]] = held[0][at + near[hit].argmax(1)]
                    waiting, at = waiting[~hit], at + step
                yield pa.RecordBatch.from_arrays([*map(pa.array, met), pa.array(leader, mask=leader < 0)], [*columns, "leader"])

        return _dealt(rows, tasks).mapInArrow(take, ", ".join(f"{c} bigint" for c in [*columns, "leader"]))


def _cut(undecided: DataFrame, size: int) -> int:
    """A `pos` before which there are some undecided nodes, about `size` of them but not more."""
    width = max(1, size // 4)
    span = F.floor(F.col("pos") / width)
    seen = undecided.groupBy(span.alias("span")).agg(F.count("*").alias("n")).orderBy("span").limit(SPANS).collect()
    total, cut = 0, 0
    for row in seen:
        total += row["n"]
        if total > size:
            break
        cut = (row["span"] + 1) * width
    return cut


def _dealt(rows: DataFrame, tasks: int) -> DataFrame:
    return rows.repartition(tasks, "_tile").sortWithinPartitions("_tile", "_late", "pos")


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[np.ndarray], list[np.ndarray]]]:
    """The columns of a tile's earlier rows with those of some of its later rows, from rows sorted by tile and side."""
    tile, held = None, []
    for batch in batches:
        tiles, late, *columns = [c.to_numpy() for c in batch.columns]
        edges = np.flatnonzero((np.diff(tiles) != 0) | (np.diff(late) != 0)) + 1
        for low, high in zip([0, *edges], [*edges, len(tiles)]):
            if low == high:
                continue
            if tiles[low] != tile:
                tile, held = tiles[low], []
            part = [c[low:high] for c in columns]
            if not late[low]:
                held.append(part)
            elif held:
                held = [[np.concatenate(c) for c in zip(*held)]]
                yield held[0], part


def _words(columns: list[np.ndarray], n: int) -> Words:
    return [c.view(np.uint64) for c in columns[1:n + 1]]


def _apart(left: Words, right: Words) -> np.ndarray:
    """Distances of all on the left (rows) to all on the right (columns)."""
    kind = np.uint8 if len(left) < 4 else np.uint16
    return reduce(np.add, (np.bitwise_count(a[:, None] ^ b).astype(kind, copy=False) for a, b in zip(left, right)))


def _batch(parts: list[list[np.ndarray]], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts)], names)
