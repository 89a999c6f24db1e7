"""Greedy leader clustering without comparing all pairs.

Nodes are visited in the order of `pos`. A node that no earlier leader took becomes a leader and takes every later
node that is similar to it; a node belongs to its smallest similar leader. The leaders are thus the
lexicographically first maximal independent set of the similarity graph, which rounds of joins find exactly.

Candidates come from buckets: a node lies in a few buckets and probes those in which similar nodes can lie. While
every bucket is small all similar pairs are built once. Otherwise a round looks only at the first `heads` nodes of each
bucket: a node that comes before the first one left out, in all buckets that it probes, sees all of its earlier
neighbours and can be decided. The new leaders then take their members from whole buckets (nodes x few leaders, never
nodes x nodes), which empties dense buckets. `heads` doubles from round to round, so the number of rounds stays
logarithmic.

Decisions come from walks in order over blocks of nodes, all blocks at once: within a block everything is decided that
does not wait for another block. What is left jumps over nodes with a single edge before the next walk.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from math import ceil

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from twinfinder.plans.skew import HotKeys, find_hot_keys, key_hash, skewed_join
from twinfinder.session import checkpointed

HEADS = 2048
PAIRS_PER_TASK = 10_000_000
# Buckets with more nodes are cut into slices, the largest ones first; the list of them has this many entries at most.
NODES_PER_SLICE, MOST_HOT = 8192, 4096
# Edges and nodes that one task walks over; its memory holds one flag for each of its nodes.
ROWS_PER_WALK = 500_000


@dataclass(frozen=True)
class Blocking:
    """How to find similar nodes: features, the buckets a node lies in and probes, and the exact test on two nodes.

    `buckets` and `probes` are array columns; a node meets all nodes that lie in a bucket it probes, about `reach` of
    its kind for each bucket it lies in. `similar` gets two functions that return a feature column of either side (the
    probing one first), and the column with the bucket both share; it should accept a pair in only one of its shared
    buckets.
    """

    features: list[str]
    buckets: Column
    probes: Column
    similar: Callable[[Callable[[str], Column], Callable[[str], Column], Column], Column]
    reach: int = 1

    def lying(self, nodes: DataFrame) -> DataFrame:
        return nodes.select("pos", *self.features, F.explode(self.buckets).alias("bucket"))

    def probing(self, nodes: DataFrame) -> DataFrame:
        return nodes.select("pos", *self.features, F.explode(self.probes).alias("bucket"))

    def pairs(self, later: DataFrame, earlier: DataFrame, hot: HotKeys, partitions: int) -> DataFrame:
        """(pos, earlier) of similar nodes, from probing and lying rows; `partitions` fits the number of candidates."""
        renamed = earlier.select(
            F.col("bucket"), F.col("pos").alias("earlier"), *[F.col(c).alias(f"_e_{c}") for c in self.features]
        )
        joined = skewed_join(later, renamed, ["bucket"], "inner", ["pos"], hot, partitions)
        test = self.similar(lambda c: F.col(c), lambda c: F.col(f"_e_{c}"), F.col("bucket"))
        return joined.filter((F.col("earlier") < F.col("pos")) & test).select("pos", "earlier")


@dataclass(frozen=True)
class Load:
    """Size of the largest bucket, tasks for the pairs of (the first `heads` nodes of) all buckets, and what to slice.

    The shuffled nodes are few bytes but many pairs, so the tasks are sized by pairs.
    """

    largest: int
    tasks: int
    hot: HotKeys


def _load(lying: DataFrame, reach: int, heads: int | None = None) -> Load:
    sizes = checkpointed(lying.groupBy("bucket").agg(F.count("*").alias("n")))
    n = (F.col("n") if heads is None else F.least(F.col("n"), F.lit(heads))).cast("double")
    row = sizes.agg(F.max("n").alias("largest"), F.sum(F.col("n") * n).alias("pairs")).first()
    least = int(lying.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    crowded = sizes.filter(F.col("n") > NODES_PER_SLICE).orderBy(F.col("n").desc()).limit(MOST_HOT)
    found = crowded.select(key_hash(["bucket"]).alias("key"), "n").collect() if (row["largest"] or 0) > NODES_PER_SLICE else []
    hot = HotKeys(["bucket"], {r["key"]: r["n"] // NODES_PER_SLICE + 1 for r in found})
    return Load(row["largest"] or 0, max(least, int((row["pairs"] or 0) * reach / PAIRS_PER_TASK) + 1), hot)


def bucket_pairs(nodes: DataFrame, blocking: Blocking) -> DataFrame:
    """All similar pairs (pos, earlier). Hot buckets are cut into slices."""
    lying = blocking.lying(nodes)
    load = _load(lying, blocking.reach)
    return blocking.pairs(blocking.probing(nodes), lying, load.hot, load.tasks)


def leader_clusters(nodes: DataFrame, blocking: Blocking, heads: int | None = None) -> DataFrame:
    """(pos, leader) for every node; a leader is its own leader.

    `nodes` has a unique `pos` and the features. It is read several times and should come from a checkpoint.
    """
    nodes = nodes.select("pos", *blocking.features)
    heads = heads or HEADS
    nothing_hot = HotKeys(["bucket"], {})
    undecided, taken, first = nodes, None, True
    while True:
        lying = blocking.lying(undecided)
        load = _load(lying, blocking.reach, heads)
        whole = load.largest <= heads
        if whole:
            decidable = undecided.select("pos")
            edges = checkpointed(blocking.pairs(blocking.probing(undecided), lying, nothing_hot, load.tasks))
        else:
            place = F.row_number().over(Window.partitionBy("bucket").orderBy("pos"))
            front = checkpointed(lying.withColumn("place", place).filter(F.col("place") <= heads + 1))
            left_out = front.filter(F.col("place") > heads).select("bucket", F.col("pos").alias("_first_left_out"))
            unsure = blocking.probing(undecided).select("pos", "bucket").join(left_out, "bucket")
            unsure = unsure.filter(F.col("pos") > F.col("_first_left_out")).select("pos")
            decidable = checkpointed(undecided.select("pos").join(unsure, "pos", "left_anti"))
            later = blocking.probing(undecided.join(decidable, "pos", "left_semi"))
            front = front.filter(F.col("place") <= heads).drop("place")
            edges = checkpointed(blocking.pairs(later, front, nothing_hot, load.tasks))
        leaders = _decide(decidable, edges)
        if whole and first:
            found = edges.join(leaders.withColumnRenamed("pos", "earlier"), "earlier", "left_semi")
        else:
            # New leaders lie behind the first undecided node, so what an earlier one has taken is final.
            final = [] if taken is None else [taken.filter(F.col("leader") < undecided.agg(F.min("pos")).first()[0])]
            everyone = reduce(lambda left, done: left.join(done, "pos", "left_anti"), final, nodes)
            chosen = blocking.lying(nodes.join(leaders, "pos", "left_semi"))
            found = blocking.pairs(blocking.probing(everyone), chosen, load.hot, load.tasks)
        found = found.select("pos", F.col("earlier").alias("leader"))
        own = leaders.select("pos", F.col("pos").alias("leader"))
        found = found.unionByName(own)
        if taken is not None:
            found = found.unionByName(taken)
        taken = checkpointed(found.groupBy("pos").agg(F.min("leader").alias("leader")))
        if whole:
            return taken
        undecided = checkpointed(undecided.join(taken, "pos", "left_anti"))
        if undecided.isEmpty():
            return taken
        heads, first = 2 * heads, False


def clusters_from_pairs(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(pos, leader) for every node when the similar pairs (pos, earlier) are already known."""
    pairs = checkpointed(pairs.select("pos", "earlier"))
    leaders = _decide(nodes.select("pos"), pairs)
    taken = pairs.join(leaders.withColumnRenamed("pos", "earlier"), "earlier", "left_semi")
    taken = taken.groupBy("pos").agg(F.min("earlier").alias("leader"))
    return taken.unionByName(leaders.select("pos", F.col("pos").alias("leader")))


def _decide(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Leaders among `nodes`, given all pairs with an earlier node for each of them, as a stored table.

    Earlier nodes outside of `nodes` are unknown: what depends on them stays undecided.

    An edge blocks its node if the earlier one leads, or, with `inv`, if it does not; a node leads when nothing blocks
    it. Every round is one stored table of (`pos`, `earlier`, `inv`, `moved`); a null `earlier` tells that `pos` has
    just been decided, and `inv` then whether it leads. A round walks over all blocks (see `_walk`), so graphs that fit
    into one block take one. Between rounds a node with one edge, which leads exactly if that edge does not block, is
    jumped over: edges to it may point to its own earlier node instead, with `inv` adjusted. All edges jump at once, so
    that chains across n blocks take about log2(n) rounds.
    """
    free = nodes.join(edges, "pos", "left_anti").select("pos")
    nothing = F.lit(None).cast(edges.schema["earlier"].dataType)
    rows = edges.select("pos", "earlier", F.lit(False).alias("inv"), F.lit(True).alias("moved"))
    rows = rows.unionByName(free.select("pos", nothing.alias("earlier"), F.lit(True).alias("inv"), F.lit(True).alias("moved")))
    size = nodes.count() + edges.count()
    leaders = []
    while True:
        rows = checkpointed(_walk(rows, size))
        decided = F.col("earlier").isNull()
        leaders.append(rows.filter(decided & F.col("inv")).select("pos"))
        seen = rows.agg(F.count_if(~decided).alias("edges"), F.count_if(F.col("moved")).alias("moved"), F.count("*").alias("n")).first()
        if not seen["edges"] or not seen["moved"]:
            break
        rows, size = _jump(rows), seen["n"]
    return checkpointed(reduce(DataFrame.unionByName, leaders))


def _walk(rows: DataFrame, size: int) -> DataFrame:
    """Decide in each block of nodes, walking in order, all that does not depend on another block.

    Blocks are ranges of `pos` with about ROWS_PER_WALK rows. Earlier nodes come first, so one pass over the sorted
    rows of a block sees the decision of each node before its later neighbours ask for it.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leads: dict[int, bool] = {}
        node, waits, blocked, moved = None, {}, False, False

        def ended() -> list[tuple]:
            if blocked or not waits:
                leads[node] = not blocked
                return [(node, None, not blocked, True)]
            return [(node, earlier, inv, moved) for earlier, inv in waits]

        for batch in batches:
            found: list[tuple] = []
            for pos, earlier, inv, jumped in zip(*[c.to_pylist() for c in batch.columns]):
                if pos != node:
                    if node is not None:
                        found += ended()
                    node, waits, blocked, moved = pos, {}, False, False
                if earlier is None:
                    blocked = not inv
                else:
                    known = leads.get(earlier)
                    moved = moved or jumped
                    if known is None:
                        waits[earlier, inv] = None
                    elif known != inv:
                        blocked = True
            if found:
                yield _batch(found, names, kinds)
        if node is not None:
            yield _batch(ended(), names, kinds)

    names, kinds = ["pos", "earlier", "inv", "moved"], [pa.int64(), pa.int64(), pa.bool_(), pa.bool_()]
    in_order = rows.select(*[F.col(n).cast("bigint") if n in ("pos", "earlier") else F.col(n) for n in names])
    in_order = in_order.repartitionByRange(ceil(size / ROWS_PER_WALK) or 1, "pos").sortWithinPartitions("pos")
    return in_order.mapInArrow(walk, "pos bigint, earlier bigint, inv boolean, moved boolean")


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def _jump(rows: DataFrame) -> DataFrame:
    """One round of `_decide`: edges end at decided nodes, and pass nodes with one edge.

    Before and after it edges end at nodes that are undecided, or whose decision is among `rows`.
    """
    edges = rows.filter(F.col("earlier").isNotNull()).select("pos", "earlier", "inv")
    common, many = find_hot_keys(edges, ["earlier"]), find_hot_keys(edges, ["pos"])
    alone = rows.groupBy("pos").agg(
        F.count("*").alias("n"), F.first("earlier").alias("_up"), F.first("inv").alias("_value")
    )
    alone = alone.filter(F.col("n") == 1).select(F.col("pos").alias("earlier"), "_up", "_value")
    # A decision is stored for one round only, so what hangs on a decided node is decided here and not jumped to.
    known = rows.filter(F.col("earlier").isNull()).select(F.col("pos").alias("_up"), F.col("inv").alias("_leads"))
    alone = skewed_join(alone, known, ["_up"], "left", ["earlier"], common).select(
        "earlier",
        F.when(F.col("_leads").isNull(), F.col("_up")).alias("_up"),
        F.when(F.col("_leads").isNull(), F.col("_value")).otherwise(F.col("_leads") == F.col("_value")).alias("_value"),
    )
    joined = skewed_join(edges, alone, ["earlier"], "left", ["pos"], common)
    same = F.col("_value") == F.col("inv")
    ended = F.col("_value").isNotNull() & F.col("_up").isNull()
    led = joined.select(
        "pos",
        F.when(F.col("_value").isNull(), F.col("earlier")).otherwise(F.col("_up")).alias("earlier"),
        F.when(F.col("_up").isNotNull(), same).otherwise(F.col("inv")).alias("inv"),
        F.col("_up").isNotNull().alias("moved"),
        (ended & ~same).alias("blocked"),
    )
    # Two edges to one node of which just one blocks, whatever that node is, block for sure.
    led = led.groupBy("pos", "earlier").agg(
        F.min("inv").alias("inv"),
        F.max("moved").alias("moved"),
        (F.max("blocked") | (F.col("earlier").isNotNull() & (F.min("inv") != F.max("inv")))).alias("blocked"),
    )
    ends = led.groupBy("pos").agg(F.max("blocked").alias("blocked"), F.count("earlier").alias("left"))
    ends = ends.filter(F.col("blocked") | (F.col("left") == 0)).select("pos", (~F.col("blocked")).alias("inv"))
    left = skewed_join(led.filter(F.col("earlier").isNotNull()), ends, ["pos"], "left_anti", ["earlier"], many)
    nothing = F.lit(None).cast(rows.schema["earlier"].dataType)
    ended_now = ends.select("pos", nothing.alias("earlier"), "inv", F.lit(True).alias("moved"))
    return left.select("pos", "earlier", "inv", "moved").unionByName(ended_now)
