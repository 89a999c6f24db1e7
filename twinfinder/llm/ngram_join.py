"""Join of texts whose sets of word n-grams are alike, by chosen paths.

Every text becomes the set of its word 5-grams. Texts with the same set are one node; a node has a sketch of minimum
hashes, whose places are the tokens that paths choose from. A run starts with all nodes in one bucket. A bucket chooses
a few places at random, the same for all of its nodes, and every node goes to the child bucket of its value at each
chosen place, so that alike nodes share children. Buckets that are small, or so dense that splitting cannot help, are
compared by brute force; the others are split again. Runs are repeated until the expected recall reaches the target.

Comparisons are made where a pair meets first, so every link is found and counted once. Sketches decide which pairs of
a bucket are worth a comparison; only their nodes' sets are then brought together and compared exactly. Large dense
buckets are cut into slices, and every two slices meet in a cell of their own, so no task holds more than two slices.
Pairs never leave a cell: it yields the number of links of each node, and a forest that connects what is linked.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction
from functools import lru_cache
from math import ceil, log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from twinfinder.llm.common import slices
from twinfinder.session import checkpointed

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.9999
PLACES = 64  # of a sketch
FAN = 3  # places that a bucket chooses
SMALL = 1024  # buckets of up to so many nodes are compared
SLICE = 1024  # nodes of a slice of a large bucket
DENSE = 0.5  # mean share of places at which nodes agree with one of them, from which a bucket is not split
DEEPEST = 12  # levels; buckets that are still large then are compared as they are
# A pair is compared if so many places of its sketches agree. A pair at the threshold has this number at least with a
# probability of more than 0.9999999.
AGREE = PLACES // 2
PAIRS_TOGETHER = 100_000
LARGE = 48  # cells of so many rows are compared as matrices
# Small tables of components are kept in as few files as hold so many rows each.
ROWS_PER_FILE = 8192

_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_RNG = np.random.default_rng(20240521)
_BYTES = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
_MULTIPLY = _RNG.integers(0, 1 << 32, PLACES, dtype=np.uint32) | np.uint32(1)
_ADD = _RNG.integers(0, 1 << 32, PLACES, dtype=np.uint32)
# Word bytes: digits, letters, and everything beyond ASCII.
_IN_WORD = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])


# --- sets --------------------------------------------------------------------------------------------------------


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB) ^ x >> np.uint64(32)


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _FACTOR), np.full(n, _INVERSE)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def shingle_sets(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """Sorted hashes of the different word n-grams of each whole text.

    Words are runs of letters and digits (and all characters beyond ASCII), in lower case. A text with fewer than
    `words` words has one n-gram of all of them; null texts and texts without words have none.
    """
    raw = [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.array([len(r) + 1 for r in raw])
    data = np.frombuffer(b" ".join(raw) + b" ", dtype=np.uint8)
    inside = _IN_WORD[data]
    edges = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    up, down = (p[: len(data)] for p in _powers(1 << max(20, len(data).bit_length())))
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(_BYTES[data] * up)])
    hashes = _mixed((sums[ends] - sums[starts]) * down[starts])
    of = np.searchsorted(np.cumsum(sizes), starts, side="right")
    count = np.bincount(of, minlength=len(raw))
    # Short texts are filled up with zeros to one n-gram.
    room = np.where(count > 0, np.maximum(count, words), 0)
    first = np.cumsum(room) - room
    filled = np.zeros(int(room.sum()) + words, dtype=np.uint64)
    filled[first[of] + np.arange(len(of)) - (np.cumsum(count) - count)[of]] = hashes
    grams = filled[: len(filled) - words].copy()
    for k in range(1, words):
        grams = _mixed(grams * np.uint64(2 * k + 1) ^ filled[k : k + len(grams)] + np.uint64(k))
    return [np.unique(grams[a : a + max(0, n - words + 1)]) for a, n in zip(first.tolist(), room.tolist())]


def sketch(tokens: np.ndarray) -> np.ndarray:
    """PLACES minimum hashes of a set that is not empty."""
    low = np.full(PLACES, 0xFFFFFFFF, dtype=np.uint32)
    for a in range(0, len(tokens), 4096):
        part = (tokens[a : a + 4096] >> np.uint64(32)).astype(np.uint32)
        np.minimum(low, (part[:, None] * _MULTIPLY + _ADD).min(axis=0), out=low)
    return low


def set_name(tokens: np.ndarray) -> bytes:
    """Sixteen bytes that equal sets share."""
    return (
        int(_mixed(tokens).sum(dtype=np.uint64)).to_bytes(8, "little")
        + int(_mixed(tokens ^ _FACTOR).sum(dtype=np.uint64)).to_bytes(8, "little")
    )


def signatures(docs: DataFrame, doc: str, text: str, words: int) -> DataFrame:
    """(`_doc`, `_text_hash`, `_set`, `_size`, `_sketch`) of every row; the last three are null without n-grams."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(2).to_pylist()]
            names, sizes, sketches = [], [], []
            for a, b in slices(texts):
                for tokens in shingle_sets(texts[a:b], words):
                    names.append(set_name(tokens) if len(tokens) else None)
                    sizes.append(len(tokens) or None)
                    sketches.append(sketch(tokens).view(np.int32) if len(tokens) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(names, pa.binary()), pa.array(sizes, pa.int64()),
                 pa.array(sketches, pa.list_(pa.int32()))],
                names=["_doc", "_text_hash", "_set", "_size", "_sketch"],
            )

    rows = docs.select(F.col(doc).alias("_doc"), F.xxhash64(F.col(text)).alias("_text_hash"), F.col(text).alias("_text"))
    kind = docs.schema[doc].dataType.simpleString()
    return rows.mapInArrow(sign, f"_doc {kind}, _text_hash bigint, _set binary, _size bigint, _sketch array<int>")


# --- paths -------------------------------------------------------------------------------------------------------


def runs_needed(threshold: float, recall: float) -> int:
    """Runs until a pair at the threshold is found with probability `recall`, whatever the depth of the paths.

    Its sketches agree at two standard deviations less than the threshold. A path is lost if no chosen place agrees
    with a path that goes on: the least solution of q = (1 - f (1 - q)) ** FAN.
    """
    agree = max(0.05, threshold - 2 * sqrt(threshold * (1 - threshold) / PLACES))
    lost = 0.0
    for _ in range(200):
        lost = (1 - agree * (1 - lost)) ** FAN
    return max(1, ceil(log(1 - recall) / log(min(0.999, lost))))


def _children(path: Column, values: Column) -> Column:
    """The different child buckets of a node: one for each place that its bucket chooses."""
    def child(j: Column) -> Column:
        place = F.pmod(F.xxhash64(path, j), F.lit(PLACES))
        return F.xxhash64(path, place, F.get(values, place.cast("int")))
    return F.array_distinct(F.transform(F.array(*[F.lit(j) for j in range(FAN)]), child))


def leaves_of(nodes: DataFrame, runs: int) -> DataFrame:
    """(`_leaf`, `_node`, `_members`): the buckets to compare, of all runs. `nodes` has `_node` and `_sketch`."""
    roots = F.flatten(F.array(*[_children(F.xxhash64(F.lit(r), F.lit("run")), F.col("_sketch")) for r in range(runs)]))
    rows = nodes.select("_node", F.explode(F.array_distinct(roots)).alias("_leaf"))
    # Each row meets the one size of its bucket; that so many rows come out, whatever the texts, keeps the work even.
    sizes = rows.groupBy("_leaf").agg(F.count("*").alias("_members"))
    sized = checkpointed(rows.join(sizes, "_leaf").select("_leaf", "_node", "_members"))
    small = F.col("_members").between(2, SMALL)
    found = [sized.filter(small)]
    # Rows of buckets to split carry their sketches from here on. There are few of them, so they go into few files.
    large = sized.filter(F.col("_members") > SMALL)
    files = 1 + FAN * large.count() // ROWS_PER_FILE
    large = checkpointed(large.join(nodes.select("_node", "_sketch"), "_node").coalesce(files))
    for _ in range(DEEPEST):
        count = large.count()
        if count == 0:
            return _all_of(found)
        files = 1 + FAN * count // ROWS_PER_FILE
        # A bucket is dense if its nodes agree with one of them at most places.
        pivots = large.groupBy("_leaf").agg(F.min(F.struct("_node", "_sketch")).alias("_p"))
        pivots = pivots.select("_leaf", F.col("_p._sketch").alias("_pivot"))
        equal = F.size(F.filter(F.zip_with("_sketch", "_pivot", lambda x, y: x == y), lambda e: e))
        alike = large.join(pivots, "_leaf").groupBy("_leaf").agg(F.avg(equal / PLACES).alias("_alike"))
        dense = checkpointed(alike.filter(F.col("_alike") >= DENSE).select("_leaf").coalesce(files))
        found.append(large.join(dense, "_leaf", "left_semi").select("_leaf", "_node", "_members"))
        below = large.join(dense, "_leaf", "left_anti").select(
            "_node", "_sketch", F.explode(_children(F.col("_leaf"), F.col("_sketch"))).alias("_leaf")
        )
        below = checkpointed(below.coalesce(files))
        sizes = below.groupBy("_leaf").agg(F.count("*").alias("_members")).filter(F.col("_members") >= 2)
        split = below.join(sizes, "_leaf")
        found.append(split.filter(small).select("_leaf", "_node", "_members"))
        large = checkpointed(split.filter(F.col("_members") > SMALL).coalesce(files))
    return _all_of([*found, large.select("_leaf", "_node", "_members")])


def _all_of(parts: list[DataFrame]) -> DataFrame:
    result = parts[0]
    for more in parts[1:]:
        result = result.unionByName(more)
    return result


# --- cells -------------------------------------------------------------------------------------------------------

CELL = ["_leaf", "_i", "_j"]


def _cells(members: DataFrame) -> DataFrame:
    """Spread the members of each leaf over cells of two slices (or one and the same)."""
    count = F.ceil(F.col("_members") / F.lit(SLICE)).cast("int")
    mine = F.pmod(F.xxhash64("_node", "_leaf"), count).cast("int")
    spread = members.withColumn("_slice", mine).withColumn("_o", F.explode(F.sequence(F.lit(0), count - 1)))
    return spread.withColumns({"_i": F.least("_slice", "_o"), "_j": F.greatest("_slice", "_o")}).drop("_o", "_members")


def _pairs_within(sizes: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows of the same cell, in portions; cells begin at `starts` and have `sizes` rows."""
    for size in np.unique(sizes[sizes > 1]).tolist():
        a, b = np.triu_indices(size, 1)
        of = starts[sizes == size]
        step = max(1, PAIRS_TOGETHER // len(a))
        for k in range(0, len(of), step):
            left, right = (of[k : k + step, None] + a).ravel(), (of[k : k + step, None] + b).ravel()
            for m in range(0, len(left), PAIRS_TOGETHER):
                yield left[m : m + PAIRS_TOGETHER], right[m : m + PAIRS_TOGETHER]


def _pairs_of_large(values: np.ndarray, leaves: np.ndarray, leaf: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of one cell with enough agreement that have not met in an earlier leaf, by whole matrices."""
    n = len(values)
    agree = np.zeros((n, n), dtype=np.uint8)
    for column in np.ascontiguousarray(values.T):
        agree += column[:, None] == column[None, :]
    open_pairs = np.triu(agree >= AGREE, 1)
    row, place = np.nonzero(leaves < leaf)
    earlier = leaves[row, place]
    order = np.argsort(earlier, kind="stable")
    groups = np.split(row[order], np.flatnonzero(np.diff(earlier[order])) + 1)
    for group in groups:
        if len(group) > 1:
            open_pairs[np.ix_(group, group)] = False
    return np.nonzero(open_pairs)


def new_pairs(rows: dict[str, np.ndarray], threshold: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows that meet here first, and whose sizes and sketches allow a link.

    `rows` are whole cells in order: `leaf`, `i`, `j`, `slice`, `node`, `size`, `sketch` (rows x places), and `leaves`
    (rows x most), the leaves of each node, filled up with numbers that differ between rows.
    """
    change = np.zeros(len(rows["leaf"]), dtype=bool)
    for name in ("leaf", "i", "j"):
        change[1:] |= rows[name][1:] != rows[name][:-1]
    sizes = np.diff(np.concatenate([[0], np.flatnonzero(change), [len(change)]]))
    size, values, leaves = rows["size"], rows["sketch"], rows["leaves"]
    part, within = rows["slice"], rows["i"] == rows["j"]
    left, right = [], []

    def fits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        low, high = np.minimum(size[a], size[b]), np.maximum(size[a], size[b])
        keep = low * threshold.denominator >= high * threshold.numerator
        return keep & (within[a] | (part[a] != part[b])) & (rows["node"][a] != rows["node"][b])

    for a, b in _pairs_within(np.where(sizes < LARGE, sizes, 0), np.cumsum(sizes) - sizes):
        keep = fits(a, b)
        a, b = a[keep], b[keep]
        keep = (values[a] == values[b]).sum(axis=1) >= AGREE
        a, b = a[keep], b[keep]
        for k in range(0, len(a), 8192):
            x, y = a[k : k + 8192], b[k : k + 8192]
            shared = leaves[x][:, :, None] == leaves[y][:, None, :]
            earlier = (leaves[x] < rows["leaf"][x][:, None])[:, :, None]
            fresh = ~(shared & earlier).any(axis=(1, 2))
            left.append(x[fresh])
            right.append(y[fresh])
    for start, n in zip((np.cumsum(sizes) - sizes)[sizes >= LARGE].tolist(), sizes[sizes >= LARGE].tolist()):
        a, b = _pairs_of_large(values[start : start + n], leaves[start : start + n], rows["leaf"][start])
        keep = fits(a + start, b + start)
        left.append(a[keep] + start)
        right.append(b[keep] + start)
    empty = np.zeros(0, dtype=np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (empty, empty)


def _read(table: pa.Table) -> dict[str, np.ndarray]:
    rows = {n[1:]: table[n].to_numpy() for n in (*CELL, "_slice", "_node", "_size")}
    sketches = table["_sketch"].combine_chunks()
    # The lowest byte of each value tells nearly as much, and never less agreement than there is.
    rows["sketch"] = sketches.values.to_numpy()[sketches.offsets[0].as_py() :][: PLACES * len(table)].reshape(-1, PLACES).astype(np.uint8)
    lists = table["_leaves"].to_pylist()
    most = max(map(len, lists), default=0)
    filled = np.full((len(lists), max(1, most)), np.iinfo(np.int64).max)
    for k, leaves in enumerate(lists):
        filled[k, : len(leaves)] = leaves
    # The filling is larger than any leaf, so it never counts as an earlier one.
    rows["leaves"] = filled
    return rows


def _whole_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables that end where a cell ends; rows come sorted by cell."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(batch.schema.get_field_index(n)).to_numpy() for n in CELL]
        changes = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1
        if held:
            last = [held[-1].column(held[-1].schema.get_field_index(n))[-1].as_py() for n in CELL]
            if last != [k[0] for k in keys]:
                changes = np.concatenate([[0], changes])
        if len(changes):
            cut = int(changes[-1])
            if cut:
                held.append(batch.slice(0, cut))
            yield pa.Table.from_batches(held)
            held = [batch.slice(cut)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def _by_cell(rows: DataFrame) -> DataFrame:
    return rows.repartition(*CELL).sortWithinPartitions(*CELL)


def candidates(rows: DataFrame, threshold: Fraction) -> DataFrame:
    """(`_node`, cell, `_slice`) of the rows that have a pair to compare in their cell."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_cells(batches):
            a, b = new_pairs(_read(table), threshold)
            chosen = np.unique(np.concatenate([a, b]))
            if len(chosen):
                yield from table.take(pa.array(chosen)).select(["_node", *CELL, "_slice"]).to_batches()

    return _by_cell(rows).mapInArrow(find, "_node bigint, _leaf bigint, _i int, _j int, _slice int")


def _shared_counts(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of shared tokens of each pair of sets. Many pairs of few sets go through a matrix product."""
    if len(a) < 8 * len(sets):
        return np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(a.tolist(), b.tolist())])
    tokens, inverse, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    column = (np.cumsum(times > 1) - 1)[inverse]
    known = (times > 1)[inverse]
    row, column = row[known], column[known]
    total = np.zeros((len(sets), len(sets)), dtype=np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, 2048):
        lo, hi = np.searchsorted(column, [start, start + 2048])
        part = np.zeros((len(sets), 2048), dtype=np.float32)
        part[row[lo:hi], column[lo:hi] - start] = 1
        total += part @ part.T
    return np.rint(total[a, b]).astype(np.int64)


def compare(rows: DataFrame, threshold: Fraction) -> DataFrame:
    """Exact comparison in every cell: (`_node`, `_links`, `_to`), the links found here, and an edge of the forest."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_cells(batches):
            read = _read(table)
            change = np.zeros(len(table), dtype=bool)
            for name in ("leaf", "i", "j"):
                change[1:] |= read[name][1:] != read[name][:-1]
            cuts = [0, *np.flatnonzero(change).tolist(), len(table)]
            nodes, links, to = [], [], []
            for lo, hi in zip(cuts, cuts[1:]):
                # A repeated row of the input may have come twice.
                _, first = np.unique(read["node"][lo:hi], return_index=True)
                at = np.sort(first) + lo
                cell = {n: v[at] for n, v in read.items()}
                a, b = new_pairs(cell, threshold)
                if not len(a):
                    continue
                sets = [np.frombuffer(x, dtype="<u8") for x in table["_tokens"].take(pa.array(at)).to_pylist()]
                shared = _shared_counts(sets, a, b)
                union = cell["size"][a] + cell["size"][b] - shared
                linked = shared * threshold.denominator >= union * threshold.numerator
                a, b = a[linked], b[linked]
                count = np.bincount(np.concatenate([a, b]), minlength=len(at))
                parent = _forest(len(at), a, b)
                for k in np.flatnonzero(count).tolist():
                    nodes.append(int(cell["node"][k]))
                    links.append(int(count[k]))
                    to.append(int(cell["node"][parent[k]]))
            yield pa.RecordBatch.from_pydict(
                {"_node": pa.array(nodes, pa.int64()), "_links": pa.array(links, pa.int64()), "_to": pa.array(to, pa.int64())}
            )

    return _by_cell(rows).mapInArrow(verify, "_node bigint, _links bigint, _to bigint")


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest row that each row is connected with."""
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            return label


def components(edges: DataFrame) -> DataFrame:
    """(`_node`, `_part`) of all nodes of `edges` (`_node`, `_to`): the smallest node that each is connected with.

    Each round takes the smallest part among the neighbours, and then the part of that part, so paths shorten fast.
    """
    both = edges.unionByName(edges.select(F.col("_to").alias("_node"), F.col("_node").alias("_to")))
    files = 1 + 2 * edges.count() // ROWS_PER_FILE
    both = checkpointed(both.distinct().coalesce(files))
    parts = both.groupBy("_node").agg(F.least(F.min("_to"), F.first("_node")).alias("_part")).coalesce(files)
    parts = checkpointed(parts)
    while True:
        near = both.join(parts.select(F.col("_node").alias("_to"), "_part"), "_to").groupBy("_node")
        near = near.agg(F.min("_part").alias("_near"))
        better = parts.join(near, "_node").select("_node", F.col("_part").alias("_old"), F.least("_part", "_near").alias("_part"))
        better = checkpointed(better.coalesce(files))
        above = better.select(F.col("_node").alias("_part"), F.col("_part").alias("_above"))
        jumped = better.join(above, "_part", "left")
        jumped = jumped.select("_node", "_old", F.least("_part", F.coalesce("_above", "_part")).alias("_part"))
        jumped = checkpointed(jumped.coalesce(files))
        parts = jumped.select("_node", "_part")
        if jumped.filter(F.col("_old") != F.col("_part")).isEmpty():
            return parts


# --- the join ----------------------------------------------------------------------------------------------------


def similar_texts(
    docs: DataFrame, doc: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, words: int = WORDS,
    recall: float = RECALL,
) -> DataFrame:
    """One row per row of `docs`: `_doc`, `_text_hash`, `class_id`, `links`, `copies`, `keep`.

    Rows are alike if the Jaccard similarity of their n-gram sets is `threshold` or more. `class_id` is the smallest id
    of all rows that are connected by such links, `links` the number of other sets that the row's own is alike to,
    `copies` the number of other rows with the same set, and `keep` is true for one (id, text) of every class. Rows
    without any word (null and empty texts) are alike to nothing, and classes of their own. Rows with equal ids count
    each; equal rows are copies. An empty table gives no rows. Other columns of `docs` play no part.
    """
    limit = Fraction(str(threshold))
    signed = checkpointed(signatures(docs, doc, text, words).withColumn("_row", F.monotonically_increasing_id()))
    filled = signed.filter(F.col("_set").isNotNull())
    owner = F.min(F.struct(F.col("_doc").isNull().alias("none"), F.col("_doc").alias("doc"), F.col("_text_hash").alias("hash")))
    first = F.min(F.struct("_row", "_doc", "_text_hash", "_size", "_sketch")).alias("_first")
    sets = filled.groupBy("_set").agg(F.count("*").alias("_rows"), owner.alias("_owner"), first)
    sets = checkpointed(sets.select("_set", "_rows", "_owner", F.col("_first._row").alias("_node"), "_first.*").drop("_row"))
    nodes = sets.select("_node", "_doc", "_text_hash", "_size", "_sketch")

    leaves = leaves_of(nodes, runs_needed(threshold, recall))
    lists = leaves.groupBy("_node").agg(F.collect_list(F.struct("_leaf", "_members")).alias("_in"))
    met = lists.join(nodes, "_node").withColumn("_leaves", F.sort_array(F.transform("_in", lambda x: x["_leaf"])))
    met = checkpointed(met)
    members = met.select("_node", "_size", "_sketch", "_leaves", F.explode("_in").alias("_x"))
    members = members.select("_node", "_size", "_sketch", "_leaves", "_x._leaf", "_x._members")
    wanted = checkpointed(candidates(_cells(members), limit))

    # Only now are texts brought together: those of nodes with something to compare, once each.
    places = wanted.groupBy("_node").agg(F.collect_list(F.struct(*CELL, "_slice")).alias("_places"))
    asked = places.join(met.drop("_in"), "_node")
    texts = docs.select(F.col(doc).alias("_d"), F.col(text).alias("_text")).withColumn("_h", F.xxhash64("_text"))
    same = F.col("_d").eqNullSafe(F.col("_doc")) & (F.col("_h") == F.col("_text_hash"))
    asked = texts.join(asked, same).select("_text", "_node", "_size", "_sketch", "_leaves", "_places")

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(0).to_pylist()]
            found = [x.tobytes() for a, b in slices(texts) for x in shingle_sets(texts[a:b], words)]
            rest = [batch.column(k) for k in range(1, batch.num_columns)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), *rest], names=["_tokens", *batch.schema.names[1:]])

    schema = (
        "_tokens binary, _node bigint, _size bigint, _sketch array<int>, _leaves array<bigint>, "
        "_places array<struct<_leaf: bigint, _i: int, _j: int, _slice: int>>"
    )
    known = asked.mapInArrow(tokens, schema).withColumn("_p", F.explode("_places"))
    known = known.select("_tokens", "_node", "_size", "_sketch", "_leaves", "_p.*")
    found = checkpointed(compare(known, limit))

    links = found.groupBy("_node").agg(F.sum("_links").alias("_links"))
    parts = components(found.select("_node", "_to").filter(F.col("_node") != F.col("_to")))
    named = sets.select("_set", "_node", "_rows", "_owner").join(links, "_node", "left").join(parts, "_node", "left")
    named = checkpointed(named.withColumn("_part", F.coalesce("_part", "_node")))
    owners = named.groupBy("_part").agg(F.min("_owner").alias("_chief"))
    named = named.join(owners, "_part").select("_set", "_rows", "_links", "_chief")
    rows = signed.select("_doc", "_text_hash", "_set").join(named, "_set", "left")
    chosen = F.col("_doc").eqNullSafe(F.col("_chief.doc")) & (F.col("_text_hash") == F.col("_chief.hash"))
    alone = F.col("_set").isNull()
    return rows.select(
        "_doc",
        "_text_hash",
        F.when(alone, F.col("_doc")).otherwise(F.col("_chief.doc")).alias("class_id"),
        F.coalesce("_links", F.lit(0)).alias("links"),
        F.coalesce(F.col("_rows") - 1, F.lit(0)).alias("copies"),
        (alone | chosen).alias("keep"),
    )


def one_of_each(docs: DataFrame, doc: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of `docs`, with all their columns, that stand for their class; of equal rows one stays."""
    kept = similar_texts(docs, doc, text, **options).filter("keep").select("_doc", "_text_hash").distinct()
    inner = {f"_x{i}": F.col(f"`{c}`") for i, c in enumerate(docs.columns)}
    rows = docs.select(*[c.alias(n) for n, c in inner.items()], F.col(doc).alias("_d"), F.xxhash64(F.col(text)).alias("_h"))
    joined = rows.join(kept, F.col("_d").eqNullSafe(F.col("_doc")) & (F.col("_h") == F.col("_text_hash")))
    one = Window.partitionBy("_d", "_h").orderBy(F.lit(0))
    joined = joined.withColumn("_n", F.row_number().over(one)).filter(F.col("_n") == 1)
    return joined.select(*[F.col(n).alias(c) for n, c in zip(inner, docs.columns)])
