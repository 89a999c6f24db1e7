"""Near-duplicates: Hamming distance of fingerprints, and equal keys with close values."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import combinations
from math import comb, floor
from operator import or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from twinfinder.functions.hashing import hamming, hex_words, is_fallback, max_distance, word_hex
from twinfinder.functions.media import parse_duration
from twinfinder.operators.exact import candidates, exact_groups, text_groups
from twinfinder.plans.leaders import Blocking, bucket_pairs, leader_clusters
from twinfinder.plans.numbering import numbered
from twinfinder.plans.skew import ROWS_PER_TASK, HotKeys, key_hash, skewed_join
from twinfinder.plans.tiles import Tiles
from twinfinder.schema import FILE_RECORD
from twinfinder.session import checkpointed

DURATION_TOLERANCE = 2.0
IMAGE_BITS = 64
VIDEO_BITS = 192
# Values that a node probes in one band, at most, and what a probe costs in candidates.
MOST_PROBES, PROBE_COST = 20_000, 4
# A cut that leaves fewer candidates than this share of all pairs is preferred if it takes so few probes.
FEW_CANDIDATES, FEW_PROBES = 0.09, 256
# Comparisons of a word in a tile that cost as much as a candidate of a bucket.
WORDS_PER_CANDIDATE = 100
# Distinct values of a key from which on it is cut into segments.
KEY_NODES = 1_000_000
DEFAULT_ORDER = ["repo", "path"]


@dataclass(frozen=True)
class Band:
    """`width` bits of a word from bit `low` on, and how many of them may differ."""

    word: int
    low: int
    width: int
    radius: int

    @property
    def mask(self) -> int:
        bits = ((1 << self.width) - 1) << self.low
        return bits - (1 << 64) if bits >> 63 else bits

    @property
    def probes(self) -> int:
        """Number of values within the radius of a value."""
        return sum(comb(self.width, d) for d in range(self.radius + 1))

    def neighbours(self) -> list[int]:
        """What to flip, at the place of the band, to reach all values within the radius."""
        flips = (reduce(or_, (1 << self.low + b for b in bits), 0) for d in range(self.radius + 1) for bits in combinations(range(self.width), d))
        return [f - (1 << 64) if f >> 63 else f for f in flips]


def make_bands(bits: int, k: int, per_word: int) -> list[Band]:
    """Cut every word into `per_word` bands whose radii let no pair within distance k pass.

    If each band i had more than radius i differing bits, the sum of (radius + 1) would be exceeded by k; the radii
    are spread so that this sum is k + 1. With more than k + 1 bands the first k + 1 do, without radii.
    """
    edges = [64 * i // per_word for i in range(per_word + 1)]
    spans = [(word, low, high - low) for low, high in zip(edges, edges[1:]) for word in range(bits // 64)]
    spans = spans[: k + 1]
    radius, wider = divmod(k + 1 - len(spans), len(spans))
    order = sorted(range(len(spans)), key=lambda i: -spans[i][2])  # the widest bands take the larger radius
    radii = {i: radius + (place < wider) for place, i in enumerate(order)}
    return [Band(*span, min(radii[i], span[2])) for i, span in enumerate(spans)]


def candidate_share(bands: list[Band]) -> float:
    """The candidates of evenly spread fingerprints as a share of all ordered pairs."""
    return sum(band.probes / 2.0**band.width for band in bands)


def blocking_cost(bands: list[Band], nodes: int) -> float:
    """What a cut costs in candidates."""
    return PROBE_COST * nodes * sum(b.probes for b in bands) + candidate_share(bands) * nodes * nodes


def choose_bands(bits: int, k: int, nodes: int) -> list[Band]:
    """Few wide bands with a radius cost probes, many narrow ones bring strangers together; takes the cheapest cut."""
    if not 0 <= k < bits:
        raise ValueError("a threshold above 0 and up to 100 percent is needed")
    options = [make_bands(bits, k, per_word) for per_word in range(1, 33)]
    options = [o for o in options if max(b.probes for b in o) <= MOST_PROBES]
    selective = [o for o in options if candidate_share(o) <= FEW_CANDIDATES]
    if any(sum(b.probes for b in o) <= FEW_PROBES for o in selective):
        options = selective
    return min(options, key=lambda o: blocking_cost(o, nodes))


def in_tiles(bits: int, k: int, nodes: int) -> bool:
    """Whether comparing all pairs in tiles costs less than the candidates of the best cut."""
    return nodes * nodes / 2 * (bits // 64) / WORDS_PER_CANDIDATE < blocking_cost(choose_bands(bits, k, nodes), nodes)


def hamming_blocking(words: list[str], bits: int, k: int, nodes: int) -> Blocking:
    """Multi-index blocking of fingerprints held in 64-bit word columns, for distances up to k.

    A node lies in the bucket of its own value of every band and probes those of all values within the band's radius.
    A pair is accepted in the first of the bands in which it is that close.
    """
    bands = choose_bands(bits, k, nodes)
    buckets, probes = [], []
    for number, band in enumerate(bands):
        value = F.col(words[band.word]).bitwiseAND(F.lit(band.mask))
        buckets.append(F.struct(F.lit(number).alias("no"), value.alias("value")))
        flips = F.split(F.lit(",".join(map(str, band.neighbours()))), ",").cast("array<bigint>")
        probes.append((number, value, flips))

    def around(number: int, value: Column, flips: Column) -> Column:
        return F.transform(flips, lambda f: F.struct(F.lit(number).alias("no"), value.bitwiseXOR(f).alias("value")))

    def similar(a: Callable[[str], Column], b: Callable[[str], Column], bucket: Column) -> Column:
        left, right = [a(w) for w in words], [b(w) for w in words]
        met = F.lit(None).cast("int")
        for number, band in reversed(list(enumerate(bands))):
            apart = F.bit_count(left[band.word].bitwiseXOR(right[band.word]).bitwiseAND(F.lit(band.mask)))
            met = F.when(apart <= band.radius, number).otherwise(met)
        return (hamming(left, right) <= k) & (met == bucket["no"])

    reach = max(b.probes for b in bands)
    return Blocking(words, F.array(*buckets), F.concat(*[around(*p) for p in probes]), similar, reach)


def distinct_nodes(rows: DataFrame, features: list[str], order: list[str]) -> DataFrame:
    """One node per distinct feature value with its number of `copies`, numbered by its first row in `order`.

    Equal rows have equal neighbours, so collapsing them changes no cluster and removes the densest groups.
    """
    first = F.min(F.struct(*order)).alias("first_row")
    nodes = rows.groupBy(*features).agg(first, F.count("*").alias("copies"))
    return numbered(nodes, [F.col("first_row").asc()], "pos")


def with_words(rows: DataFrame, fingerprint: str, bits: int) -> tuple[DataFrame, list[str]]:
    """Rows that carry a usable fingerprint, with its words in `_w0`, `_w1`, …"""
    digits = F.lpad(fingerprint, bits // 4, "0")
    words = {f"_w{i}": w for i, w in enumerate(hex_words(digits, bits))}
    usable = rows.filter(F.length(fingerprint).between(1, bits // 4)).withColumns(words)
    return usable.filter(reduce(lambda a, b: a & b, [F.col(w).isNotNull() for w in words])), list(words)


def hamming_pairs(
    df: DataFrame, fingerprint: str, bits: int, threshold: float, order: list[str] | None = None
) -> DataFrame:
    """Similar pairs of distinct fingerprints: `earlier`, `later` and their `distance`, each with its copies.

    Rows with the same fingerprint stand behind one value, so a value held by very many rows adds no pairs.
    """
    rows, words = with_words(df, fingerprint, bits)
    k = max_distance(bits, threshold)
    nodes = distinct_nodes(rows, words, order or DEFAULT_ORDER)
    count = nodes.count()
    if k >= 0 and in_tiles(bits, k, count):
        found = Tiles(words, k).pairs(nodes, count, ["copies"])
        return found.select(
            F.concat(*[word_hex(f"_e_{w}") for w in words]).alias("earlier"),
            F.concat(*[word_hex(w) for w in words]).alias("later"),
            "distance",
            F.col("_e_copies").alias("earlier_copies"),
            F.col("copies").alias("later_copies"),
        )
    shown = F.concat(*[word_hex(w) for w in words])
    left = nodes.select(F.col("pos").alias("earlier_pos"), shown.alias("earlier"), F.col("copies").alias("earlier_copies"))
    right = nodes.select("pos", shown.alias("later"), F.col("copies").alias("later_copies"))
    if k < 0:
        pairs = nodes.select("pos", F.col("pos").alias("earlier_pos")).limit(0)
    else:
        pairs = bucket_pairs(nodes, hamming_blocking(words, bits, k, count))
        pairs = pairs.withColumnRenamed("earlier", "earlier_pos")
    found = pairs.join(left, "earlier_pos").join(right, "pos")
    distance = hamming(hex_words("earlier", bits), hex_words("later", bits))
    return found.select(
        "earlier", "later", distance.alias("distance"), "earlier_copies", "later_copies"
    )


def _grouped(
    rows: DataFrame, nodes: DataFrame, clusters: DataFrame, features: list[str], kind: str
) -> DataFrame:
    """Rows of clusters with more than one row.

    `nodes` has the features and how many `copies` each stands for, `clusters` the features and their `group_key`.
    """
    labelled = clusters.select(*features, "group_key").join(nodes.select(*features, F.col("copies").alias("_own")), features)
    sizes = labelled.groupBy("group_key").agg(F.sum("_own").alias("copies")).filter(F.col("copies") > 1)
    members = labelled.drop("_own").join(sizes, "group_key")
    # The nodes already know which feature values stand for too many rows.
    many = nodes.filter(F.col("copies") > ROWS_PER_TASK).select(key_hash(features).alias("key"), "copies").collect()
    hot = HotKeys(features, {r["key"]: r["copies"] // ROWS_PER_TASK + 1 for r in many})
    joined = skewed_join(rows, members, features, "inner", DEFAULT_ORDER, hot)
    return joined.withColumn("kind", F.lit(kind)).drop(*[f for f in features if f.startswith("_")])


def hamming_groups(
    rows: DataFrame,
    fingerprint: str,
    bits: int,
    threshold: float,
    kind: str,
    order: list[str] | None = None,
    heads: int | None = None,
) -> DataFrame:
    """Leader clusters of fingerprints; `group_key` is the leader's fingerprint."""
    usable, words = with_words(rows, fingerprint, bits)
    k = max_distance(bits, threshold)
    nodes = distinct_nodes(usable, words, order or DEFAULT_ORDER)
    if k < 0:
        # Nothing reaches such a threshold, not even equal fingerprints.
        clusters = nodes.select("pos", F.col("pos").alias("leader")).limit(0)
    elif in_tiles(bits, k, count := nodes.count()):
        clusters = Tiles(words, k).clusters(nodes, heads)
    else:
        clusters = leader_clusters(nodes, hamming_blocking(words, bits, k, count), heads)
    named = nodes.select(F.col("pos").alias("leader"), F.concat(*[word_hex(w) for w in words]).alias("group_key"))
    labelled = nodes.select("pos", *words).join(clusters, "pos").join(named, "leader")
    return _grouped(usable, nodes, labelled, words, kind)


def image_groups(state: DataFrame, threshold: float, **options) -> DataFrame:
    return hamming_groups(state, "fingerprint", IMAGE_BITS, threshold, "image", **options)


def video_groups(state: DataFrame, threshold: float, **options) -> DataFrame:
    """Video fingerprints; fallback hashes carry no distance and are left to the exact groups."""
    rows = state.filter(~is_fallback("video_hash"))
    return hamming_groups(rows, "video_hash", VIDEO_BITS, threshold, "video", **options)


def _sweep(nodes: DataFrame, tolerance: float) -> DataFrame:
    """`_key`, `_value` and `group_key` (the `_name` of the leader) of nodes, by one pass in order over each key.

    Leaders of a key lie more than the tolerance apart, so a cell a little wider than that holds one or two, and the
    leaders in reach of a value lie in three cells. `nodes` come by `_key` and `_segment`, sorted by `_first`.
    """
    width = tolerance * (1 + 1e-6)

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, leaders = None, {}
        for batch in batches:
            names = []
            for key, segment, value, name in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                if (key, segment) != current:
                    current, leaders, turn = (key, segment), {}, 0
                cell = floor(value / width) if tolerance > 0 else value
                near = (cell - 1, cell, cell + 1) if tolerance > 0 else (cell,)
                found = [held for c in near for held in leaders.get(c, ()) if abs(value - held[1]) <= tolerance]
                if not found:
                    found = [(turn, value, name)]
                    leaders.setdefault(cell, []).append(found[0])
                    turn += 1
                names.append(min(found)[2])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(names, pa.string())], ["_key", "_value", "group_key"])

    spread = nodes.repartition("_key", "_segment").sortWithinPartitions("_key", "_segment", "_first")
    key = nodes.schema["_key"].dataType.simpleString()
    return spread.select("_key", "_segment", "_value", "_name").mapInArrow(sweep, f"_key {key}, _value double, group_key string")


def _segments(nodes: DataFrame, tolerance: float, most: int) -> DataFrame:
    """`_segment` for the nodes of keys with more than `most` of them: values across an empty cell never meet."""
    crowded = checkpointed(nodes.groupBy("_key").agg(F.count("*").alias("_n")).filter(F.col("_n") > most).select("_key"))
    if tolerance <= 0 or crowded.isEmpty():
        return nodes.withColumn("_segment", F.lit(0).cast("bigint"))
    nodes = nodes.withColumn("_cell", F.floor(F.col("_value") / F.lit(tolerance * (1 + 1e-6))).cast("double"))
    cells = nodes.join(crowded, "_key", "left_semi").select("_key", "_cell").distinct()
    in_order = Window.partitionBy("_key").orderBy("_cell")
    gap = F.coalesce((F.col("_cell") - F.lag("_cell").over(in_order) > 1).cast("bigint"), F.lit(0))
    cells = checkpointed(cells.withColumn("_gap", gap).withColumn("_segment", F.sum("_gap").over(in_order)).drop("_gap"))
    return nodes.join(cells, ["_key", "_cell"], "left").withColumn("_segment", F.coalesce("_segment", F.lit(0)))


def tolerance_groups(
    rows: DataFrame,
    key: str,
    value: str,
    tolerance: float,
    kind: str,
    order: list[str] | None = None,
    heads: int | None = None,
) -> DataFrame:
    """Leader clusters of rows with an equal key and values at most `tolerance` from the leader's.

    One pass in order over each key, without rounds. Keys with more than `heads` distinct values are cut at gaps wider
    than the tolerance, so that their parts can be swept apart; a key without gaps is one sorted stream.
    """
    usable = rows.filter(F.abs(value) < float("inf"))  # neither NaN nor infinite: those are close to nothing
    first = F.min(F.struct(*(order or DEFAULT_ORDER))).alias("_first")
    nodes = usable.groupBy(F.col(key).alias("_key"), F.col(value).cast("double").alias("_value")).agg(first, F.count("*").alias("copies"))
    nodes = checkpointed(nodes.withColumn("_name", F.concat_ws("@", "_key", F.to_json("_first"))))
    found = checkpointed(_sweep(_segments(nodes, tolerance, heads or KEY_NODES), tolerance))
    renamed = {"_key": key, "_value": value}
    return _grouped(usable, nodes.withColumnsRenamed(renamed), found.withColumnsRenamed(renamed), [key, value], kind)


def audio_groups(state: DataFrame, **options) -> DataFrame:
    """Equal audio hash and durations within two seconds of the leader's; unknown durations match each other."""
    duration = parse_duration(F.try_element_at("attributes", F.lit("duration")))
    rows = state.filter(F.trim("audio_hash") != "").withColumn("_duration", duration)
    return tolerance_groups(rows, "audio_hash", "_duration", DURATION_TOLERANCE, "audio", **options)


def find_similar(
    state: DataFrame,
    threshold: int | None = None,
    width: str | None = None,
    height: str | None = None,
    order: list[str] | None = None,
) -> DataFrame:
    """Duplicate groups in either mode: exact without a positive threshold, else image, video, text and audio
    similarity together, told apart by `kind`.
    """
    if threshold is None or threshold <= 0:
        return exact_groups(state, width, height)
    rows = checkpointed(candidates(state, width, height))  # every kind reads it several times
    parts = [
        image_groups(rows, threshold, order=order),
        video_groups(rows, threshold, order=order),
        text_groups(rows),
        audio_groups(rows, order=order),
    ]
    columns = ["kind", "group_key", "copies", *[f.name for f in FILE_RECORD]]
    return reduce(DataFrame.unionByName, [p.select(*columns) for p in parts])
