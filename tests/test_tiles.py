"""Wide distances are compared in tiles; results equal plain loops over all rows."""

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from twinfinder.functions.hashing import max_distance
from twinfinder.operators import similar
from twinfinder.plans import tiles
from twinfinder.plans.tiles import Tiles
from twinfinder.queries import QUERIES


def random_words(seed, n, words, centres=12):
    rng = random.Random(seed)
    bases = [[rng.getrandbits(64) for _ in range(words)] for _ in range(centres)]
    found = {}
    while len(found) < n:
        value = [w ^ (rng.getrandbits(64) & rng.getrandbits(64) & rng.getrandbits(64)) for w in rng.choice(bases)]
        found[tuple(value)] = None
    return list(found)


def apart(a, b):
    return sum((x ^ y).bit_count() for x, y in zip(a, b))


def as_nodes(spark, values):
    signed = [[w - (1 << 64) if w >> 63 else w for w in v] for v in values]
    columns = ["pos", *[f"_w{i}" for i in range(len(values[0]))], "copies"]
    return spark.createDataFrame([(i, *v, i % 3 + 1) for i, v in enumerate(signed)], ", ".join(f"{c} bigint" for c in columns))


def first_leaders(n, similar_to):
    heads, leader = [], {}
    for i in range(n):
        leader[i] = next((h for h in heads if similar_to(h, i)), i)
        if leader[i] == i:
            heads.append(i)
    return leader


@pytest.fixture
def small_tiles(monkeypatch):
    """Everything in many small pieces, and no way through buckets."""
    for name, value in {"BLOCK": 40, "BLOCKS": 5, "LEAST": 7, "STEP": 96, "STRIDE": 4, "PAIRS": 50, "SPANS": 3, "FEW_TESTS": 500}.items():
        monkeypatch.setattr(tiles, name, value)

    def refuse(*_):
        raise AssertionError("probed buckets")

    monkeypatch.setattr(similar, "hamming_blocking", refuse)


@pytest.mark.parametrize("n_words, k, heads", [(1, 19, None), (3, 57, 3), (3, 0, None), (1, 63, 3), (4, 80, None)])
def test_clusters_in_tiles(spark, small_tiles, n_words, k, heads):
    values = random_words(k, 150, n_words)
    found = Tiles([f"_w{i}" for i in range(n_words)], k).clusters(as_nodes(spark, values), heads)
    expected = first_leaders(len(values), lambda a, b: apart(values[a], values[b]) <= k)
    assert rows(found, "pos", "leader") == sorted(expected.items())


@pytest.mark.parametrize("n_words, k", [(1, 63), (3, 57)])
def test_no_tiles_for_no_nodes(spark, n_words, k):
    words = [f"_w{i}" for i in range(n_words)]
    one = as_nodes(spark, random_words(1, 1, n_words))
    assert Tiles(words, k).clusters(one.limit(0)).count() == 0
    assert rows(Tiles(words, k).clusters(one), "pos", "leader") == [(0, 0)]


def test_tiles_where_comparing_is_cheaper():
    for nodes in (10**3, 10**5, 10**6, 10**7):
        assert similar.in_tiles(64, max_distance(64, 70), nodes) and similar.in_tiles(192, max_distance(192, 70), nodes)
        assert similar.in_tiles(64, max_distance(64, 75), nodes)
    assert not similar.in_tiles(64, max_distance(64, 90), 10**6)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Embeddings around a few centres, some equal; documents and events for the query over all kinds."""
    folder, rng = str(tmp_path_factory.mktemp("tables")), random.Random(3)
    centres = [[rng.gauss(0, 0.125) for _ in range(64)] for _ in range(15)]
    vectors = [[x + rng.gauss(0, 0.06) for x in rng.choice(centres)] for _ in range(170)]
    vectors += vectors[:10]
    spark.createDataFrame(
        [(i * 3, v, i % 4) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, label int"
    ).write.parquet(f"{folder}/embeddings.parquet")
    spark.createDataFrame(
        [(i, f"text {i % 5}", "en", "s1", 6) for i in range(8)], "doc_id long, text string, lang string, source string, n_chars long"
    ).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(
        [(i, i % 3, "click", float(i)) for i in range(12)], "event_id long, user_id long, event_type string, value double"
    ).withColumn("ts", F.timestamp_seconds("event_id")).write.parquet(f"{folder}/events.parquet")
    return folder


def words_of(spark, folder, limits):
    table = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    return {r["vec_id"]: tuple(sum((x > limit) << i for i, x in enumerate(r["embedding"])) for limit in limits) for r in table}


def expected_clusters(spark, folder, limits, threshold):
    """(group_key, copies, seq) of clusters with more than one row, by a loop over all rows."""
    words = words_of(spark, folder, limits)
    order, k = sorted(words), max_distance(64 * len(limits), threshold)
    leader = first_leaders(len(order), lambda a, b: apart(words[order[a]], words[order[b]]) <= k)
    sizes = {h: list(leader.values()).count(h) for h in leader.values()}
    assert len(sizes) > 5
    shown = {h: "".join(f"{w:016x}" for w in words[order[h]]) for h in sizes}
    return sorted((shown[h], sizes[h], order[i]) for i, h in leader.items() if sizes[h] > 1)


IMAGE, VIDEO = [0], [0, 0.05, -0.05]


def test_temporal_clusters_in_tiles(spark, tables, small_tiles):
    got = QUERIES["temporal_clusters"](spark, tables)
    assert rows(got, "group_key", "copies", "seq") == expected_clusters(spark, tables, VIDEO, 70)


def test_hamming_clusters_in_tiles(spark, tables, small_tiles):
    got = QUERIES["hamming_clusters"](spark, tables)
    assert rows(got, "group_key", "copies", "seq") == expected_clusters(spark, tables, IMAGE, 70)


def test_crowded_clusters_take_few_rounds(spark, tables, small_tiles, monkeypatch):
    """Rounds start with few nodes; their number does not depend on how crowded buckets are."""
    rounds = []
    monkeypatch.setattr(tiles, "_cut", lambda undecided, size, cut=tiles._cut: rounds.append(size) or cut(undecided, size))
    monkeypatch.setattr(tiles, "BLOCK", 1000)
    got = QUERIES["hamming_clusters_crowded"](spark, tables)
    assert rows(got, "group_key", "copies", "seq") == expected_clusters(spark, tables, IMAGE, 70)
    assert rounds[0] == 48 and len(rounds) <= 4 and rounds == [48 * 2**i for i in range(len(rounds))]


@pytest.mark.parametrize("n_words, k", [(1, 19), (3, 57), (1, 63), (4, 80)])
def test_pairs_in_tiles(spark, small_tiles, n_words, k):
    values = random_words(k, 90, n_words)
    names = [f"_w{i}" for i in range(n_words)]
    found = Tiles(names, k).pairs(as_nodes(spark, values), len(values), ["copies"]).collect()
    expected = [(b, a, apart(values[a], values[b])) for b in range(len(values)) for a in range(b) if apart(values[a], values[b]) <= k]
    assert sorted((r["pos"], r["earlier"], r["distance"]) for r in found) == expected
    for r in found:
        assert tuple(r[w] % (1 << 64) for w in names) == values[r["pos"]] and r["copies"] == r["pos"] % 3 + 1
        assert tuple(r[f"_e_{w}"] % (1 << 64) for w in names) == values[r["earlier"]] and r["_e_copies"] == r["earlier"] % 3 + 1
    none = as_nodes(spark, values).limit(0)
    assert Tiles(names, k).pairs(none, 0, ["copies"]).count() == 0


@pytest.mark.parametrize("per_candidate", [1e-9, 1e9])
@pytest.mark.parametrize("query, limits, threshold", [("hamming_pairs", IMAGE, 70), ("video_pairs_85", VIDEO, 85)])
def test_pair_queries_either_way(spark, tables, monkeypatch, query, limits, threshold, per_candidate):
    """Tiles and buckets find the same pairs, with their copies; by default these 170 nodes take tiles."""
    assert similar.in_tiles(64 * len(limits), max_distance(64 * len(limits), threshold), 170)
    monkeypatch.setattr(similar, "WORDS_PER_CANDIDATE", per_candidate)
    words = words_of(spark, tables, limits)
    copies, k = {}, max_distance(64 * len(limits), threshold)
    for seq in sorted(words):
        copies[words[seq]] = copies.get(words[seq], 0) + 1
    nodes, shown = list(copies), {w: "".join(f"{x:016x}" for x in w) for w in copies}
    expected = [
        (shown[a], shown[b], apart(a, b), copies[a], copies[b]) for i, b in enumerate(nodes) for a in nodes[:i] if apart(a, b) <= k
    ]
    got = QUERIES[query](spark, tables)
    assert rows(got, "earlier", "later", "distance", "earlier_copies", "later_copies") == sorted(expected)
    assert ("bucket" in got._jdf.queryExecution().optimizedPlan().toString()) == (per_candidate < 1)


@pytest.mark.parametrize("n_words", [1, 3])
def test_leaders_through_buckets_equal_tiles(spark, tables, monkeypatch, n_words):
    values = random_words(9, 120, n_words)
    nodes, names, bits = as_nodes(spark, values), [f"_w{i}" for i in range(n_words)], 64 * n_words
    k = max_distance(bits, 80)
    blocking = similar.hamming_blocking(names, bits, k, len(values))
    for heads in (None, 5):
        found = similar.leader_clusters(nodes, blocking, heads)
        assert rows(found, "pos", "leader") == rows(Tiles(names, k).clusters(nodes, heads), "pos", "leader")


def test_report_of_clusters_in_tiles(spark, tables, small_tiles):
    lines = QUERIES["report_html"](spark, tables).orderBy("group_no", "rank").collect()
    expected = expected_clusters(spark, tables, IMAGE, 70)
    numbers = {key: i for i, key in enumerate(sorted({e[0] for e in expected}), 1)}
    shown = [(r["group_no"], int(r["text"].split("<code>")[1].split("</code>")[0])) for r in lines[1:-1]]
    assert shown == [(numbers[key], seq) for key, _, seq in expected]
    assert lines[0]["text"].startswith("<!DOCTYPE html>") and lines[-1]["text"].endswith("</html>")


def test_all_kinds_with_tiles(spark, tables, small_tiles):
    got = QUERIES["find_similar"](spark, tables)
    for kind, limits in (("image", IMAGE), ("video", VIDEO)):
        assert rows(got.filter(F.col("kind") == kind), "group_key", "copies", "seq") == expected_clusters(spark, tables, limits, 75)
    assert rows(got.filter("kind = 'text'"), "copies", "seq") == [(2, i) for i in (0, 1, 2, 5, 6, 7)]
    assert got.filter("kind = 'audio'").isEmpty()  # the values of a key are three apart
