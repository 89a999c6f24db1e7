import random

import pandas as pd
import pytest
from conftest import rows
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import Window, functions as F

from twinfinder.functions.hashing import max_distance
from twinfinder.operators import exact, index, rank, similar
from twinfinder.plans import leaders
from twinfinder.session import checkpointed
from twinfinder.plans.numbering import numbered, row_numbers
from twinfinder.plans.skew import HotKeys, find_hot_keys, skewed_join
from twinfinder.sources import report as reports


def grouped(df, member="path"):
    """Groups as a sorted list of sorted members."""
    found = {}
    for r in df.select("kind", "group_key", member).collect():
        found.setdefault((r["kind"], r["group_key"]), []).append(r[member])
    return sorted(sorted(g) for g in found.values())


# --- building blocks ---------------------------------------------------------------------------------------------

def skewed(spark, n=400, hot=250):
    return spark.range(n).select(
        F.when(F.col("id") < hot, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 20)).alias("key"),
        F.col("id").cast("string").alias("path"),
        F.lit("r").alias("repo"),
        (F.col("id") * 7919 % 1009).alias("v"),
    )


def test_hot_keys_are_found(spark):
    df = skewed(spark)
    hot = find_hot_keys(df, ["key"], rows_per_task=100, sample=1.0)
    assert list(hot.slices.values()) == [3]
    cold, large = hot.split(df)
    assert large.select("key").distinct().collect()[0][0] == "hot"
    assert cold.count() + large.count() == 400
    assert not find_hot_keys(df, ["key"], rows_per_task=1000, sample=1.0)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_skewed_join_equals_plain_join(spark, how):
    df = skewed(spark)
    one = df.filter("key <> 'k3'").groupBy("key").agg(F.count("*").alias("n"))
    hot = find_hot_keys(df, ["key"], rows_per_task=50, sample=1.0)
    assert hot
    got = skewed_join(df, one, ["key"], how, ["path"], hot)
    plain = df.join(one, ["key"], how)
    assert got.columns == plain.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, plain.collect()))


def test_hot_rows_really_spread(spark):
    df = skewed(spark)
    hot = HotKeys(["key"], find_hot_keys(df, ["key"], rows_per_task=50, sample=1.0).slices)
    plan = skewed_join(df, df.select("key").distinct(), ["key"], "inner", ["path"], hot)
    assert "_salt" in plan._jdf.queryExecution().optimizedPlan().toString()


def test_numbered_and_row_numbers(spark):
    df = skewed(spark)
    got = [r["v"] for r in numbered(df, [F.col("v").asc(), F.col("path").asc()], "n").orderBy("n").collect()]
    assert got == sorted(got)
    numbers = [r["n"] for r in numbered(df, [F.col("v").asc(), F.col("path").asc()], "n").collect()]
    assert sorted(numbers) == list(range(400))
    order = [F.col("v").asc(), F.col("path").asc()]
    hot = find_hot_keys(df, ["key"], rows_per_task=100, sample=1.0)
    split = row_numbers(df, ["key"], order, "n", hot)
    plain = df.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy(*order)))
    assert rows(split, "key", "path", "n") == rows(plain, "key", "path", "n")


def greedy(n, similar_to):
    """Leader of each node, visiting nodes in order."""
    heads, leader = [], {}
    for i in range(n):
        leader[i] = next((h for h in heads if similar_to(h, i)), i)
        if leader[i] == i:
            heads.append(i)
    return leader


@pytest.mark.parametrize("seed, n, p", [(1, 60, 0.05), (2, 80, 0.2), (3, 40, 0.0), (4, 50, 0.7)])
def test_leaders_from_pairs(spark, seed, n, p):
    rng = random.Random(seed)
    pairs = {(b, a) for a in range(n) for b in range(a) if rng.random() < p}
    expected = greedy(n, lambda a, b: (a, b) in pairs)
    nodes = spark.range(n).withColumnRenamed("id", "pos")
    frame = spark.createDataFrame([(b, a) for a, b in pairs], "pos bigint, earlier bigint")
    got = leaders.clusters_from_pairs(nodes, frame)
    assert dict(rows(got, "pos", "leader")) == expected


def test_leaders_of_a_chain(spark):
    nodes = spark.range(9).withColumnRenamed("id", "pos")
    chain = spark.createDataFrame([(i + 1, i) for i in range(8)], "pos bigint, earlier bigint")
    got = dict(rows(leaders.clusters_from_pairs(nodes, chain), "pos", "leader"))
    assert got == greedy(9, lambda a, b: b == a + 1)


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    n, stored = 100_000, []
    monkeypatch.setattr(leaders, "checkpointed", lambda df: stored.append(1) or checkpointed(df))
    nodes = spark.range(n).withColumnRenamed("id", "pos")
    chain = nodes.filter("pos > 0").select("pos", (F.col("pos") - 1).alias("earlier"))
    got = leaders.clusters_from_pairs(nodes, chain)
    assert got.filter(F.col("leader") != F.col("pos") - F.col("pos") % 2).isEmpty() and got.count() == n
    assert len(stored) <= 40


def waiting(kind, n):
    """Graphs whose nodes wait for several earlier ones: (pos, earlier) of a grid, a ladder and a dense cloud."""
    if kind == "grid":
        side = int(n**0.5)
        return [(p, q) for p in range(side * side) for q in ([p - side] if p >= side else []) + ([p - 1] if p % side else [])]
    if kind == "ladder":
        return [(p, p - d) for p in range(n) for d in (1, 2, 3) if p >= d]
    return [(p, q) for p in range(n) for q in range(p - p % 20, p)]


@pytest.mark.parametrize("kind", ["grid", "ladder", "cloud"])
def test_nodes_that_wait_for_several_take_few_rounds(spark, monkeypatch, kind):
    n, stored = 100_000, []
    edges = waiting(kind, n)
    earlier = {}
    for p, q in edges:
        earlier.setdefault(p, []).append(q)
    leads = {}
    for p in range(n):
        leads[p] = not any(leads[q] for q in earlier.get(p, ()))
    frame = checkpointed(spark.createDataFrame(pd.DataFrame(edges, columns=["pos", "earlier"])))
    nodes = spark.range(n).withColumnRenamed("id", "pos")
    monkeypatch.setattr(leaders, "checkpointed", lambda df: stored.append(1) or checkpointed(df))
    for block, most in ((leaders.ROWS_PER_WALK, 10), (100_000, 2 * 17 + 6)):
        monkeypatch.setattr(leaders, "ROWS_PER_WALK", block)
        stored.clear()
        got = leaders._decide(nodes, frame)
        assert {r["pos"] for r in got.collect()} == {p for p in leads if leads[p]}
        assert len(stored) <= most


def fingerprints(seed, n, bits, spread):
    rng = random.Random(seed)
    centres = [rng.getrandbits(bits) for _ in range(5)]
    found = []
    for _ in range(n):
        value = rng.choice(centres)
        for _ in range(rng.randrange(spread)):
            value ^= 1 << rng.randrange(bits)
        found.append(f"{value:0{bits // 4}x}")
    return found


@pytest.mark.parametrize("bits, threshold, spread", [(64, 95, 5), (64, 90, 9), (64, 70, 25), (192, 90, 25), (192, 55, 90)])
def test_hamming_pairs_find_everything(spark, make, bits, threshold, spread):
    values = list(dict.fromkeys(fingerprints(7, 60, bits, spread)))
    df = make(*[{"path": f"{i:03}", "video_hash": v} for i, v in enumerate(values)])
    k = max_distance(bits, threshold)
    expected = sorted(
        (a, b) for i, a in enumerate(values) for b in values[i + 1:] if (int(a, 16) ^ int(b, 16)).bit_count() <= k
    )
    assert rows(similar.hamming_pairs(df, "video_hash", bits, threshold), "earlier", "later") == expected


@pytest.mark.parametrize("heads", [None, 3])
@pytest.mark.parametrize("threshold", [90, 75])
def test_hamming_groups_equal_the_loop(make, heads, threshold):
    values = fingerprints(threshold, 90, 64, 20)
    df = make(*[{"path": f"{i:03}", "fingerprint": v} for i, v in enumerate(values)])
    k = max_distance(64, threshold)
    leader = greedy(90, lambda a, b: (int(values[a], 16) ^ int(values[b], 16)).bit_count() <= k)
    expected = {}
    for i, h in leader.items():
        expected.setdefault(h, []).append(f"{i:03}")
    got = similar.image_groups(df, threshold, heads=heads)
    assert grouped(got) == sorted(g for g in expected.values() if len(g) > 1)


@pytest.mark.parametrize("bits", [64, 192])
@pytest.mark.parametrize("k, nodes", [(0, 10), (6, 10**3), (6, 10**9), (19, 2000), (57, 500), (3, 10**10)])
def test_chosen_bands_cannot_miss(bits, k, nodes):
    bands = similar.choose_bands(bits, k, nodes)
    used = [0] * (bits // 64)
    for band in bands:
        mask = band.mask & (2**64 - 1)
        assert mask.bit_count() == band.width and used[band.word] & mask == 0
        used[band.word] |= mask
        flips = band.neighbours()
        assert len(set(flips)) == len(flips) == band.probes <= similar.MOST_PROBES
        assert all(f & ~band.mask == 0 and (f & (2**64 - 1)).bit_count() <= band.radius for f in flips)
    # A pair that is too far apart in all bands differs in at least this many bits (all of a band count if it is full).
    assert sum(b.radius + 1 for b in bands) >= k + 1 or any(b.radius == b.width for b in bands)


@pytest.mark.parametrize("bits, threshold", [(64, 90), (64, 80), (192, 85), (64, 70)])
def test_candidates_are_counted(spark, make, bits, threshold):
    """Pairs that are compared, against all pairs; at 70 % of 64 bits about as many, which is what such a distance costs."""
    rng = random.Random(bits + threshold)
    values = [f"{rng.getrandbits(bits):0{bits // 4}x}" for _ in range(2000)]
    df = make(*[{"path": f"{i:04}", "video_hash": v} for i, v in enumerate(values)])
    usable, words = similar.with_words(df, "video_hash", bits)
    nodes = checkpointed(similar.distinct_nodes(usable, words, ["path"]))
    k = max_distance(bits, threshold)
    blocking = similar.hamming_blocking(words, bits, k, 2000)
    lying = blocking.lying(nodes).select(F.col("pos").alias("earlier"), "bucket")
    met = blocking.probing(nodes).select("pos", "bucket").join(lying, "bucket").filter("earlier < pos").count()
    share = met / (2000 * 1999 / 2)
    expected = similar.candidate_share(similar.choose_bands(bits, k, 2000))
    assert abs(share - expected) < 0.1 * expected + 0.01
    assert share < (1.5 if threshold == 70 else 0.1)


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(st.tuples(st.sampled_from("ab"), st.one_of(st.integers(0, 12).map(float), st.floats(0, 9), st.just(-10.0))),
             min_size=1, max_size=25),
    st.sampled_from([None, 2]),
)
def test_tolerance_groups_equal_the_loop(make, items, heads):
    df = make(*[
        {"path": f"{i:03}", "audio_hash": k, "attributes": {} if v == -10.0 else {"duration": repr(v)}}
        for i, (k, v) in enumerate(items)
    ])
    leader = greedy(len(items), lambda a, b: items[a][0] == items[b][0] and abs(items[a][1] - items[b][1]) <= 2.0)
    expected = {}
    for i, h in leader.items():
        expected.setdefault(h, []).append(f"{i:03}")
    assert grouped(similar.audio_groups(df, heads=heads)) == sorted(g for g in expected.values() if len(g) > 1)


def test_one_key_with_gaps_is_swept_in_segments(spark, monkeypatch):
    rng = random.Random(6)
    data = [("hot", round(rng.uniform(0, 400), 2)) for _ in range(500)] + [("cold", float(i)) for i in range(20)] + [(None, 1.0)]
    rows_ = [(i, k, v) for i, (k, v) in enumerate(data)]
    table = spark.createDataFrame(rows_, "seq long, key string, v double").withColumns({"repo": F.lit("r"), "path": F.col("seq")})
    leader = greedy(len(data), lambda a, b: data[a][0] == data[b][0] and data[a][0] and abs(data[a][1] - data[b][1]) <= 1.5)
    expected = {}
    for i, h in leader.items():
        expected.setdefault(h, []).append(i)
    for most in (10, None):
        found = similar.tolerance_groups(table, "key", "v", 1.5, "audio", ["seq"], most)
        groups = {}
        for r in found.collect():
            groups.setdefault(r["group_key"], []).append(r["seq"])
            assert r["copies"] == len(expected[leader[r["seq"]]])
        assert sorted(map(sorted, groups.values())) == sorted(g for g in expected.values() if len(g) > 1)
    nodes = similar._segments(table.select(F.col("key").alias("_key"), F.col("v").alias("_value")), 1.5, 10)
    assert nodes.filter("_key = 'hot'").select("_segment").distinct().count() > 5
    assert nodes.filter("_key = 'cold' AND _segment > 0").isEmpty() and nodes.count() == len(data)


def test_durations_that_are_no_numbers(make):
    df = make(
        {"path": "a", "audio_hash": "h", "attributes": {"duration": "NaN"}},
        {"path": "b", "audio_hash": "h", "attributes": {"duration": "NaN"}},
        {"path": "c", "audio_hash": "h", "attributes": {"duration": "Infinity"}},
        {"path": "d", "audio_hash": "h", "attributes": {"duration": "00:01:23"}},
        {"path": "e", "audio_hash": "h"},
        {"path": "f", "audio_hash": "h", "attributes": {"duration": "1e300"}},
        {"path": "g", "audio_hash": "h", "attributes": {"duration": "1e300"}},
    )
    assert grouped(similar.audio_groups(df)) == [["d", "e"], ["f", "g"]]


# --- literal cases -----------------------------------------------------------------------------------------------

def test_image_pair(make):
    df = make({"path": "a", "fingerprint": "000000000000000f"}, {"path": "b", "fingerprint": "000000000000000e"})
    assert grouped(similar.find_similar(df, 90)) == [["a", "b"]]
    assert grouped(similar.find_similar(df, 100)) == []
    assert grouped(similar.find_similar(df, 101)) == []


def test_blank_and_broken_fingerprints_are_left_out(make):
    df = make(*[{"path": f"p{i}", "fingerprint": f, "hash": f"{i}"} for i, f in enumerate(["", "", None, "xyz", "xyz", "0f"])])
    assert grouped(similar.find_similar(df, 50)) == []


def test_video_pair_and_fallback(make):
    df = make(
        {"path": "a", "video_hash": "f" * 48}, {"path": "b", "video_hash": "f" * 47 + "e"},
        {"path": "c", "video_hash": "fallback:" + "0" * 64}, {"path": "d", "video_hash": "fallback:" + "0" * 64},
    )
    assert grouped(similar.video_groups(df, 95)) == [["a", "b"]]


def test_text_pair_and_audio_pair(make):
    df = make(
        {"path": "a", "pdf_hash": "t"}, {"path": "b", "pdf_hash": "t"}, {"path": "c", "pdf_hash": " "}, {"path": "d", "pdf_hash": " "},
        {"path": "x", "audio_hash": "s", "attributes": {"duration": "120.5"}},
        {"path": "y", "audio_hash": "s", "attributes": {"duration": "121.8"}},
    )
    got = similar.find_similar(df, 90)
    assert grouped(got) == [["a", "b"], ["x", "y"]]
    assert {r["kind"] for r in got.collect()} == {"text", "audio"}


def test_leader_takes_only_what_is_similar_to_it(make):
    df = make(*[{"path": p, "fingerprint": f"{v:016x}"} for p, v in [("a", 0), ("b", 0x3F), ("c", 0xFFF)]])
    assert grouped(similar.image_groups(df, 90)) == [["a", "b"]]


def test_exact_groups(make):
    df = make(
        {"path": "a", "hash": "h", "size": 5}, {"path": "b", "hash": "h", "size": 5}, {"path": "c", "hash": "h", "size": 6},
        {"path": "d", "hash": "h", "size": 5, "missing": True}, {"path": "e", "hash": "z", "size": 1},
    ).unionByName(make({"path": "f", "hash": "h", "size": 5}, repo="other"))
    assert grouped(exact.exact_groups(df)) == [["a", "b", "f"]]
    assert grouped(similar.find_similar(df)) == grouped(similar.find_similar(df, 0)) == [["a", "b", "f"]]
    assert {r["copies"] for r in exact.exact_groups(df).collect()} == {3}


def test_fallback_groups_and_shared_rows(make):
    df = make(
        {"path": "a", "hash": "1", "size": 5, "video_hash": "fallback:v", "last_modified": 1},
        {"path": "b", "hash": "2", "size": 5, "video_hash": "fallback:v", "last_modified": 2},
        {"path": "c", "hash": "2", "size": 5, "last_modified": 3},
        {"path": "d", "hash": "9", "size": 6, "video_hash": "fallback:v"},
    )
    groups = exact.exact_groups(df)
    assert grouped(groups) == [["a", "b"], ["b", "c"]]
    # b loses against a in one group but is the copy to keep in the other
    assert rows(rank.removal_plan(groups), "action", "path") == [("keep", "a"), ("keep", "b"), ("remove", "c")]


@pytest.mark.parametrize("limits", [{}, {"rows_per_task": 2, "sample": 1.0}])
def test_survivor_order(make, limits):
    df = make(
        {"path": "young", "hash": "h", "size": 7, "last_modified": 2000},
        {"path": "b", "hash": "h", "size": 7, "last_modified": 1000},
        {"path": "A", "hash": "h", "size": 7, "last_modified": 1000},
        {"path": "small", "hash": "h", "size": 7, "last_modified": 9000, "image_size": (1, 1)},
        {"path": "large", "hash": "h", "size": 7, "last_modified": 9999, "image_size": (50_000, 50_000)},
    )
    ranked = rank.ranked_exact(df, **limits)
    assert [r["path"] for r in ranked.orderBy("rank").collect()] == ["large", "small", "A", "b", "young"]
    assert rows(rank.survivors(exact.exact_groups(df)), "path") == [("large",)]


def test_larger_first_in_similar_groups(make):
    df = make({"path": "a", "fingerprint": "0" * 16, "size": 11}, {"path": "b", "fingerprint": "0" * 16, "size": 12})
    ranked = rank.rank_group(similar.image_groups(df, 90))
    assert rows(ranked, "rank", "path") == [(1, "b"), (2, "a")]


def test_removal_plan_updates_the_log(make):
    log = make(
        {"path": "old", "hash": "h", "size": 7, "last_modified": 1000}, {"path": "new", "hash": "h", "size": 7, "last_modified": 2000}
    )
    state = index.latest(log)
    plan = rank.removal_plan(exact.exact_groups(state))
    assert rows(plan, "action", "path") == [("keep", "old"), ("remove", "new")]
    after = rank.apply_plan_to_log(log, state, plan)
    assert rows(index.latest(after), "path", "missing") == [("new", True), ("old", False)]
    assert rank.removal_plan(exact.exact_groups(index.latest(after))).count() == 0


def test_move_plan(make, spark):
    df = make(
        {"path": "a/x", "hash": "1", "last_modified": 1}, {"path": "b/x", "hash": "1", "last_modified": 2},
        {"path": "c/x", "hash": "2", "last_modified": 1}, {"path": "d/x", "hash": "2", "last_modified": 2},
        {"path": "e/y", "hash": "2", "last_modified": 3},
    )
    groups = exact.exact_groups(df)
    assert rows(rank.move_plan(groups, "/m"), "action", "path", "target") == [
        ("move", "b/x", "/m/x"), ("move", "e/y", "/m/y"), ("skip", "d/x", "/m/x")
    ]
    taken = spark.createDataFrame([("/m/x",)], "path string")
    assert rows(rank.move_plan(groups, "/m", taken), "action", "path") == [("move", "e/y"), ("skip", "b/x"), ("skip", "d/x")]


def test_keep_plan(make, spark):
    df = make(*[{"path": p, "hash": "h", "last_modified": i} for i, p in enumerate("abc")])
    ranked = rank.ranked_exact(df)
    assert rows(rank.keep_plan(ranked, rank.default_keep_set(ranked)), "path") == [("b",), ("c",)]
    assert rows(rank.keep_plan(ranked, ranked.filter("path = 'c'")), "path") == [("a",), ("b",)]


def test_group_numbers(make):
    df = make(*[{"path": f"{h}{i}", "hash": h} for h in "cab" for i in range(2)])
    got = rows(rank.number_groups(exact.exact_groups(df)), "group_no", "path")
    assert got == [(1, "a0"), (1, "a1"), (2, "b0"), (2, "b1"), (3, "c0"), (3, "c1")]


# --- reports -----------------------------------------------------------------------------------------------------

REPORT_ROWS = [
    {"path": "a/<x>.mp3", "hash": "h", "size": 2048, "mime": "audio/mpeg", "attributes": {"duration": "00:01:23", "artist": "A&B"}},
    {"path": "b c.png", "hash": "h", "size": 2048, "mime": "image/png", "image_size": (3, 4), "last_modified": 86_400_000},
]


def test_markdown_report(make, tmp_path, spark):
    lines = reports.report(exact.exact_groups(make(*REPORT_ROWS)), "md", roots={"r": "/base"})
    got = [r["text"] for r in lines.collect()]
    assert got[0] == "# Duplicate/Similar Files Report\n\nType: Exact Duplicates\n"
    assert got[1].startswith("## Group 1\nHash: `h` (2.0 KB)\n\n- **Repo:** r\n  - **Path:** `b c.png`\n")
    assert "  - **Image:** 3x4\n" in got[1] and "![thumbnail](file:/base/b%20c.png)" in got[1]
    assert "  - **artist:** A&B\n  - **duration:** 00:01:23\n" in got[2] and got[2].endswith("---\n")
    reports.write_report(lines, str(tmp_path / "md"))
    assert spark.read.text(str(tmp_path / "md")).count() > 10


def test_html_report_is_escaped(make):
    lines = reports.report(exact.exact_groups(make(*REPORT_ROWS)), "html", roots={"r": "/base"})
    text = "\n".join(r["text"] for r in lines.collect())
    assert "<code>a/&lt;x&gt;.mp3</code>" in text and "A&amp;B" in text and "<x>" not in text
    assert text.startswith("<!DOCTYPE html>") and text.endswith("</body>\n</html>")
    assert text.count("<div") == text.count("</div>") == 3
    with pytest.raises(ValueError):
        reports.report(exact.exact_groups(make(*REPORT_ROWS)), "pdf")


def test_similar_report_and_listing(make):
    df = make({"path": "a", "fingerprint": "0" * 16}, {"path": "b", "fingerprint": "0" * 16})
    groups = similar.image_groups(df, 90)
    text = [r["text"] for r in reports.report(groups, "md", threshold=90).collect()]
    assert "Type: Similarity (Threshold: 90%)" in text[0] and "Hash:" not in text[1]
    listed = reports.groups_table(groups, 90)
    assert rows(listed, "rank", "path", "threshold", "fingerprint") == [(1, "a", 90, "0" * 16), (2, "b", 90, "0" * 16)]
    assert {"hash", "size"} <= set(reports.groups_table(exact.exact_groups(df)).columns)
