import os
import random
from datetime import datetime, timedelta

import pytest
from conftest import rows
from pyspark.sql import functions as F

from twinfinder.functions import hashing, media
from twinfinder.operators import diff, exact, files, filters, incremental, index, rank, reconcile, update
from twinfinder.plans.skew import find_hot_keys
from twinfinder.session import checkpointed
from twinfinder.sources import files as scan, formats
from twinfinder.sources.versions import Versions
from twinfinder.streaming import state as streams


# --- change detection --------------------------------------------------------------------------------------------

def listing(spark, *entries):
    return spark.createDataFrame(entries, "path string, size bigint, last_modified bigint")


STATE = [
    {"path": "same", "hash": "1", "size": 5, "last_modified": 10},
    {"path": "older", "hash": "2", "size": 5, "last_modified": 10},
    {"path": "newer", "hash": "3", "size": 5, "last_modified": 10},
    {"path": "bigger", "hash": "4", "size": 5, "last_modified": 10},
    {"path": "back", "hash": "5", "size": 5, "last_modified": 10, "missing": True},
    {"path": "back-changed", "hash": "6", "size": 5, "last_modified": 10, "missing": True},
    {"path": "gone", "hash": "7", "size": 5},
    {"path": "long-gone", "hash": "8", "missing": True},
]


def found(spark):
    return listing(
        spark, ("same", 5, 10), ("older", 5, 9), ("newer", 5, 11), ("bigger", 6, 10), ("back", 5, 10),
        ("back-changed", 7, 10), ("brand-new", 1, 1),
    )


def test_classify_changes(spark, make):
    state = make(*STATE)
    changes = update.classify_changes(found(spark), state)
    assert dict(rows(changes, "path", "status")) == {
        "same": "unchanged", "older": "unchanged", "newer": "changed", "bigger": "changed", "back": "reappeared",
        "back-changed": "changed", "gone": "deleted", "brand-new": "added",
    }
    assert rows(update.to_read(changes), "path") == [("back-changed",), ("bigger",), ("brand-new",), ("newer",)]
    assert rows(update.reappeared(changes, state), "path", "hash", "missing", "last_modified") == [("back", "5", False, 10)]
    assert rows(update.tombstones(state, found(spark)), "path", "hash", "missing") == [("gone", "7", True)]
    mimes = found(spark).select("path", F.lit("text/plain").alias("mime"))
    assert dict(rows(update.update_stats(changes, mimes), "counter", "value")) == {
        "added": 5, "unchanged": 2, "deleted": 1, "text/plain": 5
    }


def test_nothing_is_deleted_below_a_failed_directory(spark, make):
    state = make({"path": "a/b/x"}, {"path": "a/y"}, {"path": "ab/z"}, {"path": "root"})
    failed = spark.createDataFrame([("a",)], "path string")
    none = listing(spark, ("other", 1, 1))
    assert rows(update.tombstones(state, none, failed=failed), "path") == [("ab/z",), ("root",)]
    everything = spark.createDataFrame([("",)], "path string")
    assert update.tombstones(state, none, failed=everything).count() == 0


def test_scan_guard():
    update.check_scan(files=0, directories=1, errors=0)
    update.check_scan(files=3, directories=1, errors=2)
    update.check_scan(files=0, directories=2, errors=1)
    with pytest.raises(RuntimeError):
        update.check_scan(files=0, directories=1, errors=1)


def test_needs_fingerprint(make):
    df = make(
        {"path": "a", "mime": "image/png"}, {"path": "b", "mime": "image/png", "fingerprint": "0" * 16},
        {"path": "c", "mime": "text/plain"}, {"path": "d", "mime": "image/png", "missing": True},
    )
    assert rows(update.needs_fingerprint(df), "path") == [("a",)]


def test_scan_hash_and_update(spark, make, tmp_path):
    root = tmp_path / "root"
    (root / "sub" / "deep").mkdir(parents=True)
    (root / "a.txt").write_bytes(b"abcdef")
    (root / "_hidden").write_bytes(b"x" * 30)
    (root / "sub" / "b.png").write_bytes(b"\x89PNG\r\n\x1a\n" + b"p" * 30)
    (root / "sub" / "deep" / "c.mp3").write_bytes(b"ID3\x04\0\0\0\0\0\x02ttsound")
    os.symlink(root / "a.txt", root / "link.txt")
    os.symlink(root / "sub", root / "linked")
    entries = scan.scan_files(spark, str(root), partitions=2)
    listed = entries.filter("kind = 'file'").select("path", "size", "last_modified")
    assert rows(listed, "path", "size") == [("_hidden", 30), ("a.txt", 6), ("sub/b.png", 38), ("sub/deep/c.mp3", 17)]
    assert rows(entries.filter("kind = 'dir'"), "path") == [("sub",), ("sub/deep",)]
    assert entries.filter("kind = 'failed'").count() == 0
    with pytest.raises(FileNotFoundError):
        scan.scan_files(spark, str(root / "nope"))

    quick = scan.list_files(spark, str(root))
    assert {r["path"] for r in quick.collect()} >= {"a.txt", "sub/b.png", "sub/deep/c.mp3"}

    changes = update.classify_changes(listed, make({"path": "a.txt", "size": 6, "last_modified": 1 << 50}))
    read = checkpointed(scan.hash_files(str(root), update.to_read(changes), partitions=2))
    assert read.filter("message is not null").count() == 0
    records = update.enrich(read.withColumn("image_fingerprint", F.lit("f" * 16)))
    got = {r["path"]: r for r in records.collect()}
    assert set(got) >= {"sub/b.png", "sub/deep/c.mp3"} and "a.txt" not in got
    assert got["sub/b.png"]["mime"] == "image/png" and got["sub/b.png"]["fingerprint"] == "f" * 16
    assert got["sub/deep/c.mp3"]["audio_hash"] and got["sub/deep/c.mp3"]["fingerprint"] is None
    assert got["sub/deep/c.mp3"]["hash"] == (b"ID3\x04\0\0\0\0\0\x02ttsound").hex()


def test_hash_files_agrees_with_the_columns(spark, tmp_path):
    contents = {
        "empty": b"", "tiny": b"abc", "edge": b"x" * 20, "tag.mp3": b"ID3\x04\0\0\0\0\x01\x00" + b"t" * 128 + b"sound" * 9,
        "short.mp3": b"ID3\x04\0\0\0\0\x01\x00ttt", "big.avi": os.urandom((1 << 20) + 5000), "plain.mp3": os.urandom(200_000),
    }
    for name, data in contents.items():
        (tmp_path / name).write_bytes(data)
    rows_ = [(n, len(d), 1, bytearray(d)) for n, d in contents.items()]
    table = spark.createDataFrame(rows_, "path string, size bigint, last_modified bigint, content binary")
    hashed = scan.hash_files(str(tmp_path), table.unionByName(
        spark.createDataFrame([("nope", 1, 1, None)], table.schema)), partitions=2)
    expected = table.select(
        "path", hashing.content_hash("content"), hashing.fallback_hash("content"), hashing.audio_chunk_hash("content"),
        media.detect_mime(F.substring("content", 1, 64), "path"),
    )
    got = hashed.filter("message is null").select("path", "hash", "fallback_hash", "audio_hash", "mime")
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, map(tuple, expected.collect())))
    assert rows(hashed.filter("message is not null"), "path", "hash") == [("nope", None)]


# --- rolling rate ------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("hot", [False, True])
def test_rolling_span(spark, hot):
    df = spark.range(1500).select(F.lit("k").alias("key"), "id", (F.col("id") * 1000).alias("ms"))
    keys = find_hot_keys(df, ["key"], rows_per_task=100 if hot else 10**6, sample=1.0)
    got = {r["id"]: r for r in update.rolling_eta(df, "key", "ms", "id", hot=keys).collect()}
    assert len(got) == 1500
    assert (got[999]["span"], got[999]["recent_count"], got[999]["remaining_millis"]) == (999_000, 999, 500_000)
    assert (got[1400]["span"], got[1400]["recent_count"]) == (999_000, 999)
    assert got[5]["remaining_millis"] is None and got[6]["remaining_millis"] == 1_493_000
    assert got[1499]["remaining_millis"] == 0 and got[0]["total"] == 1500


def test_slower_recent_rate_wins(spark):
    times = [i * 100 for i in range(100)] + [10_000 + i * 1000 for i in range(50)]
    df = spark.createDataFrame([("k", i, t) for i, t in enumerate(times)], "key string, id bigint, ms bigint")
    row = update.rolling_eta(df, "key", "ms", "id", n=10).filter("id = 129").first()
    assert row["remaining_millis"] == 9000 * 20 // 9


# --- two indexes -------------------------------------------------------------------------------------------------

def test_diff_status_and_plans(make):
    a = make(
        {"path": "n", "hash": "new", "size": 1}, {"path": "e", "hash": "eq", "size": 1}, {"path": "d", "hash": "del", "size": 1},
        {"path": "s", "hash": "eq", "size": 2}, {"path": "t", "hash": "eq", "size": 1, "missing": True}, repo="a",
    )
    b = make(
        {"path": "z", "hash": "eq", "size": 1}, {"path": "y", "hash": "eq", "size": 1},
        {"path": "w", "hash": "eq", "size": 1, "missing": True}, {"path": "x", "hash": "del", "size": 1, "missing": True}, repo="b",
    )
    assert {r["path"]: (r["status"], r["match"]) for r in diff.diff_status(a, b).collect()} == {
        "n": ("new", None), "e": ("equal", "y"), "d": ("deleted_in_target", None), "s": ("new", None)
    }
    assert rows(diff.diff_copy_plan(a, b, "/t"), "path", "target") == [("n", "/t/n"), ("s", "/t/s")]
    assert rows(diff.diff_delete_plan(a, b), "path") == [("e",)]
    hot = find_hot_keys(a, ["hash", "size"], rows_per_task=1, sample=1.0)
    assert hot
    assert rows(diff.diff_status(a, b, hot=hot), "path", "status") == rows(diff.diff_status(a, b), "path", "status")


def test_diff_move_marks_the_source(make):
    a, b = make({"path": "to_move.txt", "hash": "m", "size": 4}, repo="a"), make({"path": "q", "hash": "q"}, repo="b")
    plan = diff.diff_move_plan(a, b, "/t")
    assert rows(plan, "action", "path", "target") == [("move", "to_move.txt", "/t/to_move.txt")]
    assert rows(index.latest(rank.apply_plan_to_log(a, a, plan)), "path", "missing") == [("to_move.txt", True)]


def sync(a, b, **options):
    return rows(diff.sync_plan(a, b, **options), "action", "path")


def test_sync_equal(make):
    a, b = make({"path": "x.txt", "hash": "H1", "size": 5}, repo="a"), make({"path": "y.txt", "hash": "H1", "size": 5}, repo="b")
    assert sync(a, b) == [("equal", "x.txt")]


def test_sync_copy_and_log(make):
    a = make({"path": "dir/a.txt", "hash": "H2", "size": 5}, repo="a")
    b = make({"path": "other", "hash": "H9", "size": 5}, repo="b")
    plan = diff.sync_plan(a, b)
    assert rows(plan, "action", "path", "target") == [("copy", "dir/a.txt", "dir/a.txt")]
    after = index.latest(diff.apply_sync_to_log(b, a, b, plan))
    assert rows(after, "repo", "path", "hash", "missing") == [("b", "dir/a.txt", "H2", False), ("b", "other", "H9", False)]
    assert diff.sync_counters(plan).first().asDict() == {
        "equal": 0, "new": 1, "deleted": 0, "copied": 1, "removed": 0, "skipped": 0, "errors": 0
    }


def test_sync_delete(make):
    a = make({"path": "del.txt", "hash": "H3", "size": 3, "missing": True}, repo="a")
    b = make({"path": "del.txt", "hash": "H3", "size": 3}, {"path": "copy", "hash": "H3", "size": 3}, repo="b")
    assert sync(a, b) == []
    assert sync(a, b, delete_missing=True) == [("delete", "copy"), ("delete", "del.txt")]
    plan = diff.mirror_plan(a, b)
    after = index.latest(diff.apply_sync_to_log(b, a, b, plan))
    assert {r[0] for r in rows(after, "missing")} == {True}


def test_sync_keeps_what_the_source_holds_live(make):
    a = make({"path": "old", "hash": "H", "size": 3, "missing": True}, {"path": "kept", "hash": "H", "size": 3}, repo="a")
    b = make({"path": "b", "hash": "H", "size": 3}, repo="b")
    assert sync(a, b, delete_missing=True) == [("equal", "kept")]


def test_sync_occupied_path(make):
    a = make({"path": "x.txt", "hash": "H2", "size": 5}, repo="a")
    b = make({"path": "x.txt", "hash": "H_OTHER", "size": 9}, repo="b")
    plan = diff.sync_plan(a, b)
    assert rows(plan, "action", "path") == [("skip", "x.txt")]
    assert rows(index.latest(diff.apply_sync_to_log(b, a, b, plan)), "hash") == [("H_OTHER",)]


def test_sync_copies_a_content_once(make, spark):
    a = make(*[{"path": p, "hash": "H", "size": 1} for p in ("a", "b", "c")], repo="a")
    b = make({"path": "a", "hash": "other"}, repo="b")
    assert sync(a, b) == [("copy", "b"), ("equal", "c"), ("skip", "a")]
    taken = spark.createDataFrame([("a",), ("b",), ("c",)], "path string")
    assert sync(a, b, occupied=taken) == [("skip", "a"), ("skip", "b"), ("skip", "c")]
    hot = find_hot_keys(a, ["hash", "size"], rows_per_task=1, sample=1.0)
    assert sync(a, b, hot=hot) == [("copy", "b"), ("equal", "c"), ("skip", "a")]


def test_sync_filter_and_switches(make):
    a = make(
        {"path": "p.png", "hash": "1", "size": 5, "mime": "image/png"}, {"path": "t.txt", "hash": "2", "size": 6, "mime": "text/plain"}, repo="a"
    )
    b = make({"path": "zz", "hash": "zz"}, repo="b")
    assert sync(a, b, where=filters.parse_filter("mime:image")) == [("copy", "p.png")]
    assert sync(a, b, where=filters.parse_filter("size:6")) == [("copy", "t.txt")]
    assert sync(a, b, copy_new=False) == []


# --- applying plans ----------------------------------------------------------------------------------------------

def test_apply_plan(spark, tmp_path):
    base = tmp_path / "r"
    (base / "d").mkdir(parents=True)
    for name in ("keep", "remove", "d/copy", "d/move", "taken"):
        (base / name).write_text(name)
    out = tmp_path / "out"
    out.mkdir()
    (out / "taken").write_text("other")
    plan = spark.createDataFrame(
        [("keep", "r", "keep", None), ("remove", "r", "remove", None), ("copy", "r", "d/copy", "d/copy"),
         ("move", "r", "d/move", "d/move"), ("copy", "r", "taken", "taken"), ("copy", "r", "nope", "nope"),
         ("remove", "unknown", "x", None)],
        "action string, repo string, path string, target string",
    )
    roots = {"r": str(base)}
    dry = files.apply_plan(plan, roots, target_root=str(out), partitions=2)
    assert {r["status"] for r in dry.filter("repo = 'r'").collect()} == {"planned"} and (base / "remove").exists()
    done = checkpointed(files.apply_plan(plan, roots, dry_run=False, target_root=str(out), partitions=2))
    expected = [
        ("keep", "skipped"), ("nope", "error"), ("d/copy", "done"), ("d/move", "done"), ("remove", "done"),
        ("taken", "skipped"), ("x", "error"),
    ]
    assert rows(done, "path", "status") == sorted(expected)
    assert not (base / "remove").exists() and not (base / "d/move").exists() and (base / "d/copy").exists()
    assert (out / "d/move").read_text() == "d/move" and (out / "taken").read_text() == "other"
    again = files.apply_plan(plan, roots, dry_run=False, target_root=str(out), partitions=2)
    assert rows(again, "path", "status") == sorted(expected)
    counted = diff.sync_counters(plan, done).first()
    assert (counted["copied"], counted["errors"]) == (1, 2)


# --- streams -----------------------------------------------------------------------------------------------------

def test_streams_over_several_batches(spark, make, tmp_path):
    folder = str(tmp_path / "in")
    batches = [
        [("p", "h1", 1), ("q", "h1", 1)], [("p", "h2", 2), ("r", "h1", 1)], [("q", "h1", 1)],
    ]
    seq, entries = 0, []
    for batch in batches:
        rows_ = []
        for p, h, s in batch:
            seq += 1
            rows_.append({"path": p, "hash": h, "size": s, "seq": seq, "missing": h == "h2"})
        make(*rows_).coalesce(1).write.mode("append").parquet(folder)
        entries += rows_
    schema = spark.read.parquet(folder).schema
    stream = streams.read_stream(spark, folder, schema, files_per_batch=1)
    out = str(tmp_path / "latest")
    streams.write_latest(streams.latest_stream(stream), out, str(tmp_path / "c1")).awaitTermination()
    whole = spark.read.parquet(folder)
    assert rows(streams.read_latest(spark, out), "path", "hash", "missing") == rows(index.latest(whole), "path", "hash", "missing")

    assert streams.merge_latest(spark, out) == 2 and streams.clean_latest(spark, out) == 3
    make({"path": "p", "hash": "h9", "size": 9, "seq": 50}).coalesce(1).write.mode("append").parquet(folder)
    streams.write_latest(streams.latest_stream(stream), out, str(tmp_path / "c1")).awaitTermination()
    again = index.latest(spark.read.parquet(folder))
    assert rows(streams.read_latest(spark, out), "path", "hash", "missing") == rows(again, "path", "hash", "missing")
    assert streams.merge_latest(spark, out) == 3
    assert rows(streams.read_latest(spark, out), "path", "hash", "missing") == rows(again, "path", "hash", "missing")
    stream = streams.read_stream(spark, folder, schema, files_per_batch=1).filter("seq < 50")
    whole = whole.filter("seq < 50")

    out = str(tmp_path / "contents")
    streams.write_contents(streams.contents_stream(stream), out, str(tmp_path / "c2")).awaitTermination()
    contents = streams.read_contents(spark, out)
    assert rows(contents, "hash", "size", "copies", "first_seq") == [("h1", 1, 4, 1), ("h2", 2, 1, 3)]
    assert rows(streams.exact_duplicates(whole, contents), "seq") == [(2,), (4,), (5,)]


def test_duplicates_within_event_time(spark, tmp_path):
    start = datetime(2024, 1, 1)
    data = [("h", 1, n, start + timedelta(minutes=m)) for n, m in enumerate([0, 5, 200, 300, 500])]
    folder = str(tmp_path / "in")
    for row in data:
        frame = spark.createDataFrame([row], "hash string, size bigint, seq bigint, ts timestamp")
        frame.coalesce(1).write.mode("append").parquet(folder)
    schema = spark.read.parquet(folder).schema
    stream = streams.read_stream(spark, folder, schema, files_per_batch=1)
    query = (
        streams.first_seen_within(stream, "ts", "10 minutes").writeStream.format("parquet")
        .option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out"))
    )
    query.awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "out")), "seq") == [(0,), (4,)]


def test_repeats_are_emitted_on_arrival(spark, tmp_path):
    """Three runs over a growing folder, from one checkpoint; a content whose time has passed counts as new."""
    start = datetime(2024, 1, 1)
    folder, out, offsets = (str(tmp_path / n) for n in ("in", "out", "c"))
    schema = "repo string, path string, seq bigint, hash string, size bigint, at timestamp, more string"

    def arrive(*entries):
        data = [("r", f"p{seq}", seq, content, 1, start + timedelta(minutes=m), None) for seq, content, m in entries]
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(folder)

    def run():
        stream = streams.read_stream(spark, folder, spark.createDataFrame([], schema).schema, files_per_batch=1)
        streams.write_repeats(streams.repeats_stream(stream, "at", "5 minutes", "60 minutes"), out, offsets).awaitTermination()
        return rows(spark.read.parquet(out), "seq", "hash", "first_seq")

    arrive((3, "a", 0), (1, "a", 1), (2, "b", 2), (None, "a", 2), (9, None, 2))
    assert run() == [(3, "a", 1)]
    arrive((4, "b", 20), (5, "c", 20))
    arrive((6, "a", 30))
    assert run() == [(3, "a", 1), (4, "b", 2), (6, "a", 1)]
    arrive((7, "d", 600))  # moves the watermark past all that is held
    arrive((8, "a", 610), (10, "d", 611))
    arrive((11, "a", 620))
    assert run() == [(3, "a", 1), (4, "b", 2), (6, "a", 1), (10, "d", 7), (11, "a", 8)]
    assert run() == [(3, "a", 1), (4, "b", 2), (6, "a", 1), (10, "d", 7), (11, "a", 8)]
    states = spark.read.format("statestore").option("path", offsets).option("stateVarName", "held").load()
    assert {r["key"]["hash"] for r in states.collect()} <= {"a", "d"}


# --- incremental counts ------------------------------------------------------------------------------------------

def test_incremental_counts_equal_the_whole_log(spark, make, tmp_path, monkeypatch):
    rng = random.Random(12)
    monkeypatch.setattr(incremental, "MERGED", 2)
    kept = incremental.ContentIndex(spark, str(tmp_path / "index"), buckets=8)
    assert kept.group_counts().count() == 0 and kept.state().count() == 0 and kept.stats().count() == 0
    whole, numbers = None, rng.sample(range(1, 1000), 160)
    for batch in range(1, 5):
        entries = [{"path": f"p{rng.randrange(30)}", "hash": rng.choice(["a", "b", "c", "", None]), "size": rng.randrange(2), "seq": numbers.pop(), "missing": rng.random() < 0.3} for _ in range(40)]
        part = make(*entries[:30], repo="r").unionByName(make(*entries[30:], repo="s"))
        assert kept.apply(batch, part) and not kept.apply(batch, part)
        whole = part if whole is None else whole.unionByName(part)
        state = index.latest(whole)
        assert rows(kept.state(), "repo", "path", "seq", "missing") == rows(state, "repo", "path", "seq", "missing")
        expected = exact.exact_groups(state).groupBy("hash", "size").agg(F.count("*").alias("copies"))
        assert rows(kept.group_counts(), "hash", "size", "copies") == rows(expected, "hash", "size", "copies")
        assert rows(kept.groups(), "repo", "path", "copies") == rows(exact.exact_groups(state), "repo", "path", "copies")
        assert rows(kept.stats(), "repo", "counter", "value") == rows(index.index_stats(whole), "repo", "counter", "value")


def test_a_batch_touches_only_its_buckets(spark, make, tmp_path, monkeypatch):
    kept = incremental.ContentIndex(spark, str(tmp_path / "index"), buckets=50)
    kept.apply(1, make(*[{"path": f"p{i}", "hash": "h", "size": i % 3, "seq": i} for i in range(500)]))
    before = kept.versions.current()[1]["generations"]
    read = []
    plain = incremental.ContentIndex._read_state
    monkeypatch.setattr(incremental.ContentIndex, "_read_state", lambda self, generations: read.append(generations) or plain(self, generations))
    kept.apply(2, make({"path": "p3", "hash": "other", "size": 1, "seq": 900}))
    after = kept.versions.current()[1]["generations"]
    assert len(before) == 50 and len(read[0]) == 1 and sum(before[b] != after[b] for b in before) == 1
    assert rows(kept.group_counts(), "hash", "size", "copies") == [("h", 0, 166), ("h", 1, 167), ("h", 2, 166)]


def test_two_writers_apply_both_batches(spark, make, tmp_path, monkeypatch):
    kept = incremental.ContentIndex(spark, str(tmp_path / "index"), buckets=4)
    commit, others = Versions.commit, [make({"path": "a", "hash": "h", "size": 1, "seq": 1})]

    def late(self, number, content):
        if others:
            incremental.ContentIndex(spark, str(tmp_path / "index")).apply(1, others.pop())
        commit(self, number, content)

    monkeypatch.setattr(Versions, "commit", late)
    assert kept.apply(2, make({"path": "b", "hash": "h", "size": 1, "seq": 2}))
    assert rows(kept.group_counts(), "hash", "size", "copies") == [("h", 1, 2)]


# --- reconciliation ----------------------------------------------------------------------------------------------

@pytest.mark.parametrize("changed, read", [(0, False), (6, False), (400, True)])
def test_only_buckets_that_differ_are_read(spark, make, tmp_path, changed, read):
    """Few differences are decoded from the sketches alone; where they are many, their buckets are read."""
    rng = random.Random(changed)
    entries = [{"path": f"p{i}", "hash": f"h{i // 2}", "size": i % 4, "missing": i % 11 == 0} for i in range(900)]
    other = [dict(e) for e in entries]
    for i in rng.sample(range(900), changed):
        kind = i % 3
        if kind == 0:
            other[i]["hash"] = f"new{i}"
        elif kind == 1:
            other[i]["missing"] = not other[i]["missing"]
        else:
            entries[i]["hash"] = f"own{i}"
    a, b = checkpointed(make(*entries, repo="a")), checkpointed(make(*other, repo="b"))
    stored = [reconcile.store_contents(part, str(tmp_path / name), 8) for name, part in (("a", a), ("b", b))]
    status, looked = reconcile.reconciled_status(a, *stored)
    assert rows(status, "path", "status") == rows(diff.diff_status(a, b), "path", "status")
    assert looked["buckets"] == 8 and (looked["differing"] == 0) == (changed == 0)
    assert (looked["read"] > 0) == read and looked["read_buckets"] <= looked["differing"]
    found, _ = reconcile.differences(*stored)
    keys = {side: {(r["k1"], r["k2"]) for r in c.contents().collect()} for side, c in zip((1, -1), stored)}
    got = {side: {(r["k1"], r["k2"]) for r in found.filter(F.col("side") == side).collect()} for side in (1, -1)}
    assert got == {1: keys[1] - keys[-1], -1: keys[-1] - keys[1]}


def test_reconciling_empty_indexes(spark, make, tmp_path):
    a = make({"path": "p", "hash": "h", "size": 1}, {"path": "q", "hash": "h", "size": 1}, repo="a")
    stored = [reconcile.store_contents(part, str(tmp_path / n), 4) for n, part in (("a", a), ("none", a.filter("false")))]
    assert rows(reconcile.reconciled_status(a, *stored)[0], "path", "status") == [("p", "new"), ("q", "new")]
    assert reconcile.reconciled_status(a.filter("false"), *stored[::-1])[0].count() == 0


# --- formats -----------------------------------------------------------------------------------------------------

def test_scan_format_equals_the_scan(spark, tmp_path):
    formats.register(spark)
    for name in ("a/b/c/1", "a/b/2", "a/3", "d/4", "5", ".hidden/_6"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    os.symlink(tmp_path / "a", tmp_path / "link")
    os.symlink(tmp_path / "5", tmp_path / "d" / "link")
    columns = ("kind", "path", "size", "last_modified")
    expected = rows(scan.scan_files(spark, str(tmp_path)).filter("path != ''"), *columns)
    for tasks in (1, 2, 64):
        found = spark.read.format(formats.SCAN).option("path", str(tmp_path)).option("tasks", tasks).load()
        assert rows(found, *columns) == expected
    twice = found.filter("kind = 'file'").unionByName(found.filter("path LIKE 'a/%'"))
    assert twice.count() == 6 + 5  # filters of one place stay out of the other
    found = spark.read.format(formats.SCAN).option("path", str(tmp_path)).option("push", "true").load()
    below = found.filter("path LIKE 'a/b/%' AND kind = 'file' AND size > 3")
    assert rows(below, "path") == [("a/b/2",), ("a/b/c/1",)]
    found = spark.read.format(formats.SCAN).option("path", str(tmp_path)).option("push", "true").load()
    assert rows(found.filter("path = 'd/4'"), "path") == [("d/4",)]
    reader = formats.ScanReader(str(tmp_path), 64, True)
    left = list(reader.pushFilters([formats.EqualTo(("kind",), "file"), formats.StringStartsWith(("path",), "a/b/")]))
    listed = [d for p in reader.partitions() for d in p.flat + p.deep]
    assert left == [] and sorted(listed) == ["", "a", "a/b", "a/b/c"]
    with pytest.raises(Exception, match="nowhere"):
        spark.read.format(formats.SCAN).option("path", str(tmp_path / "nowhere")).load().count()


def test_log_format_goes_on_where_it_ended(spark, tmp_path):
    formats.register(spark)
    folder, out = tmp_path / "log", str(tmp_path / "out")
    (folder / "sub").mkdir(parents=True)
    one, two = folder / "one.json", folder / "sub" / "two.json"

    def run():
        stream = spark.readStream.format(formats.LOG).option("path", str(folder)).option("span", 50).load()
        writer = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True)
        writer.start(out).awaitTermination()
        return rows(spark.read.parquet(out), "shard", "position", "hash", "corrupt")

    first = ['{"h":"a","p":"x","s":1,"l":5}\n', '{"h":"broken\n', '{"h":"b","p":"é","s":2,"d":true,"is":{"width":3,"height":4},"at":{"k":"v"}}\n']
    one.write_text("".join(first) + '{"h":"wai')
    (folder / "other.txt").write_text("no log")
    expected = [("one.json", 0, "a", None), ("one.json", 30, None, '{"h":"broken'), ("one.json", 43, "b", None)]
    assert run() == expected
    with open(one, "a") as file:
        file.write('ting","p":"y"}\n\n{"h":5}\n[]\n')
    two.write_text('{"h":"c","p":"z"}\n' * 20)
    size = len("".join(first).encode())
    expected += [("one.json", size, "waiting", None), ("one.json", size + 25, None, '{"h":5}'), ("one.json", size + 33, None, "[]")]
    expected += [("sub/two.json", 18 * i, "c", None) for i in range(20)]
    assert run() == expected and run() == expected
    batch = spark.read.format(formats.LOG).option("path", str(folder)).load()
    assert rows(batch, "shard", "position", "hash", "corrupt") == expected
    record = batch.filter("hash = 'b'").first()
    assert (record["path"], record["missing"], record["image_size"]["height"], record["attributes"]) == ("é", True, 4, {"k": "v"})
