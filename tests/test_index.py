import gzip
import json

import pytest
from conftest import rows
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from twinfinder.operators import diff, exact, files, filters, index
from twinfinder.schema import JSON_KEYS
from twinfinder.sources import catalog, log as logs
from twinfinder.sources.versions import Conflict, Versions
from twinfinder.sources.table import from_table


# --- filters -----------------------------------------------------------------------------------------------------

FILTER_ROWS = [
    {"path": "pics/cat.png", "size": 100, "mime": "image/png"},
    {"path": "docs/a.txt", "size": 5, "mime": "text/plain"},
    {"path": "big", "size": 10_000, "mime": None},
]


@pytest.mark.parametrize(
    "expression, found",
    [
        (None, 3), ("", 3), ("  ", 3), ("what:x", 0), ("MIME:image", 0), (" mime:image", 0), ("mime: image ", 1),
        ("mime:IMAGE", 0), ("mime:", 3), ("name:cat", 1), ("name:pics/", 1), ("name:CAT", 0),
        ("size:5", 1), ("size:=5", 1), ("size: = 10000", 1), ("size:>=100", 2), ("size:<=100", 2), ("size:>100", 1),
        ("size:<100", 1), ("size:+5", 1), ("size:abc", 0), ("size:", 0), ("size:>", 0), ("size:1_0", 0),
        ("size:<99999999999999999999", 0), ("size:<9223372036854775807", 3), ("size:>-1", 3),
    ],
)
def test_filter(make, expression, found):
    assert make(*FILTER_ROWS).filter(filters.parse_filter(expression)).count() == found


@pytest.mark.parametrize(
    "width, height, found",
    [(None, None, ["a", "b", "c"]), (">=100", None, ["a"]), ("100", "=50", ["a"]), ("<100", ">0", ["b"]), ("x", None, []),
     ("", None, []), (None, "<99999999999", [])],
)
def test_dimension_filter(make, width, height, found):
    df = make(
        {"path": "a", "image_size": (100, 50)}, {"path": "b", "image_size": (99, 50)}, {"path": "c"}
    )
    assert [r[0] for r in rows(df.filter(filters.dim_filter(width, height)), "path")] == found


def test_valid_name(spark):
    df = spark.createDataFrame([("abc_1",), ("größe",), ("a-b",), ("",), ("a b",)], "n string")
    assert [r[0] for r in df.select(filters.valid_name("n")).collect()] == [True, True, False, False, False]


# --- log state ---------------------------------------------------------------------------------------------------

def test_last_record_wins(make):
    log = make({"path": "p1", "hash": "h1", "size": 10}, {"path": "p1", "hash": "h1-new", "size": 15})
    state = index.latest(log)
    assert rows(state, "hash", "size") == [("h1-new", 15)]
    assert index.lookup_hash(state, "h1").count() == 0
    assert index.lookup_hash(state, "h1-new").count() == 1
    assert index.lookup_hash(state, "h1-new", 10).count() == 0


def test_latest_is_idempotent_and_order_free(make, spark):
    log = make(*[{"path": f"p{i % 7}", "hash": f"h{i}", "missing": i % 3 == 0} for i in range(60)])
    once = rows(index.latest(log), "path", "hash", "missing")
    assert rows(index.latest(index.latest(log)), "path", "hash", "missing") == once
    assert rows(index.latest(log.orderBy(F.rand(3)).repartition(5)), "path", "hash", "missing") == once


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("abc"), st.integers(0, 3), st.booleans()), min_size=1, max_size=12))
def test_latest_and_stats_against_loop(make, entries):
    log = make(*[{"path": p, "hash": f"h{h}", "size": h, "missing": d} for p, h, d in entries])
    state = {}
    for p, h, d in entries:
        state[p] = (h, d)
    assert rows(index.latest(log), "path", "hash", "missing") == sorted((p, f"h{h}", d) for p, (h, d) in state.items())
    live = [h for h, d in state.values() if not d]
    expected = {
        "Lines": len(entries), "Changes": len(entries) - len(state), "files": len(live),
        "missing": len(state) - len(live), "duplicates": len(live) - len(set(live)),
    }
    assert dict(rows(index.index_stats(log), "counter", "value")) == expected


def test_duplicates_are_counted_per_bucket(make):
    log = make(
        {"path": "a", "hash": "common", "size": 10}, {"path": "b", "hash": "common", "size": 10},
        {"path": "c", "hash": "common", "size": 11},
    )
    assert dict(rows(index.index_stats(log), "counter", "value"))["duplicates"] == 1
    assert dict(rows(index.index_stats(log, buckets=1), "counter", "value"))["duplicates"] == 2


def test_lookup_path_prefers_newest(make):
    state = make(
        {"path": "p", "hash": "old", "last_modified": 5}, {"path": "p", "hash": "new", "last_modified": 9, "missing": True},
        {"path": "p", "hash": "mid", "last_modified": 7}, {"path": "q", "last_modified": 99},
    )
    assert rows(index.lookup_path(state, "p"), "hash", "missing") == [("new", True)]
    assert index.lookup_path(state, "zzz").count() == 0


def test_prune(make):
    log = make({"path": "a", "size": 7}, {"path": "b", "size": 8}, {"path": "b", "size": 8, "missing": True})
    assert rows(index.prune(log, 5), "path", "bucket") == [("a", 2)]
    assert rows(index.prune(log, 5, keep_deleted=True), "path", "bucket", "missing") == [("a", 2, False), ("b", 3, True)]


def test_merge_stats(spark):
    a = spark.createDataFrame([("files", 2), ("added", 1)], "counter string, value bigint")
    b = spark.createDataFrame([("files", 3)], "counter string, value bigint")
    assert [tuple(r) for r in index.merge_stats(a, b).collect()] == [("added", 1), ("files", 5)]


def test_from_table(spark):
    df = spark.createDataFrame([(1, "abc"), (2, "x" * 30)], "id bigint, t string")
    got = from_table(df, F.col("id").cast("string"), "t", F.col("id") * 1000)
    assert rows(got, "path", "hash", "size", "last_modified", "missing")[0] == ("1", "616263", 3, 1000, False)


# --- stored logs -------------------------------------------------------------------------------------------------

def test_json_log_with_corrupt_lines(spark, tmp_path):
    lines = [
        json.dumps({"h": "h1", "p": "p1", "s": 10, "l": 1}),
        '{"h": "trunc',
        json.dumps({"p": "nohash"}),
        json.dumps({"h": "h2", "p": "p1", "s": 15, "l": 2, "d": True, "is": {"width": 3, "height": 4}, "at": {"a": "b"}}),
    ]
    path = tmp_path / "0.json"
    path.write_text("\n".join(lines) + "\n")
    good, bad = logs.quarantine(logs.read_json_log(spark, str(path), "r"))
    assert rows(good, "seq", "hash", "path", "size", "missing", "mime") == [
        (0, "h1", "p1", 10, False, ""), (3, "h2", "p1", 15, True, "")
    ]
    assert bad.count() == 2
    assert rows(index.latest(good), "hash") == [("h2",)]
    assert good.filter("seq = 3").select("image_size.width", "attributes").first()[:] == (3, {"a": "b"})


def test_json_log_keeps_order_over_splits(spark, tmp_path):
    path = tmp_path / "log.json"
    path.write_text("".join(json.dumps({"h": f"h{i}", "p": f"p{i % 10}"}) + "\n" for i in range(3000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        lines = logs.read_json_log(spark, str(path), "r")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert lines.rdd.getNumPartitions() >= 1
    assert rows(lines, "seq", "hash") == [(i, f"h{i}") for i in range(3000)]


def test_gzip_members_are_one_log(spark, tmp_path):
    path = tmp_path / "0.json.gz"
    with open(path, "wb") as f:
        for part in ({"h": "a", "p": "x"}, {"h": "b", "p": "x"}):
            f.write(gzip.compress((json.dumps(part) + "\n").encode()))
    assert rows(logs.read_log(spark, str(path), "json"), "seq", "hash") == [(0, "a"), (1, "b")]


def test_path_in_two_shards(spark, tmp_path):
    (tmp_path / "0.json").write_text(json.dumps({"h": "new", "p": "x", "s": 10, "l": 9}) + "\n")
    (tmp_path / "1.json").write_text(
        json.dumps({"h": "older", "p": "x", "s": 11, "l": 20}) + "\n" + json.dumps({"h": "old", "p": "x", "s": 11, "l": 5}) + "\n"
    )
    log = logs.read_log(spark, str(tmp_path), "json")
    assert rows(index.latest(log, shard="shard"), "hash") == [("new",)]


def test_write_json_log(spark, make, tmp_path):
    df = make({"path": "p", "hash": "h", "size": 3, "last_modified": 1, "attributes": {"a": "b"}}, {"path": "q", "missing": True})
    logs.write_json_log(df.coalesce(1), str(tmp_path / "out"), compress=True)
    back = logs.read_json_log(spark, str(tmp_path / "out"), "r")
    raw = spark.read.text(str(tmp_path / "out")).collect()
    assert json.loads(raw[0][0]) == {"h": "h", "p": "p", "s": 3, "l": 1, "at": {"a": "b"}} and set(JSON_KEYS) >= {"h", "at"}
    assert '"m"' not in raw[0][0] and '"d"' not in raw[0][0]
    assert back.count() == 2


def test_parquet_log_and_prune(spark, make, tmp_path):
    path = str(tmp_path / "log")
    logs.append_log(make({"path": "a", "hash": "1", "size": 1, "seq": 1}, {"path": "b", "hash": "2", "size": 2, "seq": 2}), path)
    logs.append_log(make({"path": "a", "hash": "3", "size": 12, "seq": 3}, {"path": "b", "missing": True, "seq": 4}), path)
    assert index.index_stats(logs.read_log(spark, path).drop("bucket")).filter("counter = 'Lines'").first()["value"] == 4
    assert logs.prune_log(spark, path, buckets=3) == {"files": 1, "failed": 0}
    assert rows(logs.read_log(spark, path), "path", "hash", "bucket") == [("a", "3", 0)]
    with pytest.raises(ValueError):
        logs.read_log(spark, path, "yaml")


def test_writers_never_share_numbers_or_lose_parts(spark, make, tmp_path, monkeypatch):
    path = str(tmp_path / "log")
    numbered = [F.col("path").asc()]
    assert logs.append_log(make({"path": "b", "size": 1}, {"path": "a", "size": 2}), path, order=numbered) == {"rows": 2, "last_seq": 2}
    commit, others = Versions.commit, [make({"path": "c", "size": 3}), make({"path": "d", "size": 4})]

    def late(self, number, content):
        """Somebody else appends between the reading and the writing of the state."""
        if others:
            logs.append_log(others.pop(), path, order=numbered)
        commit(self, number, content)

    monkeypatch.setattr(Versions, "commit", late)
    assert logs.append_log(make({"path": "e", "size": 5}), path, order=numbered)["last_seq"] == 5
    assert rows(logs.read_log(spark, path), "seq", "path")[:2] == [(1, "a"), (2, "b")]
    found = rows(logs.read_log(spark, path), "seq", "path")
    assert [s for s, _ in found] == [1, 2, 3, 4, 5] and sorted(p for _, p in found) == list("abcde")
    # Pruning keeps what is appended while it runs.
    others.append(make({"path": "late", "size": 6}))
    assert logs.prune_log(spark, path, buckets=2) == {"files": 5, "failed": 0}
    assert [p for _, p in rows(logs.read_log(spark, path), "seq", "path")][-1] == "late"
    assert logs.read_log(spark, path).count() == 6
    assert len(logs.clean_log(spark, path)) == 4 and logs.read_log(spark, path).count() == 6
    versions = Versions(spark, path)
    with pytest.raises(Conflict):
        commit(versions, versions.current()[0] - 1, {})


def test_repair_loses_no_line_whenever_it_fails(spark, make, tmp_path, monkeypatch):
    source, path = tmp_path / "json", str(tmp_path / "log")
    source.mkdir()
    lines = [json.dumps({"h": f"h{i}", "p": f"p{i % 40}", "s": i, "l": i}) for i in range(100)]
    lines[10], lines[55], lines[99] = lines[10][:9], "what", json.dumps({"p": "nohash"})
    (source / "0.json").write_text("\n".join(lines[:60]) + "\n")
    (source / "1.json").write_text("\n".join(lines[60:]) + "\n")
    logs.append_log(make({"path": "before", "hash": "x", "size": 1, "seq": 7}), path)
    with pytest.warns(UserWarning, match="3 undecodable lines"):
        assert logs.read_log(spark, str(source), "json").count() == 97

    class Crash(RuntimeError):
        pass

    def crash(*args):
        raise Crash

    for owner, step in ((logs, "_write_part"), (logs, "_empty"), (Versions, "commit")):
        with monkeypatch.context() as patch:
            patch.setattr(owner, step, crash)
            with pytest.raises(Crash):
                logs.repair_log(spark, str(source), path, "r")
        assert rows(logs.read_log(spark, path), "path") == [("before",)] and logs.bad_lines(spark, path).count() == 0
    assert logs.repair_log(spark, str(source), path, "r") == {"good": 97, "bad": 3}
    assert sorted(t for t in (r["text"] for r in logs.bad_lines(spark, path).collect()) if t) == sorted([lines[10], "what"])
    assert rows(logs.bad_lines(spark, path), "line") == [(10,), (39,), (55,)]
    log = logs.read_log(spark, path)
    assert log.count() == 98 and log.agg(F.min("seq"), F.max("seq")).first()[:] == (7, 104)
    imported = logs.quarantine(logs.read_json_log(spark, str(source), "r"))[0]
    assert rows(index.latest(log).filter("repo = 'r'").filter("path != 'before'"), "path", "hash") == rows(index.latest(imported, "shard"), "path", "hash")
    assert len(list(source.iterdir())) == 2


def test_log_without_states_is_taken_over(spark, make, tmp_path):
    path = str(tmp_path / "log")
    make({"path": "a", "hash": "1", "size": 1, "seq": 5}).withColumn("bucket", F.lit(1)).write.partitionBy("bucket").parquet(path)
    assert rows(logs.read_log(spark, path), "path", "bucket") == [("a", 1)]
    assert logs.append_log(make({"path": "b", "size": 2}), path, order=[F.col("path")])["last_seq"] == 6
    assert rows(logs.read_log(spark, path), "seq", "path") == [(5, "a"), (6, "b")]
    logs.prune_log(spark, path)
    logs.clean_log(spark, path)
    assert rows(logs.read_log(spark, path), "seq", "path") == [(5, "a"), (6, "b")]
    assert logs.append_log(make({"path": "c"}).filter("false"), path) == {"rows": 0, "last_seq": 6}
    assert logs.prune_log(spark, str(tmp_path / "nothing")) == {"files": 0, "failed": 0}


# --- catalog -----------------------------------------------------------------------------------------------------

def test_catalog(spark, make):
    db = "twin_test"
    catalog.create_repo(spark, "alpha", "/a", 4, database=db)
    catalog.create_repo(spark, "Größe", "/g", database=db, codec="json")
    for bad in ("a-b", "", "a b"):
        with pytest.raises(ValueError):
            catalog.create_repo(spark, bad, "/x", database=db)
    with pytest.raises(ValueError):
        catalog.create_repo(spark, "alpha", "/x", database=db)
    catalog.append_records(spark, "alpha", make({"path": "x", "hash": "h", "size": 6}), db)
    catalog.append_records(spark, "Größe", make({"path": "y", "hash": "h", "size": 6}), db)
    assert rows(catalog.list_repos(spark, True, db), "name", "path", "buckets", "codec") == [
        ("Größe", "/g", 10, "json"), ("alpha", "/a", 4, "parquet")
    ]
    assert rows(catalog.open_repos(spark, database=db), "repo", "path") == [("Größe", "y"), ("alpha", "x")]
    with pytest.raises(LookupError):
        catalog.open_repos(spark, ["alpha", "nope"], database=db)
    assert catalog.open_repos(spark, ["alpha", "nope"], skip_unknown=True, database=db).count() == 1

    catalog.copy_repo(spark, "alpha", "beta", "/b", db)
    with pytest.raises(ValueError):
        catalog.copy_repo(spark, "alpha", "alpha", "/b", db)
    assert rows(catalog.read_repo(spark, "beta", db), "repo", "path") == [("beta", "x")]
    assert not catalog.rename_repo(spark, "beta", "beta", db)
    assert not catalog.rename_repo(spark, "nope", "other", db)
    assert catalog.rename_repo(spark, "beta", "gamma", db)
    catalog.relocate_repo(spark, "gamma", "/c", db)
    assert catalog.repo_path(spark, "gamma", db) == "/c"
    catalog.configure_repo(spark, "gamma", codec="json", compressed=True, database=db)
    found = catalog.list_repos(spark, True, db).filter("name = 'gamma'").first()
    assert (found["path"], found["buckets"], found["codec"], found["compressed"]) == ("/c", 4, "json", True)
    assert rows(catalog.read_repo(spark, "gamma", db), "path", "hash") == [("x", "h")]
    catalog.append_records(spark, "gamma", make({"path": "x", "missing": True, "seq": 9}), db)
    assert catalog.prune_repo(spark, "gamma", 2, keep_deleted=True, database=db) == 1
    assert catalog.prune_repo(spark, "gamma", 2, database=db) == 0
    assert catalog.drop_repo(spark, "gamma", db) and not catalog.drop_repo(spark, "gamma", db)


# --- file lists --------------------------------------------------------------------------------------------------

def test_files_ls_and_plans(make):
    state = make(
        {"path": "b/x.txt", "size": 1, "mime": "text/plain"}, {"path": "root.md", "size": 2, "mime": "text/md"},
        {"path": "a/y", "size": 3, "missing": True, "mime": "zzz"}, {"path": "a/x.txt", "size": 4, "mime": "text/plain"},
    )
    listed = [tuple(r)[:3] for r in files.files_ls(state).collect()]
    assert listed == [("a", "x.txt", 4), ("b", "x.txt", 1), ("", "root.md", 2)]
    assert [r[0] for r in files.mime_types(state).collect()] == ["text/md", "text/plain"]
    assert rows(files.files_rm_plan(state, filters.parse_filter("size:<3")), "action", "path") == [
        ("delete", "b/x.txt"), ("delete", "root.md")
    ]
    assert rows(files.files_cp_plan(state, "/t", "bak"), "action", "target") == [
        ("copy", "/t/a/x.bak"), ("copy", "/t/b/x.bak"), ("copy", "/t/root.bak")
    ]
    clash = make({"path": "d/x.a"}, {"path": "d/x.b"})
    assert rows(files.files_mv_plan(clash, "/t", "c"), "action", "path") == [("conflict", "d/x.b"), ("move", "d/x.a")]


def test_stored_states_need_no_exchange_of_contents(spark, make):
    database = "twinfinder_states"
    spark.sql(f"DROP DATABASE IF EXISTS {database} CASCADE")
    first = make(*[{"path": f"p{i}", "hash": f"h{i % 7}", "size": i % 3} for i in range(60)], {"path": "v", "hash": "x", "size": 1, "video_hash": "fallback:1"},
                 {"path": "w", "hash": "y", "size": 1, "video_hash": "fallback:1"}, repo="first")
    second = make(*[{"path": f"q{i}", "hash": f"h{i % 11}", "size": i % 3} for i in range(40)], repo="second")
    for name, part in (("first", first), ("second", second)):
        catalog.create_repo(spark, name, f"/data/{name}", database=database)
        catalog.append_records(spark, name, part, database)
    catalog.store_states(spark, ["first", "second"], buckets=4, database=database)
    both = catalog.read_states(spark, ["first", "second"], database)

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        groups = exact.stored_groups(both)
        status = diff.diff_status(*(catalog.read_states(spark, [n], database) for n in ("first", "second")))
        for df in (groups, status):
            assert "hashpartitioning(hash" not in plan(df) and "Bucketed: true" in plan(df)
        assert plan(groups).count("Exchange") == 1  # of the fallback rows
        assert "Exchange" not in plan(status)
        whole = first.unionByName(second)
        columns = ("kind", "group_key", "copies", "repo", "path")
        assert rows(groups, *columns) == rows(exact.exact_groups(whole), *columns)
        assert rows(status, "path", "status", "match") == rows(diff.diff_status(first, second), "path", "status", "match")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # A grown log is compacted again when its state is read; other repos stay.
    catalog.append_records(spark, "first", make({"path": "p1", "seq": 99, "missing": True}, {"path": "new", "seq": 100, "hash": "h1", "size": 1}), database)
    again = catalog.read_states(spark, ["first"], database)
    assert again.count() == 63 and rows(again.filter("missing"), "path") == [("p1",)]
    assert catalog.read_states(spark, ["second"], database).count() == 40
    assert catalog.drop_repo(spark, "first", database)
    assert rows(spark.table(f"{database}.{catalog.STATES}").select("repo").distinct(), "repo") == [("second",)]
    spark.sql(f"DROP DATABASE {database} CASCADE")


def test_a_failed_exchange_is_finished_by_the_next_reader(spark, make, monkeypatch):
    database = "twinfinder_exchange"
    spark.sql(f"DROP DATABASE IF EXISTS {database} CASCADE")
    for name in ("plain", "Größe"):
        catalog.create_repo(spark, name, f"/{name}", database=database)
        catalog.append_records(spark, name, make({"path": "a", "hash": "1", "size": 1, "seq": 1}, {"path": "a", "hash": "2", "size": 2, "seq": 2}), database)

    class Crash(RuntimeError):
        pass

    def crash(*args):
        raise Crash

    for name in ("plain", "Größe"):
        with monkeypatch.context() as patch:
            patch.setattr(catalog, "_take_place", crash)
            with pytest.raises(Crash):
                catalog.prune_repo(spark, name, database=database)
    assert rows(catalog.list_repos(spark, database=database), "name", "path") == [("Größe", "/Größe"), ("plain", "/plain")]
    for name in ("plain", "Größe"):
        assert rows(catalog.read_repo(spark, name, database), "repo", "hash") == [(name, "2")]
    # A table that cannot be read does not hide the others.
    spark.sql(f"CREATE TABLE {database}.broken (a int) USING parquet")
    catalog._set(spark, f"{database}.broken", name="broken", path="/", buckets=1)
    plain = catalog._properties

    def broken(session, table):
        if "broken" in table:
            raise catalog.AnalysisException("no")
        return plain(session, table)

    monkeypatch.setattr(catalog, "_properties", broken)
    with pytest.warns(UserWarning, match="broken cannot be read"):
        assert catalog.list_repos(spark, database=database).count() == 2
    monkeypatch.undo()
    spark.sql(f"DROP DATABASE {database} CASCADE")


def test_checkpoints_of_a_cluster_need_a_shared_folder():
    from twinfinder.session import is_local_folder
    assert is_local_folder("/tmp/x") and is_local_folder("file:/tmp/x") and not is_local_folder("hdfs://host/x")
