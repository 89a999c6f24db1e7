"""What must never be deleted, lost or overwritten."""

import os

from pyspark.sql import functions as F

from conftest import rows
from twinfinder.operators import diff, exact, index, rank, update, verified
from twinfinder.plans.skew import find_hot_keys
from twinfinder.session import checkpointed
from twinfinder.sources import log as logs
from twinfinder.sources.table import from_table


def test_unreadable_files_are_no_duplicates(spark, make):
    state = make({"path": "a", "size": 5000}, {"path": "b", "size": 5000}, {"path": "c", "size": 5, "hash": "x"},
                 {"path": "d", "size": 5, "hash": "x"})
    groups = exact.exact_groups(state)
    assert rows(groups, "path") == [("c",), ("d",)]
    assert {r[0] for r in rows(rank.removal_plan(groups), "path")} <= {"c", "d"}


def test_enrich_leaves_unreadable_files_out(spark):
    files = spark.createDataFrame(
        [("a", 3, 1, "", bytearray(b"abc"), None, "h"), ("b", 3, 1, "", None, "denied", None)],
        "path string, size long, last_modified long, mime string, content binary, message string, hash string",
    )
    read = update.enrich(files.drop("hash").filter("content is not null"))
    assert rows(read, "path") == [("a",)]
    assert rows(update.unreadable(files), "path") == [("b",)]
    assert rows(update.enrich(files.withColumns({"fallback_hash": F.lit(None).cast("string"), "audio_hash": F.lit(None).cast("string")})), "path") == [("a",)]


def test_empty_files_survive_a_json_log(spark, make, tmp_path):
    logs.write_json_log(make({"path": "empty", "size": 0, "hash": ""}, {"path": "x", "size": 1, "hash": "31"}), f"{tmp_path}/log")
    assert rows(logs.read_log(spark, f"{tmp_path}/log", "json"), "path", "hash") == [("empty", ""), ("x", "31")]


def test_a_directory_fails_in_one_repo_only(spark, make):
    state = make({"path": "d/x", "hash": "1", "size": 1}, repo="a").unionByName(
        make({"path": "d/x", "hash": "2", "size": 1}, repo="b"))
    none = state.filter("false").select("repo", "path")
    failed = spark.createDataFrame([("a", "d")], "repo string, path string")
    gone = update.tombstones(state, none, ["repo", "path"], failed)
    assert rows(gone, "repo", "path") == [("b", "d/x")]


def test_two_repos_never_copy_to_one_target(make):
    source = make({"path": "p", "hash": "1", "size": 1}, repo="a").unionByName(
        make({"path": "p", "hash": "2", "size": 2}, {"path": "q", "hash": "2", "size": 2}, repo="b"))
    target = make({"path": "z", "hash": "9", "size": 9}, repo="t")
    plan = diff.sync_plan(source, target)
    assert rows(plan.filter("action = 'copy'"), "repo", "path") == [("a", "p"), ("b", "q")]
    assert rows(plan.filter("action = 'skip'"), "repo", "path") == [("b", "p")]


def test_lookup_path_keeps_repos_apart(make):
    state = make({"path": "p", "hash": "1", "size": 1}, repo="a").unionByName(
        make({"path": "p", "hash": "2", "size": 1}, repo="b"))
    assert rows(index.lookup_path(state, "p"), "repo", "hash") == [("a", "1"), ("b", "2")]


def test_all_hot_keys_are_found(spark):
    df = spark.range(4000).select((F.col("id") % 1500).alias("k"))
    assert len(find_hot_keys(df, ["k"], rows_per_task=1, sample=1).slices) == 1500


def test_update_repo_over_two_scans(spark, make, tmp_path):
    root = tmp_path / "root"
    (root / "sub").mkdir(parents=True)
    for name, data in {"same": b"1", "changed": b"old", "gone": b"g", "sub/back": b"b", "picture.png": b"\x89PNG\r\n\x1a\n"}.items():
        (root / name).write_bytes(data)
    empty = make({"path": "other", "hash": "9", "size": 1}, repo="another")
    first, counts, problems = update.update_repo(spark, str(root), empty, "r")
    assert dict(rows(counts, "counter", "value")) == {"added": 5} and problems.count() == 0
    log = checkpointed(empty.unionByName(first))
    assert rows(index.latest(log).filter("repo = 'r'"), "path", "hash")[0] == ("changed", b"old".hex())

    log = checkpointed(log.unionByName(first.filter("path = 'sub/back'").withColumns({"missing": F.lit(True), "seq": F.col("seq") + 1})))
    (root / "changed").write_bytes(b"newer")
    (root / "gone").unlink()
    (root / "sub" / "new").write_bytes(b"n")
    with open(os.fsencode(str(root)) + b"/\xff\xfe", "wb") as file:
        file.write(b"x")
    second, counts, problems = update.update_repo(
        spark, str(root), log, "r", lambda files: files.withColumn("image_fingerprint", F.lit("f" * 16)))
    assert rows(second, "path", "missing", "hash") == [
        ("changed", False, b"newer".hex()), ("gone", True, "67"), ("picture.png", False, b"\x89PNG\r\n\x1a\n".hex()),
        ("sub/back", False, "62"), ("sub/new", False, "6e")]
    assert dict(rows(counts, "counter", "value")) == {"added": 3, "deleted": 1, "unchanged": 2}
    assert rows(problems, "path", "message") == [("??", "UnicodeEncodeError")]
    state = index.latest(log.unionByName(second))
    assert rows(index.live(state).filter("repo = 'r'"), "path") == [("changed",), ("picture.png",), ("same",), ("sub/back",), ("sub/new",)]
    assert rows(state.filter("repo = 'another'"), "path", "missing") == [("other", False)]


def test_changes_below_failed_directories_are_unknown(spark, make):
    state = make({"path": "d/x", "size": 1}, {"path": "e", "size": 1}, {"path": "f", "size": 1})
    failed = spark.createDataFrame([("d",), ("f",)], "path string")
    listing = state.filter("false").select("path", "size", "last_modified")
    changes = update.classify_changes(listing, state, failed=failed)
    assert rows(changes, "path", "status") == [("e", "deleted")]
    assert rows(update.tombstones(state, listing, failed=failed), "path") == [("e",)]


def test_only_what_was_done_is_logged(spark, make):
    state = make({"path": "a", "hash": "1", "size": 1}, {"path": "b", "hash": "1", "size": 1}, {"path": "c", "hash": "1", "size": 1})
    result = "action string, repo string, path string, status string"
    done = spark.createDataFrame([("remove", "r", "b", "done"), ("remove", "r", "c", "error")], result)
    assert rows(rank.plan_records(state, done), "path", "missing") == [("b", True)]
    assert rows(index.live(index.latest(rank.apply_plan_to_log(state, state, done))), "path") == [("a",), ("c",)]
    target = make({"path": "z", "hash": "9", "size": 9}, repo="t")
    done = spark.createDataFrame([("copy", "r", "a", "done"), ("copy", "r", "b", "error"), ("delete", "t", "z", "skipped")], result)
    assert rows(diff.sync_records(state, target, done), "repo", "path", "missing") == [("t", "a", False)]


def scanned(spark, folder):
    """The files of a folder as records."""
    data = [(str(p.relative_to(folder)), p.read_bytes(), int(p.stat().st_mtime * 1000)) for p in sorted(folder.rglob("*")) if p.is_file()]
    table = spark.createDataFrame(data, "path string, content binary, at bigint")
    return from_table(table, path="path", content="content", mtime="at", repo=F.lit("r"))


def test_nothing_is_removed_without_its_survivor(spark, tmp_path):
    root = tmp_path / "root"
    root.mkdir()
    for name in "abcdefg":
        for copy in (1, 2, 3):
            (root / f"{name}{copy}").write_bytes(name.encode() * 40)
            os.utime(root / f"{name}{copy}", (copy, copy))
    groups = checkpointed(exact.exact_groups(scanned(spark, root)))
    claimed = checkpointed(verified.claims(groups))
    assert claimed.count() == 14 and rows(claimed.filter("path = 'a2'"), "keep_path", "size") == [("a1", 40)]
    roots = {"r": str(root)}
    assert {r["status"] for r in verified.apply_claims(claimed, roots).collect()} == {"planned"} and len(list(root.iterdir())) == 21
    (root / "b1").unlink()  # survivor vanished
    (root / "c1").write_bytes(b"x" * 40)  # survivor changed, same size
    (root / "d2").write_bytes(b"new")  # victim changed
    (root / "e2").unlink()  # victim gone already
    (root / "f1").unlink()
    os.symlink(root / "f2", root / "f1")  # the survivor is the victim itself
    done = verified.apply_claims(claimed, roots, dry_run=False, partitions=3)
    status = {r["path"]: (r["status"], r["message"]) for r in done.collect()}
    expected = {n: ("done", "") for n in ("a2", "a3", "d3", "e3", "g2", "g3")}
    expected |= {n: ("skipped", "the copy to keep is missing") for n in ("b2", "b3")}
    expected |= {n: ("skipped", "the copy to keep has another content") for n in ("c2", "c3")}
    expected |= {"d2": ("skipped", "the file has another size"), "e2": ("gone", "already removed"), "f2": ("skipped", "the file is the copy to keep")}
    assert {k: v for k, v in status.items() if k != "f3"} == expected
    left = {p.name for p in root.iterdir()}
    assert left >= {"a1", "b2", "b3", "c1", "c2", "c3", "d1", "d2", "e1", "f2", "g1"} and not left & {"a2", "a3", "d3", "e3", "g2", "g3"}
    again = {r["path"]: r["status"] for r in verified.apply_claims(claimed, roots, dry_run=False).collect()}
    assert set(again.values()) == {"gone", "skipped"} and {p.name for p in root.iterdir()} == left
    state = scanned(spark, root)
    log = rank.plan_records(groups, verified.results_for_log(done))
    assert {r["path"] for r in log.collect()} == {n for n, (s, _) in status.items() if s in ("done", "gone")}
    assert state.count() == len([p for p in root.iterdir()])


def test_claimed_moves_know_their_own_work(spark, make, tmp_path):
    root, out = tmp_path / "root", tmp_path / "out"
    root.mkdir()
    out.mkdir()
    for name in ("k", "m1", "m2", "m3"):
        (root / name).write_bytes(b"same content of all")
        os.utime(root / name, (1 + (name != "k"), 1 + (name != "k")))
    groups = checkpointed(exact.exact_groups(scanned(spark, root)))
    plan = rank.move_plan(groups, "bin")
    claimed = checkpointed(verified.claims(groups, plan))
    (out / "bin").mkdir()
    (out / "bin" / "m2").write_bytes(b"somebody else's")
    roots = {"r": str(root)}
    done = {r["path"]: (r["status"], r["message"]) for r in verified.apply_claims(claimed, roots, dry_run=False, target_root=str(out)).collect()}
    assert done == {"m1": ("done", ""), "m2": ("skipped", "target exists"), "m3": ("done", "")}
    (root / "m2").unlink()
    again = {r["path"]: (r["status"], r["message"]) for r in verified.apply_claims(claimed, roots, dry_run=False, target_root=str(out)).collect()}
    assert again == {"m1": ("gone", "already moved"), "m2": ("skipped", "the file is missing, its target has another size"), "m3": ("gone", "already moved")}
    assert (out / "bin" / "m1").read_bytes() == b"same content of all" and sorted(p.name for p in (out / "bin").iterdir()) == ["m1", "m2", "m3"]
