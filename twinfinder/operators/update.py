"""Change detection between a listing and the index, and what follows from it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from twinfinder.functions.hashing import (
    audio_chunk_hash,
    content_hash,
    fallback_hash,
    text_hash,
)
from twinfinder.operators.index import latest, live, next_seq
from twinfinder.plans.numbering import row_numbers
from twinfinder.plans.skew import HotKeys, find_hot_keys, skewed_join
from twinfinder.schema import normalise, records as file_records
from twinfinder.session import checkpointed
from twinfinder.sources.files import hash_files, scan_files

RATE_WINDOW = 1000
WARM_UP_MILLIS = 5000


def classify_changes(
    listing: DataFrame, state: DataFrame, keys: list[str] | None = None, failed: DataFrame | None = None
) -> DataFrame:
    """Compare files found with the current index, one row per path.

    `added`: not in the index. `changed`: other size or newer. `unchanged`: same size, not newer, live.
    `reappeared`: the same for a deleted entry. `deleted`: live in the index but not found. Deleted entries that
    were not found stay out, and so do those below the directories `failed(path)` or `failed(repo, path)`, of which
    nothing is known. Paths are unique on both sides, so the join cannot be skewed.
    """
    keys = keys or ["path"]
    found = listing.select(*keys, "size", "last_modified", F.lit(True).alias("_found"))
    held = state.select(
        *keys,
        F.col("hash").alias("old_hash"),
        F.col("size").alias("old_size"),
        F.col("last_modified").alias("old_modified"),
        F.col("missing").alias("old_missing"),
    )
    same = (F.col("size") == F.col("old_size")) & (F.col("last_modified") <= F.col("old_modified"))
    status = (
        F.when(F.col("_found").isNull(), F.when(~F.col("old_missing"), "deleted"))
        .when(F.col("old_missing").isNull(), "added")
        .when(~same, "changed")
        .when(F.col("old_missing"), "reappeared")
        .otherwise("unchanged")
    )
    joined = found.join(held, keys, "full_outer").withColumn("status", status)
    joined = joined.filter(F.col("status").isNotNull()).drop("_found")
    if failed is None:
        return joined
    lost = F.col("status") == "deleted"
    return joined.filter(~lost).unionByName(_below_failed(joined.filter(lost), failed))


def to_read(changes: DataFrame) -> DataFrame:
    """The rows whose content has to be read: everything else keeps the hash it has."""
    return changes.filter(F.col("status").isin("added", "changed"))


def reappeared(changes: DataFrame, state: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Records to log for entries that came back: the old record, live again."""
    back = changes.filter(F.col("status") == "reappeared").select(*(keys or ["path"]))
    return state.join(back, keys or ["path"], "left_semi").withColumn("missing", F.lit(False))


def _below_failed(rows: DataFrame, failed: DataFrame) -> DataFrame:
    """Rows that neither are nor lie under one of the paths in `failed(path)` or `failed(repo, path)`.

    An equi-join on themselves and their ancestors, within the same repo if `failed` has one. Every path has the root as an ancestor,
    which makes it a hot key.
    """
    of = [c for c in ("repo",) if c in failed.columns]
    pieces = F.split("path", "/")
    ancestors = F.transform(
        F.sequence(F.lit(0), F.size(pieces)), lambda n: F.concat_ws("/", F.slice(pieces, F.lit(1), n))
    )
    spread = rows.select(*of, "path", F.explode(ancestors).alias("_dir"))
    bad = failed.select(*of, F.col("path").alias("_dir")).distinct()
    under = skewed_join(spread, bad, [*of, "_dir"], "left_semi", ["path"]).select(*of, "path").distinct()
    return rows.join(under, [*of, "path"], "left_anti")


def tombstones(
    state: DataFrame, listing: DataFrame, keys: list[str] | None = None, failed: DataFrame | None = None
) -> DataFrame:
    """Deletion records for live entries that the listing lacks, except below directories that failed to list."""
    keys = keys or ["path"]
    gone = live(state).join(listing.select(*keys), keys, "left_anti")
    if failed is not None:
        gone = _below_failed(gone, failed)
    return gone.withColumn("missing", F.lit(True))


def check_scan(files: int, directories: int, errors: int) -> None:
    """Refuse to go on from a scan that failed at its root, before anything is marked deleted."""
    if errors > 0 and directories <= 1 and files == 0:
        raise RuntimeError("the root could not be read; no entry is marked deleted")


def needs_fingerprint(state: DataFrame) -> DataFrame:
    """Live images without a fingerprint."""
    return live(state).filter(F.col("mime").startswith("image/") & F.col("fingerprint").isNull())


def unreadable(files: DataFrame) -> DataFrame:
    """The rows of `sources.files.hash_files` that could not be read; `enrich` leaves them out."""
    return files.filter(F.col("message").isNotNull() | F.col("hash").isNull())


def enrich(files: DataFrame, seq: Column | None = None) -> DataFrame:
    """Hash read files: content hash for all, media hashes by type.

    Expects `path, size, last_modified, mime` and either `content` or the columns of `sources.files.hash_files`, and
    uses `image_fingerprint`, `video_fingerprint`, `image_size`, `text` and `attributes` where decoders have
    supplied them.
    """
    have = set(files.columns)

    def given(name: str, kind: str) -> Column:
        return F.col(name) if name in have else F.lit(None).cast(kind)

    def hashed(name: str, function) -> Column:
        return F.col(name) if name in have else function("content")

    image = F.col("mime").startswith("image/")
    video = F.col("mime").startswith("video/")
    audio = F.col("mime").startswith("audio/")
    pdf = F.col("mime") == "application/pdf"
    attributes = given("attributes", "map<string,string>")
    video_hash = F.coalesce(given("video_fingerprint", "string"), hashed("fallback_hash", fallback_hash))
    passed = [c for c in ("repo", "path", "size", "last_modified", "mime") if c in have]
    # What could not be read has no hash, and must not be taken for a content: see `unreadable`.
    files = files.filter(hashed("hash", content_hash).isNotNull())
    if "message" in have:
        files = files.filter(F.col("message").isNull())
    return files.select(
        *passed,
        *([seq.alias("seq")] if seq is not None else []),
        hashed("hash", content_hash).alias("hash"),
        F.lit(False).alias("missing"),
        F.when(image, given("image_fingerprint", "string")).alias("fingerprint"),
        F.when(image, given("image_size", "struct<width:int,height:int>")).alias("image_size"),
        F.when(video, video_hash).alias("video_hash"),
        F.when(pdf, text_hash(given("text", "string"))).alias("pdf_hash"),
        F.when(audio, hashed("audio_hash", audio_chunk_hash)).alias("audio_hash"),
        F.when(video | audio | pdf, attributes).alias("attributes"),
    )


def update_stats(changes: DataFrame, mimes: DataFrame | None = None, keys: list[str] | None = None) -> DataFrame:
    """(counter, value): rows per status, and rows per type among the added ones when `mimes(path, mime)` is given.

    `changed` and `reappeared` rows are written again and therefore count as added.
    """
    keys = keys or ["path"]
    status = F.when(F.col("status").isin("changed", "reappeared"), "added").otherwise(F.col("status"))
    rows = changes.select(*keys, status.alias("counter"))
    counted = rows.groupBy("counter").agg(F.count("*").alias("value"))
    if mimes is None:
        return counted
    added = rows.filter(F.col("counter") == "added").join(mimes.select(*keys, "mime"), keys)
    return counted.unionByName(added.groupBy(F.col("mime").alias("counter")).agg(F.count("*").alias("value")))


def update_repo(
    spark: SparkSession, root: str, log: DataFrame, repo: str, decode: Callable[[DataFrame], DataFrame] | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Bring the log of one repo up to date with the files below `root`, a directory that all executors mount.

    Returns (records to append, statistics, problems): records of new, changed, returned and deleted files with the next
    sequence number, in the columns of the file record; `counter, value` of what the scan found; and `path, message` of all files and directories that could
    not be read. Unreadable files keep the record they have. Entries below directories that failed are not deleted, and
    nothing is if the root itself could not be read. `decode` may add the columns of decoders (see `enrich`) to the hashed
    files; then live images without a fingerprint are read again, and logged again if they got one.
    """
    mine = checkpointed(latest(log.filter(F.col("repo") == repo)))
    entries = scan_files(spark, root)
    kinds = {r["kind"]: r["n"] for r in entries.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    check_scan(kinds.get("file", 0), kinds.get("dir", 0), kinds.get("failed", 0))
    failed = entries.filter("kind = 'failed'").select("path", "message")
    listing = entries.filter("kind = 'file'").select("path", "size", "last_modified")
    changes = checkpointed(classify_changes(listing, mine, failed=failed))
    wanted = to_read(changes).select("path", "size", "last_modified")
    if decode is not None:
        again = changes.filter(F.col("status").isin("unchanged", "reappeared"))
        again = again.join(needs_fingerprint(mine).select("path"), "path", "left_semi")
        wanted = wanted.unionByName(again.select("path", "size", "last_modified"))
    hashed = checkpointed(hash_files(root, wanted))
    number = F.lit(next_seq(log)).cast("bigint")
    decoded = hashed if decode is None else decode(hashed)
    read = normalise(file_records(enrich(decoded.withColumn("repo", F.lit(repo)))))
    news = to_read(changes).select("path")
    read = read.join(news, "path", "left_semi").unionByName(
        read.filter(F.col("fingerprint").isNotNull()).join(news, "path", "left_anti")
    )
    back = reappeared(changes, mine).join(read.select("path"), "path", "left_anti")
    gone = mine.join(changes.filter("status = 'deleted'").select("path"), "path", "left_semi")
    gone = gone.withColumn("missing", F.lit(True))
    records = read.unionByName(file_records(back)).unionByName(file_records(gone))
    problems = failed.unionByName(unreadable(hashed).select("path", "message"))
    return records.withColumn("seq", number), update_stats(changes), problems


def mime_histogram(rows: DataFrame) -> DataFrame:
    """Rows per type, the most frequent first."""
    return rows.groupBy("mime").agg(F.count("*").alias("value")).orderBy(F.col("value").desc(), "mime")


def rolling_eta(
    events: DataFrame, key: str, ts: str, order: str, n: int = RATE_WINDOW, hot: HotKeys | None = None
) -> DataFrame:
    """Remaining-time estimate after every completion of a key, `ts` in epoch milliseconds.

    The recent rate comes from the last `n` completions, the global one from all so far; they are blended by how
    full the window is, and the recent one is used when it is larger. Nothing is estimated in the first seconds.

    Adds `done`, `total`, `recent_count`, `span`, `elapsed` and `remaining_millis`. Every row needs the row n-1
    places before it, which is a window offset for ordinary keys and an equi-join on row numbers for hot ones.
    """
    hot = find_hot_keys(events, [key]) if hot is None else hot
    by_key = Window.partitionBy(key).orderBy(ts, order)
    if not hot:
        recent = by_key.rowsBetween(-(n - 1), 0)
        whole = Window.partitionBy(key)
        rows = events.withColumns({
            "done": F.row_number().over(by_key).cast("bigint"),
            "_oldest": F.first(ts).over(recent),
            "total": F.count("*").over(whole),
            "_begin": F.min(ts).over(whole),
        })
    else:
        totals = events.groupBy(key).agg(F.count("*").alias("total"), F.min(ts).alias("_begin"))
        rows = row_numbers(events, [key], [F.col(ts).asc(), F.col(order).asc()], "done", hot)
        rows = rows.withColumn("_from", F.greatest(F.col("done") - (n - 1), F.lit(1)))
        olds = rows.select(F.col(key), F.col("done").alias("_from"), F.col(ts).alias("_oldest"))
        rows = rows.join(olds, [key, "_from"]).drop("_from")
        rows = skewed_join(rows, totals, [key], "inner", [order], hot)
    count = F.least(F.col("done"), F.lit(n)) - 1
    span = F.col(ts) - F.col("_oldest")
    elapsed = F.col(ts) - F.col("_begin")
    left = F.col("total") - F.col("done")
    rows = rows.withColumns({"recent_count": count, "span": span, "elapsed": elapsed, "_left": left})
    overall = F.expr("elapsed * _left div done")
    recent = F.expr("case when recent_count > 0 then span * _left div recent_count end")
    weight = F.col("recent_count") / F.lit(float(RATE_WINDOW))
    blend = F.floor(F.col("_recent") * weight + F.col("_overall") * (1.0 - weight))
    estimate = F.when(F.col("_recent").isNull(), F.col("_overall")).otherwise(F.greatest(blend, F.col("_recent")))
    return (
        rows.withColumns({"_overall": overall, "_recent": recent})
        .withColumn("remaining_millis", F.when(F.col("elapsed") > WARM_UP_MILLIS, estimate))
        .drop("_oldest", "_begin", "_left", "_overall", "_recent")
    )
