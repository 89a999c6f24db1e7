"""Registered queries: the operators applied to the test tables, each over whole tables."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from twinfinder.functions import hashing, image, media, text
from twinfinder.operators import (
    diff, exact, files, filters, incremental, index, rank, reconcile, similar, update,
    verified,
)
from twinfinder.plans.skew import find_hot_keys
from twinfinder.schema import records
from twinfinder.session import checkpoint_folder, checkpointed, configure
from twinfinder.sources import catalog, formats, log as logs, report as reports
from twinfinder.sources.table import from_table
from twinfinder.streaming import state as streams

Query = Callable[[SparkSession, str], DataFrame]

def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- tables as repos ---------------------------------------------------------------------------------------------


def document_index(spark: SparkSession, sf: str, **columns: Column) -> DataFrame:
    """Documents as text files, one repo per source. Texts are read and hashed once, then only records travel."""
    docs = table(spark, sf, "documents")
    records = from_table(
        docs,
        path=F.concat_ws("/", "source", "lang", F.concat("doc_id", F.lit(".txt"))),
        content="text",
        mtime=F.col("doc_id") * 1000,
        repo="source",
        seq="doc_id",
        mime=F.concat(F.lit("text/"), "lang"),
        **columns,
    )
    return checkpointed(records)


def event_records(events: DataFrame, **columns: Column) -> DataFrame:
    """Events as a change log: one path per user, error events delete."""
    return events.select(
        F.lit("events").alias("repo"),
        F.col("event_id").alias("seq"),
        F.col("event_type").alias("hash"),
        F.col("user_id").cast("string").alias("path"),
        F.floor("value").alias("size"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("last_modified"),
        (F.col("event_type") == "error").alias("missing"),
        F.lit("").alias("mime"),
        *[c.alias(n) for n, c in columns.items()],
    )


def event_log(spark: SparkSession, sf: str, **columns: Column) -> DataFrame:
    return event_records(table(spark, sf, "events"), **columns)


def labelled_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as records with their labels, paths shared between even and odd sources."""
    # Texts are hashed where they are read; only narrow rows are joined.
    docs = table(spark, sf, "documents").select(
        F.when(F.col("source").rlike("[02468]$"), "a").otherwise("b").alias("repo"),
        "doc_id",
        hashing.content_hash("text").alias("hash"),
        F.concat("lang", F.lit("/"), F.expr("doc_id div 2"), F.lit(".txt")).alias("path"),
        F.octet_length("text").cast("bigint").alias("size"),
        (F.col("doc_id") * 1000).alias("last_modified"),
        F.concat(F.lit("text/"), "lang").alias("mime"),
        "lang",
        "n_chars",
    )
    labels = table(spark, sf, "labels").select("doc_id", "quality", "toxic")
    missing = (F.coalesce("toxic", F.lit(0)) == 1).alias("missing")
    return checkpointed(
        docs.join(labels, "doc_id", "left").select(
            "repo", F.col("doc_id").alias("seq"), "hash", "path", "size", "last_modified", missing, "mime", "lang",
            "quality", "n_chars",
        )
    )


def two_repos(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Documents of even and of odd sources; toxic ones have been deleted."""
    docs = labelled_documents(spark, sf).drop("lang", "quality", "n_chars")
    return docs.filter(F.col("repo") == "a"), docs.filter(F.col("repo") == "b")


def listing_and_state(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """What a scan finds against an older index.

    The index knows the labelled documents, French ones in an older version, Spanish ones with their length in
    characters; toxic ones were deleted. The scan finds all documents but those of quality 0.
    """
    docs = labelled_documents(spark, sf)
    listing = docs.filter(F.coalesce("quality", F.lit(1)) == 1).select("repo", "path", "size", "last_modified", "mime")
    state = docs.filter(F.col("quality").isNotNull()).select(
        "repo", "seq", "hash", "path",
        F.when(F.col("lang") == "es", F.col("n_chars")).otherwise(F.col("size")).alias("size"),
        (F.col("last_modified") - (F.col("lang") == "fr").cast("bigint")).alias("last_modified"),
        "missing", "mime",
    )
    return listing, state


def line_index(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as images: equal part and supplier are equal content, quantity and line give the dimensions."""
    lines = table(spark, sf, "lineitem")
    return from_table(
        lines,
        path=F.concat_ws("/", "l_orderkey", "l_linenumber"),
        content=F.concat_ws("|", "l_partkey", "l_suppkey"),
        mtime=F.unix_millis(F.col("l_shipdate").cast("timestamp")),
        repo="l_returnflag",
        mime=F.lit("image/line"),
        image_size=F.struct(
            (F.col("l_quantity") * 100).cast("int").alias("width"), (F.col("l_linenumber") * 100).alias("height")
        ),
    )


def order_index(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with their priority as content: five groups that hold everything."""
    orders = table(spark, sf, "orders")
    return from_table(
        orders,
        path=F.concat_ws("/", "o_custkey", "o_orderkey"),
        content="o_orderpriority",
        mtime=F.unix_millis(F.col("o_orderdate").cast("timestamp")),
        repo="o_orderstatus",
    )


def _bits(test: Callable[[Column], Column]) -> Column:
    """64 tests on the values of an embedding as sixteen hex digits, the first value in the lowest bit."""
    word = F.aggregate(
        F.reverse("embedding"),
        F.lit(0).cast("bigint"),
        lambda bits, x: F.shiftleft(bits, 1).bitwiseOR(test(x.cast("double")).cast("bigint")),
    )
    return hashing.word_hex(word)


def embedding_index(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings as images and videos: the fingerprint are sign bits, the video has three such words."""
    words = [_bits(lambda x: x > 0), _bits(lambda x: x > 0.05), _bits(lambda x: x > -0.05)]
    return checkpointed(
        table(spark, sf, "embeddings").select(
            F.lit("embeddings").alias("repo"),
            F.col("vec_id").alias("seq"),
            F.col("vec_id").cast("string").alias("path"),
            F.concat(F.lit("image/l"), "label").alias("mime"),
            F.lit(64).cast("bigint").alias("size"),
            F.lit(False).alias("missing"),
            words[0].alias("fingerprint"),
            hashing.temporal_hash(*words, F.lit(1.0)).alias("video_hash"),
        )
    )


def grids(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings as 9x9 grids of grey values: all 64 values and the first 17 again."""
    cells = F.transform(
        F.sequence(F.lit(0), F.lit(80)),
        lambda i: (F.floor(F.abs(F.get("embedding", i % 64).cast("double")) * 1000) % 256).cast("int"),
    )
    return table(spark, sf, "embeddings").select("vec_id", cells.alias("grid"))


# --- queries -----------------------------------------------------------------------------------------------------

GROUP_COLUMNS = ["kind", "group_key", "copies", "repo", "path", "size", "hash"]


def q_exact_groups(spark, sf):
    return exact.exact_groups(document_index(spark, sf)).select(*GROUP_COLUMNS)


def q_exact_ranked(spark, sf):
    return rank.ranked_exact(document_index(spark, sf)).select(*GROUP_COLUMNS, "rank")


def q_lines_ranked(spark, sf):
    return rank.ranked_exact(line_index(spark, sf)).select(
        "group_key", "copies", "repo", "path", "rank", media.dimension_text("image_size").alias("image")
    )


def q_hot_groups_ranked(spark, sf):
    """All orders are in five groups; limits far below their sizes force the split paths."""
    ranked = rank.ranked_exact(order_index(spark, sf), rows_per_task=1000, sample=1.0)
    return ranked.select("group_key", "copies", "repo", "path", "rank")


def q_dimension_filter(spark, sf):
    groups = exact.exact_groups(line_index(spark, sf), width=">=2500", height="<400")
    return groups.select("group_key", "copies", "repo", "path")


def fallback_index(spark, sf):
    return document_index(
        spark, sf, video_hash=F.concat(F.lit(hashing.FALLBACK_PREFIX), hashing.text_hash("text"))
    )


def q_fallback_groups(spark, sf):
    return exact.exact_groups(fallback_index(spark, sf)).select(*GROUP_COLUMNS)


def q_fallback_removal(spark, sf):
    plan = rank.removal_plan(checkpointed(exact.exact_groups(fallback_index(spark, sf))))
    return plan.groupBy("action", "repo", "path").agg(F.count("*").alias("times"))


def q_removal_plan(spark, sf):
    return rank.removal_plan(checkpointed(exact.exact_groups(document_index(spark, sf)))).drop("target")


def q_move_plan(spark, sf):
    named = document_index(spark, sf).withColumn("path", F.concat("seq", F.lit("/"), "repo", F.lit(".txt")))
    return rank.move_plan(checkpointed(exact.exact_groups(named)), "/archive")


def q_keep_plan(spark, sf):
    ranked = checkpointed(rank.ranked_exact(document_index(spark, sf)))
    keep = ranked.filter(F.col("rank") <= 2)
    return rank.keep_plan(ranked, keep).select("action", "repo", "path", "reason")


def q_removal_log(spark, sf):
    docs = document_index(spark, sf)
    plan = rank.removal_plan(checkpointed(exact.exact_groups(docs)))
    log = rank.apply_plan_to_log(docs, docs, plan)
    return index.latest(log).select("repo", "path", "missing", "seq")


def q_group_numbers(spark, sf):
    groups = checkpointed(exact.exact_groups(document_index(spark, sf)))
    return rank.number_groups(groups).select("group_no", "group_key", "repo", "path")


def q_groups_table(spark, sf):
    listed = reports.groups_table(exact.exact_groups(document_index(spark, sf)))
    return listed.drop("image")


def q_latest_state(spark, sf):
    return index.latest(event_log(spark, sf)).select("path", "seq", "hash", "size", "missing")


def q_live_state(spark, sf):
    return index.live(index.latest(event_log(spark, sf))).select("path", "seq", "hash", "size")


def q_index_stats(spark, sf):
    return index.index_stats(event_log(spark, sf))


def q_index_stats_documents(spark, sf):
    return index.index_stats(document_index(spark, sf))


def q_merge_stats(spark, sf):
    return index.merge_stats(
        index.index_stats(event_log(spark, sf)), index.index_stats(document_index(spark, sf))
    )


def q_prune_drop(spark, sf):
    return index.prune(event_log(spark, sf), buckets=7).select("path", "seq", "hash", "bucket")


def q_prune_keep(spark, sf):
    return index.prune(event_log(spark, sf), keep_deleted=True).select("path", "seq", "hash", "missing", "bucket")


def q_lookup_path(spark, sf):
    return index.lookup_path(event_log(spark, sf), "8").select("path", "seq", "hash", "last_modified")


def q_lookup_hash(spark, sf):
    return index.lookup_hash(index.latest(event_log(spark, sf)), "error").select("path", "seq", "missing")


def q_lookup_hash_size(spark, sf):
    return index.lookup_hash(index.latest(event_log(spark, sf)), "click", 12).select("path", "seq", "missing")


def q_lookup_contents(spark, sf):
    a, b = two_repos(spark, sf)
    return index.lookup_contents(a, b).select("repo", "path", "hash", "missing")


def _new_folder(spark: SparkSession) -> str:
    return f"{checkpoint_folder(spark)}/{uuid.uuid4().hex}"


def q_json_log(spark, sf):
    """Records written as a compressed JSON-lines log and read back; each path occurs once, in some file."""
    folder = _new_folder(spark)
    logs.write_json_log(records(document_index(spark, sf)), folder, compress=True)
    state = index.latest(logs.read_log(spark, folder, "json"), shard="shard")
    return state.select("path", "hash", "size", "last_modified", "mime", "missing")


def q_quarantine(spark, sf):
    """A log whose French records were cut off in the middle: the others survive."""
    line = F.to_json(F.struct(F.col("hash").alias("h"), F.col("path").alias("p"), F.col("size").alias("s")))
    lines = document_index(spark, sf).select(
        F.when(F.col("mime") == "text/fr", F.left(line, F.lit(12))).otherwise(line).alias("value")
    )
    folder = _new_folder(spark)
    lines.write.text(folder)
    good, bad = logs.quarantine(logs.read_json_log(spark, folder, "r"))
    kept = good.groupBy("hash", "size").agg(F.count("*").alias("n"), F.min("path").alias("path"))
    cut = bad.groupBy().agg(F.count("*").alias("n"))
    return kept.unionByName(
        cut.select(F.lit("bad").alias("hash"), F.lit(0).cast("bigint").alias("size"), "n", F.lit("").alias("path"))
    )


def q_parquet_log(spark, sf):
    """Events appended to a stored log by type, pruned there to other buckets, and read back."""
    folder = _new_folder(spark)
    events = event_log(spark, sf)
    early = F.coalesce(F.col("hash").isin("view", "purchase"), F.lit(False))
    for part in (early, ~early):
        logs.append_log(events.filter(part), folder)
    logs.prune_log(spark, folder, buckets=7)
    return logs.read_log(spark, folder).select("path", "seq", "hash", F.col("bucket").cast("bigint"))


def q_fallback_hash(spark, sf):
    """The hash of what follows the first MiB: texts repeated a hundred times, of which the longer ones reach that far."""
    content = F.repeat("text", 100).cast("binary")
    return table(spark, sf, "documents").select("doc_id", hashing.fallback_hash(content).alias("fallback_hash"))


def q_update_repo(spark, sf):
    """The records of a second scan of documents written out as files: French ones have changed, Spanish ones are gone."""
    folder = _local_folder(spark)
    docs = table(spark, sf, "documents").select(F.concat("lang", F.lit("/"), "doc_id").alias("path"), "text", "lang")
    _write_files(docs, folder)
    nothing = records(spark.createDataFrame([], "repo string"))
    first = checkpointed(update.update_repo(spark, folder, nothing, "docs")[0])
    _spoil(docs, folder)
    second = update.update_repo(spark, folder, first, "docs")[0]
    return second.select("path", "hash", "size", "missing")


def q_scan_format(spark, sf):
    """Documents written out as files, and scanned there: files by path and size, and directories."""
    folder = _local_folder(spark)
    docs = table(spark, sf, "documents")
    _write_files(docs.select(F.concat_ws("/", "source", "lang", "doc_id").alias("path"), "text"), folder)
    formats.register(spark)
    scan = spark.read.format(formats.SCAN).option("path", folder).option("tasks", 8)
    one = scan.option("push", "true").load().filter("kind = 'file' AND path LIKE 'src1/%'")
    return scan.option("push", "false").load().select("kind", "path", "size").unionByName(
        one.select(F.lit("again").alias("kind"), "path", "size")
    )


def q_log_format(spark, sf):
    """Events as log files that grow while a stream reads them: it goes on behind what it has read."""
    folder = _local_folder(spark)
    os.makedirs(f"{folder}/log")
    lines = event_log(spark, sf).select("seq", F.to_json(F.struct(
        F.col("hash").alias("h"), F.col("path").alias("p"), F.col("size").alias("s"), F.col("last_modified").alias("l"),
        F.col("missing").alias("d"),
    )).alias("line"))
    formats.register(spark)
    for half in range(2):
        _append_lines(lines.filter(F.col("seq") % 2 == half).repartition(4, F.col("seq") % 4), f"{folder}/log")
        stream = spark.readStream.format(formats.LOG).option("path", f"{folder}/log").option("span", 100_000).load()
        writer = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/offsets")
        writer.trigger(availableNow=True).start(f"{folder}/read").awaitTermination()
    read = spark.read.schema(stream.schema).parquet(f"{folder}/read")
    return read.select("path", "hash", "size", "last_modified", "missing", "corrupt")


def _append_lines(lines: DataFrame, folder: str) -> None:
    """Add the lines of each partition to a file of its own, in one write."""

    def write(batches):
        for batch in batches:
            for number, rows in batch.groupby(batch["seq"] % 4 // 2):
                with open(f"{folder}/{number}.json", "a", encoding="utf-8") as file:
                    file.write("".join(line + "\n" for line in rows["line"]))
            yield batch[["seq"]]

    lines.coalesce(1).mapInPandas(write, "seq bigint").count()


def q_reconciled_status(spark, sf):
    """One repo against another by sketches of their contents: equal buckets of the target are not read."""
    folder = _new_folder(spark)
    a, b = two_repos(spark, sf)
    stored = [reconcile.store_contents(part, f"{folder}/{name}", 64) for name, part in (("a", a), ("b", b))]
    return reconcile.reconciled_status(a, *stored)[0]


def q_verified_removal(spark, sf):
    """Duplicates among documents written out as files, removed there after a look at the copies to keep.

    Of the copies to keep, those of French documents are changed and those of Spanish ones taken away before that.
    """
    folder = _local_folder(spark)
    docs = table(spark, sf, "documents").select(F.concat("lang", F.lit("/"), "doc_id").alias("path"), "text", "doc_id")
    records_ = checkpointed(from_table(docs, path="path", content="text", mtime=F.col("doc_id") * 1000, repo=F.lit("docs")))
    groups = checkpointed(rank.rank_group(exact.exact_groups(records_)))
    kept = groups.filter("rank = 1").select("path", (F.substring("path", 1, 2)).alias("lang"))
    _write_files(docs.join(groups.select("path"), "path"), folder)
    _spoil(kept, folder)
    done = verified.apply_claims(verified.claims(groups), {"docs": folder}, dry_run=False)
    again = verified.apply_claims(verified.claims(groups), {"docs": folder}, dry_run=False)
    both = done.select(F.lit(1).alias("run"), "path", "status", "message", "keep_path")
    return both.unionByName(again.select(F.lit(2).alias("run"), "path", "status", "message", "keep_path"))


def _local_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors mount: below the shared one, without its scheme."""
    return re.sub("^file:/*", "/", _new_folder(spark))


def _write_files(texts: DataFrame, folder: str) -> None:
    """Each `text` as the file `path` below a folder that the executors mount."""

    def write(batches):
        for batch in batches:
            for path, text in zip(batch["path"], batch["text"]):
                os.makedirs(os.path.dirname(f"{folder}/{path}"), exist_ok=True)
                with open(f"{folder}/{path}", "w", encoding="utf-8", newline="") as file:
                    file.write(text)
            yield batch[["path"]]

    texts.select("path", "text").mapInPandas(write, "path string").count()


def _spoil(kept: DataFrame, folder: str) -> None:
    def spoil(batches):
        for batch in batches:
            for path, lang in zip(batch["path"], batch["lang"]):
                if lang == "fr":
                    with open(f"{folder}/{path}", "a", encoding="utf-8") as file:
                        file.write("!")
                if lang == "es" and os.path.exists(f"{folder}/{path}"):
                    os.remove(f"{folder}/{path}")
            yield batch[["path"]]

    kept.select("path", "lang").mapInPandas(spoil, "path string").count()


def _three_batches(spark, sf) -> incremental.ContentIndex:
    """The events in three batches, each a third of them all over the time, so that later ones bring older records."""
    kept = incremental.ContentIndex(spark, _new_folder(spark), buckets=16)
    events = event_log(spark, sf)
    for batch in range(3):
        kept.apply(batch + 1, events.filter(F.col("seq") % 3 == batch))
    return kept


def q_incremental_groups(spark, sf):
    """Contents with more than one live path, from signed counts of three batches with deletions."""
    return _three_batches(spark, sf).group_counts().select("hash", "size", "copies")


def q_incremental_stats(spark, sf):
    """Statistics of the index from the same counts."""
    return _three_batches(spark, sf).stats()


def q_repaired_log(spark, sf):
    """Events as JSON lines, every seventh cut off in the middle, taken over by a repair: records, and lines kept aside."""
    folder = _new_folder(spark)
    lines = event_log(spark, sf).select("seq", F.to_json(F.struct(
        F.col("hash").alias("h"), F.col("path").alias("p"), F.col("size").alias("s"), F.col("last_modified").alias("l"),
        F.col("missing").alias("d"),
    )).alias("line"))
    half = F.substring("line", F.lit(1), (F.length("line") / 2).cast("int"))
    lines.select(F.when(F.col("seq") % 7 == 0, half).otherwise(F.col("line")).alias("line")).write.text(f"{folder}/json")
    logs.repair_log(spark, f"{folder}/json", f"{folder}/log", "events")
    good = logs.read_log(spark, f"{folder}/log").select(
        F.lit("good").alias("kind"), "path", "hash", "size", "last_modified", "missing", F.lit(None).cast("string").alias("text"))
    bad = logs.bad_lines(spark, f"{folder}/log").select(
        F.lit("bad").alias("kind"), F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("hash"),
        F.lit(None).cast("bigint").alias("size"), F.lit(None).cast("bigint").alias("last_modified"),
        F.lit(None).cast("boolean").alias("missing"), "text")
    return good.unionByName(bad)


def q_catalog(spark, sf):
    """Two repos registered in the catalog, filled, opened together and pruned there."""
    database = f"twinfinder_{uuid.uuid4().hex}"
    a, b = two_repos(spark, sf)
    for name, part in (("first", a), ("second", b)):
        catalog.create_repo(spark, name, f"/data/{name}", database=database)
        catalog.append_records(spark, name, part, database)
    catalog.prune_repo(spark, "first", buckets=3, database=database)
    catalog.rename_repo(spark, "second", "third", database)
    logs_of_both = catalog.open_repos(spark, database=database)
    result = checkpointed(index.latest(logs_of_both).select("repo", "path", "hash", "size", "missing"))
    for name in ("first", "third"):
        catalog.drop_repo(spark, name, database)
    spark.sql(f"DROP DATABASE {database}")
    return result


def q_catalog_changes(spark, sf):
    """A repo copied to another name and place, the copy stored in another form and moved; both opened together."""
    database = f"twinfinder_{uuid.uuid4().hex}"
    a, _ = two_repos(spark, sf)
    catalog.create_repo(spark, "first", "/data/first", database=database)
    catalog.append_records(spark, "first", a, database)
    catalog.copy_repo(spark, "first", "copy", "/data/copy", database)
    catalog.configure_repo(spark, "copy", codec="json", compressed=True, database=database)
    catalog.relocate_repo(spark, "copy", "/archive/copy", database)
    about = catalog.list_repos(spark, verbose=True, database=database).withColumnRenamed("path", "base")
    records = catalog.open_repos(spark, database=database).join(about, F.col("repo") == F.col("name"))
    result = checkpointed(records.select("repo", "path", "hash", "size", "missing", "base", "codec", "compressed"))
    for name in ("first", "copy"):
        catalog.drop_repo(spark, name, database)
    spark.sql(f"DROP DATABASE {database}")
    return result


def _stored_repos(spark, sf, use) -> DataFrame:
    """What `use` makes of two repos whose states the catalog stores; one of them grows after it was stored first."""
    database = f"twinfinder_{uuid.uuid4().hex}"
    a, b = two_repos(spark, sf)
    for name in ("a", "b"):
        catalog.create_repo(spark, name, f"/data/{name}", database=database)
    catalog.append_records(spark, "a", a.filter("seq % 3 > 0"), database)
    catalog.append_records(spark, "b", b, database)
    catalog.store_states(spark, ["a", "b"], buckets=8, database=database)
    catalog.append_records(spark, "a", a.filter("seq % 3 = 0"), database)
    result = checkpointed(use(lambda *names: catalog.read_states(spark, list(names), database)))
    spark.sql(f"DROP DATABASE {database} CASCADE")
    return result


def q_stored_groups(spark, sf):
    """Equal contents across two repos, counted in the buckets of their stored states."""
    return _stored_repos(spark, sf, lambda read: exact.stored_groups(read("a", "b")).select("kind", "group_key", "copies", "repo", "path"))


def q_stored_status(spark, sf):
    """One repo against another, compared in the buckets of their stored states."""
    return _stored_repos(spark, sf, lambda read: diff.diff_status(read("a"), read("b")))


def q_valid_names(spark, sf):
    """Which sources and which first words of documents could name a repo."""
    word = F.substring_index("text", " ", 1)
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", filters.valid_name("source").alias("source_valid"), filters.valid_name(word).alias("word_valid"))


def _filtered(expression: str) -> Query:
    def run(spark, sf):
        rows = from_documents_metadata(spark, sf)
        return rows.filter(filters.parse_filter(expression)).select("repo", "path", "size", "mime")
    return run


def from_documents_metadata(spark, sf):
    return from_table(
        table(spark, sf, "documents"),
        path=F.concat_ws("/", "source", "lang", F.concat("doc_id", F.lit(".txt"))),
        content="text",
        mtime=F.col("doc_id") * 1000,
        repo="source",
        seq="doc_id",
        mime=F.concat(F.lit("text/"), "lang"),
    )


def q_files_ls(spark, sf):
    return files.files_ls(from_documents_metadata(spark, sf), filters.parse_filter("name:/de/"))


def q_mime_types(spark, sf):
    return files.mime_types(from_documents_metadata(spark, sf))


def q_files_rm(spark, sf):
    return files.files_rm_plan(from_documents_metadata(spark, sf), filters.parse_filter("size:<500")).drop("target")


def q_files_cp(spark, sf):
    docs = from_documents_metadata(spark, sf)
    return files.files_cp_plan(docs, "/backup/", "bak", filters.parse_filter("mime:text/fr"))


def q_files_mv(spark, sf):
    """Several files share a target here: all but the first are conflicts."""
    docs = from_documents_metadata(spark, sf).withColumn("path", F.concat("mime", F.lit("/x."), "repo"))
    return files.files_mv_plan(docs.withColumn("repo", F.col("seq").cast("string")), "/moved", "txt")


def q_changes(spark, sf):
    listing, state = listing_and_state(spark, sf)
    changes = update.classify_changes(listing, state, ["repo", "path"])
    return changes.select("repo", "path", "status", "old_hash")


def q_to_read(spark, sf):
    listing, state = listing_and_state(spark, sf)
    return update.to_read(update.classify_changes(listing, state, ["repo", "path"])).select("repo", "path", "size")


def q_reappeared(spark, sf):
    listing, state = listing_and_state(spark, sf)
    changes = update.classify_changes(listing, state, ["repo", "path"])
    return update.reappeared(changes, state, ["repo", "path"]).select("repo", "path", "hash", "last_modified", "missing")


def q_tombstones(spark, sf):
    listing, state = listing_and_state(spark, sf)
    return update.tombstones(state, listing, ["repo", "path"]).select("repo", "path", "hash", "missing")


def q_tombstones_failed_dir(spark, sf):
    listing, state = listing_and_state(spark, sf)
    failed = spark.createDataFrame([("fr",), ("de",)], "path string")
    gone = update.tombstones(state, listing, ["repo", "path"], failed)
    return gone.select("repo", "path", "hash", "missing")


def q_update_stats(spark, sf):
    listing, state = listing_and_state(spark, sf)
    keys = ["repo", "path"]
    return update.update_stats(update.classify_changes(listing, state, keys), listing, keys)


def q_enrich(spark, sf):
    """Documents as contents of four media types by language."""
    kinds = F.create_map(*[F.lit(x) for x in (
        "en", "application/pdf", "de", "audio/x", "fr", "video/x", "es", "image/x"
    )])
    docs = table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("path"),
        F.octet_length("text").cast("bigint").alias("size"),
        F.col("doc_id").alias("last_modified"),
        F.try_element_at(kinds, "lang").alias("mime"),
        F.col("text").cast("binary").alias("content"),
        "text",
        F.sha1("source").alias("image_fingerprint"),
        F.md5("source").alias("video_fingerprint"),
    )
    return update.enrich(docs).select(
        "path", "hash", "fingerprint", "video_hash", "pdf_hash", "audio_hash", "missing"
    )


def q_mime_histogram(spark, sf):
    return update.mime_histogram(from_documents_metadata(spark, sf))


def q_needs_fingerprint(spark, sf):
    images = embedding_index(spark, sf)
    shown = F.when(F.col("mime") != "image/l0", F.col("fingerprint"))
    return update.needs_fingerprint(images.withColumn("fingerprint", shown)).select("path", "mime")


def q_diff_status(spark, sf):
    a, b = two_repos(spark, sf)
    return diff.diff_status(a, b)


def q_diff_copy(spark, sf):
    a, b = two_repos(spark, sf)
    return diff.diff_copy_plan(a, b, "/new")


def q_diff_move(spark, sf):
    a, b = two_repos(spark, sf)
    plan = diff.diff_move_plan(a, b, "/new", filters.parse_filter("mime:/en"))
    log = rank.apply_plan_to_log(a, a, plan)
    return index.latest(log).select("repo", "path", "missing", "seq")


def q_diff_delete(spark, sf):
    a, b = two_repos(spark, sf)
    return diff.diff_delete_plan(a, b).select("action", "repo", "path")


def q_sync_plan(spark, sf):
    a, b = two_repos(spark, sf)
    return diff.sync_plan(a, b)


def q_sync_mirror(spark, sf):
    a, b = two_repos(spark, sf)
    return diff.mirror_plan(a, b).select("action", "repo", "path", "hash", "size")


def q_sync_counters(spark, sf):
    a, b = two_repos(spark, sf)
    return diff.sync_counters(diff.mirror_plan(a, b))


def q_sync_log(spark, sf):
    a, b = two_repos(spark, sf)
    plan = checkpointed(diff.mirror_plan(a, b))
    log = diff.apply_sync_to_log(b, a, b, plan)
    return index.latest(log).select("repo", "path", "hash", "size", "missing")


def q_text_hash_groups(spark, sf):
    docs = document_index(spark, sf, pdf_hash=hashing.text_hash("text"))
    return exact.text_groups(docs).select("kind", "group_key", "copies", "repo", "path")


def q_content_hash(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id",
        hashing.content_hash("text").alias("content_hash"),
        hashing.text_hash("text").alias("text_hash"),
        hashing.audio_chunk_hash(F.col("text").cast("binary")).alias("audio_hash"),
        hashing.fallback_hash(F.col("text").cast("binary")).alias("fallback_hash"),
        F.sha1(hashing.to_hex("text")).alias("hex_sha1"),
    )


def q_hamming_pairs(spark, sf):
    return similar.hamming_pairs(embedding_index(spark, sf), "fingerprint", 64, 70, order=["seq"])


def q_hamming_pairs_90(spark, sf):
    return similar.hamming_pairs(embedding_index(spark, sf), "fingerprint", 64, 90, order=["seq"])


def q_hamming_pairs_80(spark, sf):
    return similar.hamming_pairs(embedding_index(spark, sf), "fingerprint", 64, 80, order=["seq"])


def q_video_pairs_85(spark, sf):
    return similar.hamming_pairs(embedding_index(spark, sf), "video_hash", 192, 85, order=["seq"])


def _clusters(groups: DataFrame) -> DataFrame:
    return groups.select("kind", "group_key", "copies", "seq")


def q_hamming_clusters(spark, sf):
    return _clusters(similar.image_groups(embedding_index(spark, sf), 70, order=["seq"]))


def q_hamming_clusters_crowded(spark, sf):
    """The same clusters with only a few nodes looked at in the first round, so that the search proceeds in more rounds."""
    return _clusters(similar.image_groups(embedding_index(spark, sf), 70, order=["seq"], heads=48))


def q_temporal_clusters(spark, sf):
    return _clusters(similar.video_groups(embedding_index(spark, sf), 70, order=["seq"]))


def event_sounds(spark, sf):
    return event_log(
        spark, sf,
        audio_hash=F.concat_ws("/", "event_type", "user_id"),
        attributes=F.create_map(F.lit("duration"), F.col("value").cast("string")),
    ).withColumn("missing", F.lit(False))


def q_tolerance_clusters(spark, sf):
    return _clusters(similar.audio_groups(event_sounds(spark, sf), order=["seq"]))


def q_find_similar(spark, sf):
    """All kinds of similarity over one state made of documents, embeddings and events."""
    docs = document_index(spark, sf, pdf_hash=hashing.text_hash("text"))
    parts = [docs, embedding_index(spark, sf), event_sounds(spark, sf)]
    state = reduce(DataFrame.unionByName, map(records, parts))
    found = similar.find_similar(state, 75, order=["seq"])
    return found.select("kind", "group_key", "copies", "repo", "path", "seq")


def q_canonical_grid(spark, sf):
    return grids(spark, sf).select(
        "vec_id", F.array_join(image.canonical_grid("grid"), ",").alias("canonical")
    )


def q_dhash(spark, sf):
    canonical = grids(spark, sf).select("vec_id", "grid", image.canonical_grid("grid").alias("canonical"))
    return canonical.select("vec_id", image.dhash("grid").alias("raw"), image.dhash("canonical").alias("fingerprint"))


def q_grid9(spark, sf):
    """Each embedding as an 8x8 grey image, reduced to the grid."""
    grey = F.transform(
        "embedding", lambda x: (F.floor(F.abs(x.cast("double")) * 1000) % 256).cast("int")
    )
    pixels = table(spark, sf, "embeddings").select("vec_id", grey.alias("pixels"))
    grid = image.grid9("pixels", F.lit(8), F.lit(8))
    return pixels.select("vec_id", F.array_join(grid, ",").alias("grid"))


def q_formatting(spark, sf):
    lines = table(spark, sf, "lineitem")
    amount = F.floor(F.pow(F.col("l_extendedprice"), F.lit(2))) + F.col("l_orderkey")
    path = F.concat_ws("/", F.lower("l_returnflag"), F.concat_ws(".", "l_linestatus", "l_orderkey"))
    return lines.select(
        "l_orderkey",
        "l_linenumber",
        text.format_size(amount).alias("size_text"),
        text.format_date(F.unix_millis(F.col("l_shipdate").cast("timestamp"))).alias("date_text"),
        text.replace_suffix(path, "jpg").alias("jpg"),
        text.parent(path).alias("parent"),
        text.file_name(path).alias("name"),
        text.join_path("/base", path).alias("joined"),
    )


def q_media(spark, sf):
    """Content types of pages by leading bytes and name, and attributes from a metadata map."""
    pages = table(spark, sf, "pages")
    metadata = F.create_map(
        F.lit("dc:title"), F.substring_index("url", "/", -1),
        F.lit("dc:creator"), F.lit(" "),
        F.lit("Page-Count"), F.col("page_id").cast("string"),
        F.lit("other"), F.lit("x"),
    )
    picked = media.pick_attributes(metadata)
    return pages.select(
        "page_id",
        media.detect_mime(F.substring("html", 1, 64).cast("binary"), F.concat("page_id", F.lit(".html"))).alias("mime"),
        F.to_json(picked).alias("attributes"),
        media.parse_duration(F.substring_index("url", "/", -1)).alias("duration"),
    )


def q_rolling_eta(spark, sf):
    log = event_log(spark, sf)
    return update.rolling_eta(log, "path", "last_modified", "seq", n=10).select(
        "path", "seq", "done", "total", "recent_count", "span", "elapsed", "remaining_millis"
    )


def q_rolling_eta_hot(spark, sf):
    """Types instead of users as keys, all of them treated as too large for one task."""
    log = event_log(spark, sf).select("hash", "seq", "last_modified")
    hot = find_hot_keys(log, ["hash"], rows_per_task=100, sample=1.0)
    return update.rolling_eta(log, "hash", "last_modified", "seq", hot=hot).select(
        "hash", "seq", "done", "total", "recent_count", "span", "elapsed", "remaining_millis"
    )


def q_report_md(spark, sf):
    return reports.report(checkpointed(exact.exact_groups(document_index(spark, sf))), "md")


def q_report_html(spark, sf):
    groups = similar.image_groups(embedding_index(spark, sf), 70, order=["seq"])
    groups = checkpointed(groups.withColumn("last_modified", F.col("seq") * 1000))
    return reports.report(groups, "html", threshold=70, roots={"embeddings": "/data/embeddings"})


def _event_stream(spark: SparkSession, sf: str) -> tuple[DataFrame, str]:
    """The events table as a stream of log records, and a new folder for what is kept of it."""
    schema = table(spark, sf, "events").schema
    stream = streams.read_stream(spark, sf, schema, "events.parquet")
    return event_records(stream), _new_folder(spark)


def q_latest_stream(spark, sf):
    log, folder = _event_stream(spark, sf)
    updates = streams.latest_stream(log)
    streams.write_latest(updates, f"{folder}/state", f"{folder}/offsets").awaitTermination()
    return streams.read_latest(spark, f"{folder}/state").select("path", "seq", "hash", "size", "missing")


def q_duplicates_stream(spark, sf):
    """Repeated contents in the stream of events, read from what the stream itself emits."""
    log, folder = _event_stream(spark, sf)
    timed = log.withColumn("at", F.timestamp_millis("last_modified"))
    found = streams.repeats_stream(timed, "at", "3650 days", "3650 days")
    streams.write_repeats(found, f"{folder}/repeats", f"{folder}/offsets").awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{folder}/repeats").select("path", "seq", "hash", "size", "first_seq")


def q_contents_stream(spark, sf):
    """The same duplicates by counting contents in the stream and joining the records afterwards."""
    log, folder = _event_stream(spark, sf)
    updates = streams.contents_stream(log)
    streams.write_contents(updates, f"{folder}/state", f"{folder}/offsets").awaitTermination()
    contents = streams.read_contents(spark, f"{folder}/state")
    found = streams.exact_duplicates(event_log(spark, sf), contents)
    return found.select("path", "seq", "hash", "size", "first_seq")


def q_first_seen_stream(spark, sf):
    """The first record of every content in the stream of events, with state that is dropped after ten years."""
    log, folder = _event_stream(spark, sf)
    timed = log.withColumn("at", F.timestamp_millis("last_modified"))
    first = streams.first_seen_within(timed, "at", "3650 days").select("hash", "size")
    writer = first.writeStream.outputMode("append").option("checkpointLocation", f"{folder}/offsets")
    writer.format("parquet").option("path", f"{folder}/first").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(first.schema).parquet(f"{folder}/first")


QUERIES: dict[str, Query] = {
    "exact_groups": q_exact_groups,
    "exact_ranked": q_exact_ranked,
    "lines_ranked": q_lines_ranked,
    "hot_groups_ranked": q_hot_groups_ranked,
    "dimension_filter": q_dimension_filter,
    "fallback_groups": q_fallback_groups,
    "fallback_removal": q_fallback_removal,
    "removal_plan": q_removal_plan,
    "move_plan": q_move_plan,
    "keep_plan": q_keep_plan,
    "removal_log": q_removal_log,
    "group_numbers": q_group_numbers,
    "groups_table": q_groups_table,
    "latest_state": q_latest_state,
    "live_state": q_live_state,
    "index_stats": q_index_stats,
    "index_stats_documents": q_index_stats_documents,
    "merge_stats": q_merge_stats,
    "prune_drop": q_prune_drop,
    "prune_keep": q_prune_keep,
    "lookup_path": q_lookup_path,
    "lookup_hash": q_lookup_hash,
    "lookup_hash_size": q_lookup_hash_size,
    "lookup_contents": q_lookup_contents,
    "json_log": q_json_log,
    "quarantine": q_quarantine,
    "parquet_log": q_parquet_log,
    "catalog": q_catalog,
    "catalog_changes": q_catalog_changes,
    "fallback_hash": q_fallback_hash,
    "update_repo": q_update_repo,
    "scan_format": q_scan_format,
    "log_format": q_log_format,
    "reconciled_status": q_reconciled_status,
    "verified_removal": q_verified_removal,
    "incremental_groups": q_incremental_groups,
    "incremental_stats": q_incremental_stats,
    "repaired_log": q_repaired_log,
    "stored_groups": q_stored_groups,
    "stored_status": q_stored_status,
    "valid_names": q_valid_names,
    "first_seen_stream": q_first_seen_stream,
    "filter_mime": _filtered("mime:/fr"),
    "filter_name": _filtered("name:src1/"),
    "filter_size": _filtered("size:>=2000"),
    "filter_size_equal": _filtered("size: = 613"),
    "filter_unknown": _filtered("kind:x"),
    "filter_none": _filtered(" "),
    "files_ls": q_files_ls,
    "mime_types": q_mime_types,
    "files_rm": q_files_rm,
    "files_cp": q_files_cp,
    "files_mv": q_files_mv,
    "changes": q_changes,
    "to_read": q_to_read,
    "reappeared": q_reappeared,
    "tombstones": q_tombstones,
    "tombstones_failed_dir": q_tombstones_failed_dir,
    "update_stats": q_update_stats,
    "enrich": q_enrich,
    "mime_histogram": q_mime_histogram,
    "needs_fingerprint": q_needs_fingerprint,
    "diff_status": q_diff_status,
    "diff_copy": q_diff_copy,
    "diff_move": q_diff_move,
    "diff_delete": q_diff_delete,
    "sync_plan": q_sync_plan,
    "sync_mirror": q_sync_mirror,
    "sync_counters": q_sync_counters,
    "sync_log": q_sync_log,
    "text_hash_groups": q_text_hash_groups,
    "content_hash": q_content_hash,
    "hamming_pairs": q_hamming_pairs,
    "hamming_pairs_90": q_hamming_pairs_90,
    "hamming_pairs_80": q_hamming_pairs_80,
    "video_pairs_85": q_video_pairs_85,
    "hamming_clusters": q_hamming_clusters,
    "hamming_clusters_crowded": q_hamming_clusters_crowded,
    "temporal_clusters": q_temporal_clusters,
    "tolerance_clusters": q_tolerance_clusters,
    "find_similar": q_find_similar,
    "canonical_grid": q_canonical_grid,
    "dhash": q_dhash,
    "grid9": q_grid9,
    "formatting": q_formatting,
    "media": q_media,
    "rolling_eta": q_rolling_eta,
    "rolling_eta_hot": q_rolling_eta_hot,
    "report_md": q_report_md,
    "report_html": q_report_html,
    "latest_stream": q_latest_stream,
    "duplicates_stream": q_duplicates_stream,
    "contents_stream": q_contents_stream,
}


def registered(query: Query) -> Query:
    """The query on a session with the settings it is tuned for."""
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return query(configure(spark), sf)
    return run


def all_queries() -> dict[str, Query]:
    return {name: registered(query) for name, query in QUERIES.items()}
