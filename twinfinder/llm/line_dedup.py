"""Line dedup: every line stays in the first document that holds it, as a bitmap of the lines to keep.

Only hashes travel. Each line that is long enough becomes a 128-bit hash of its key with its document and position.
These narrow rows are range-partitioned by hash and sorted within by document and position; a frame that runs from the
start of a hash to the current row streams over them and compares each row with the first one, holding no group. What
comes out is one bitmap per document, in words of 64 lines; words that keep all of their lines are left out.

A line that holds a large share of all rows is not sent through the shuffle at all: its first document is a minimum,
which is aggregated before it is shuffled and broadcast back. There are at most a few such lines for every partition.

All columns are computed by Spark's own functions.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window, functions as F

from twinfinder.plans.skew import find_hot_keys
from twinfinder.session import checkpointed

BLANK = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORD = 64
# A line is hot if it alone has more than this part of an average partition's rows, and more than FEWEST rows.
HOT_PART, FEWEST = 1 / 4, 256
LOOKED_AT = 4_000_000  # rows, about, that are sampled in the search for hot lines
_HASH = ["_h1", "_h2"]


def lines_of(text: Column) -> Column:
    """The lines of a text; a null or empty text has one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """A line without ASCII white space at both ends, with A-Z lower-cased."""
    return F.translate(F.trim(line, F.lit(BLANK)), UPPER, UPPER.lower())


def row_id(doc: Column, text: Column) -> Column:
    """Tells rows of one document id with different texts apart."""
    return F.xxhash64(doc.cast("string"), text)


def hashed_lines(docs: DataFrame, doc: str = "doc_id", text: str = "text", min_chars: int = 10) -> DataFrame:
    """One narrow row (`_h1`, `_h2`, `_doc`, `_row`, `_pos`) for every line whose key has `min_chars` code points."""
    rows = docs.select(F.col(doc).alias("_doc"), row_id(F.col(doc), F.col(text)).alias("_row"), F.col(text).alias("_text"))
    rows = rows.select("_doc", "_row", F.posexplode(lines_of(F.col("_text"))).alias("_pos", "_line"))
    # Lower-casing A-Z keeps the length, so short lines go before the costlier half of the key.
    rows = rows.filter(F.length(F.trim(F.col("_line"), F.lit(BLANK))) >= min_chars)
    rows = rows.select("_doc", "_row", "_pos", line_key(F.col("_line")).alias("_key"))
    return rows.select(F.xxhash64("_key").alias("_h1"), F.xxhash64(F.lit(1), F.col("_key")).alias("_h2"), "_doc", "_row", "_pos")


def repeated_lines(lines: DataFrame) -> DataFrame:
    """The (`_row`, `_doc`, `_pos`) of `lines` (a stored table) that are not in the first document of their hash."""
    spark = lines.sparkSession
    total = lines.count()
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    most = max(FEWEST, ceil(total * HOT_PART / partitions))
    # Sampled finely enough that a hot line has a few dozen rows in the sample.
    share = min(1.0, max(LOOKED_AT / max(total, 1), 64 / most))
    hot = find_hot_keys(lines, _HASH, rows_per_task=most, sample=share)
    cold, large = hot.split(lines) if hot else (lines, None)
    in_order = Window.partitionBy(*_HASH).orderBy(F.col("_doc").asc_nulls_last(), "_row", "_pos")
    first = F.first("_doc").over(in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranged = cold.repartitionByRange(*_HASH).withColumn("_first", first)
    found = ranged.filter(~F.col("_doc").eqNullSafe(F.col("_first"))).select("_row", "_doc", "_pos")
    if large is None:
        return found
    known = F.struct(F.col("_doc").isNull().alias("unknown"), F.col("_doc").alias("doc"))
    firsts = checkpointed(large.groupBy(*_HASH).agg(F.min(known).alias("_first")))
    again = large.join(F.broadcast(firsts), _HASH).filter(~F.col("_doc").eqNullSafe(F.col("_first.doc")))
    return found.unionByName(again.select("_row", "_doc", "_pos"))


def keep_bitmaps(docs: DataFrame, doc: str = "doc_id", text: str = "text", min_chars: int = 10) -> DataFrame:
    """Documents that lose lines: `_doc`, `_row` (see `row_id`), `n_dropped` and `keep`.

    `keep` is array<struct<word int, bits bigint>> in the order of `word`: bit b of word w is 0 if line 64 w + b goes
    and 1 if it stays; a word that is left out keeps all its lines. Documents that lose nothing have no row.

    A line whose key (see `line_key`) has at least `min_chars` code points stays in the smallest `doc` that holds it,
    as often as it is there, and goes from all others. Rows of one id are one document; null ids are one document that
    comes after all others. Repeated rows give one bitmap. Lines are compared by 128 bits of hash. Other columns of
    `docs` play no part. An empty table gives none.
    """
    gone = repeated_lines(checkpointed(hashed_lines(docs, doc, text, min_chars)))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("_pos") % WORD)
    words = gone.groupBy("_row", "_doc", F.floor(F.col("_pos") / WORD).cast("int").alias("word"))
    words = words.agg(F.bitwise_not(F.bit_or(bit)).alias("bits"))
    return words.groupBy("_row", "_doc").agg(
        F.sum(WORD - F.bit_count("bits")).cast("bigint").alias("n_dropped"),
        F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("keep"),
    )


def kept_text(text: Column, keep: Column) -> Column:
    """The lines that a bitmap keeps, joined by line breaks; the whole text where there is no bitmap."""
    whole = F.coalesce(text, F.lit(""))
    # All words up to the last that drops something, so that each line finds its own by place.
    before = F.transform(keep, lambda w, i: w["word"] - F.coalesce(F.get(keep, i - 1)["word"], F.lit(-1)) - 1)
    dense = F.flatten(F.zip_with(keep, before, lambda w, gap: F.concat(F.array_repeat(F.lit(-1).cast("bigint"), gap), F.array(w["bits"]))))
    # One struct per text, so that lines look into the words without working them out again.
    parts = F.array(F.struct(lines_of(text).alias("lines"), dense.alias("words")))

    def join(part: Column) -> Column:
        def stays(_: Column, at: Column) -> Column:
            word = F.get(part["words"], F.floor(at / WORD).cast("int"))
            return F.coalesce(F.getbit(word, at % WORD) == 1, F.lit(True))

        return F.array_join(F.filter(part["lines"], stays), "\n")

    return F.when(keep.isNull(), whole).otherwise(F.get(F.transform(parts, join), F.lit(0)))


def with_bitmaps(docs: DataFrame, doc: str = "doc_id", text: str = "text", min_chars: int = 10) -> DataFrame:
    """Every row of `docs` (as struct `_in`) with `n_lines`, `n_dropped` and `keep` (null if it keeps all)."""
    found = keep_bitmaps(docs, doc, text, min_chars).withColumnRenamed("_doc", "_of").withColumnRenamed("_row", "_at")
    rows = docs.select(F.struct("*").alias("_in"), F.col(doc).alias("_doc"), F.col(text).alias("_text"))
    rows = rows.withColumn("_row", row_id(F.col("_doc"), F.col("_text")))
    joined = rows.join(found, (F.col("_row") == F.col("_at")) & F.col("_doc").eqNullSafe(F.col("_of")), "left")
    n_lines = F.length(F.coalesce("_text", F.lit(""))) - F.length(F.replace(F.coalesce("_text", F.lit("")), F.lit("\n"), F.lit(""))) + 1
    return joined.select(
        "_in", n_lines.cast("bigint").alias("n_lines"), F.coalesce("n_dropped", F.lit(0)).cast("bigint").alias("n_dropped"), "keep"
    )
