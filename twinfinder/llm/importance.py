"""Importance resampling towards a target: hashed n-gram weights, Gumbel keys, and a distributed quickselect.

Texts become words on byte arrays: the CRC of every word is taken for many words at a time, and the CRC of a run of
words follows from those of its words, since appending bytes is linear over bits. Features fall into buckets by CRC.
Counts of the buckets over both whole tables give one gain per bucket; the weight of a document is the sum over its
features, looked up in that array.

The k best of all documents are found without sorting them: a few random pivot keys are drawn from the interval that
must hold the k-th key, exact counts of what is before, equal to and behind each pivot narrow the interval, until the
k-th key itself is hit. Only what is drawn is sorted, and ranked.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from twinfinder.llm.common import slices
from twinfinder.plans.numbering import numbered
from twinfinder.session import checkpointed

LONGEST_RUN = 3
PIVOTS = 24  # pivot keys in a round
SHORT_WORD = 48  # words of up to so many bytes are hashed many at a time
BLOCK_BYTES = 1_000_000  # longer texts are worked on in blocks


# --- features ----------------------------------------------------------------------------------------------------


def _byte_tables() -> tuple[np.ndarray, np.ndarray]:
    """Lower case of every byte (A-Z only), and whether it belongs to words."""
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    word = np.zeros(256, dtype=bool)
    word[48:58] = word[97:123] = word[65:91] = word[128:] = True
    return lower, word


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, np.uint32(0xEDB88320) ^ (table >> 1), table >> 1)
    return table


LOWER, IN_WORD = _byte_tables()
CRC = _crc_table()


def _append_tables(longest: int) -> np.ndarray:
    """By length, byte place and byte: what a register byte becomes when so many zero bytes follow."""
    tables = np.empty((longest + 1, 4, 256), dtype=np.uint32)
    tables[0] = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32)[:, None])
    for n in range(longest):
        tables[n + 1] = CRC[tables[n] & 255] ^ (tables[n] >> 8)
    return tables


APPEND = _append_tables(SHORT_WORD)


def _appended(crc: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The part of `crc` in the CRC of a text that goes on for `lengths` bytes (at most SHORT_WORD)."""
    found = APPEND[lengths, 0, crc & 255] ^ APPEND[lengths, 1, crc >> 8 & 255]
    return found ^ APPEND[lengths, 2, crc >> 16 & 255] ^ APPEND[lengths, 3, crc >> 24]


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of every word in an array of bytes."""
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = IN_WORD[data]
    edges = np.diff(inside)
    starts = np.flatnonzero(edges == 1)
    return starts, np.flatnonzero(edges == -1) - starts


def word_crcs(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The CRC of every word of lower-cased `data`."""
    crcs = np.zeros(len(starts), dtype=np.uint32)
    order = np.argsort(-np.minimum(lengths, SHORT_WORD + 1), kind="stable")
    longer = int((lengths > SHORT_WORD).sum())
    for at in order[:longer].tolist():
        crcs[at] = zlib.crc32(data[starts[at] : starts[at] + lengths[at]])
    order = order[longer:]
    left = len(order) - np.cumsum(np.bincount(lengths[order], minlength=SHORT_WORD + 1))  # words longer than n bytes
    register = np.full(len(order), 0xFFFFFFFF, dtype=np.uint32)
    begin = starts[order]
    for n in range(SHORT_WORD):
        open_ = int(left[n])
        if not open_:
            break
        head = register[:open_]
        register[:open_] = CRC[(head ^ data[begin[:open_] + n]) & 255] ^ (head >> 8)
    crcs[order] = ~register
    return crcs


def run_crcs(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
    """CRCs of all runs of 1, 2, … words that begin at each word, as if all words were one text."""
    words = word_crcs(data, starts, lengths)
    runs = [words]
    space = np.uint32(zlib.crc32(b" "))
    long = lengths > SHORT_WORD
    for n in range(2, LONGEST_RUN + 1):
        if len(words) < n:
            runs.append(np.zeros(0, dtype=np.uint32))
            continue
        before = runs[-1][: len(words) - n + 1]
        spaced = _appended(before, np.ones(len(before), dtype=np.int64)) ^ space
        last = np.arange(n - 1, len(words))
        found = _appended(spaced, np.minimum(lengths[last], SHORT_WORD)) ^ words[last]
        for at in np.flatnonzero(long[last]).tolist():  # a long last word goes on from the register of what is before
            end = starts[last[at]]
            found[at] = zlib.crc32(data[end : end + lengths[last[at]]], int(spaced[at]))
        runs.append(found)
    return runs


_TWO_MORE = re.compile(rb"(?:[^0-9A-Za-z\x80-\xff]*[0-9A-Za-z\x80-\xff]+){0,2}")
_GAP = re.compile(rb"[^0-9A-Za-z\x80-\xff]")


def blocks_of(texts: list[str]) -> Iterator[tuple[bytes, int, np.ndarray, np.ndarray]]:
    """Blocks of bytes: how many of them count, where texts begin in them, and the numbers of the texts.

    Short texts share a block, with a byte between them that is in no word. A long text is cut between words; each of
    its blocks ends with two more words, so that runs which begin before the cut are whole.
    """
    for first, end in slices(texts, BLOCK_BYTES):
        raw = [t.encode("utf-8", "surrogatepass") for t in texts[first:end]]
        if len(raw) > 1 or len(raw[0]) <= BLOCK_BYTES:
            starts = np.cumsum([0] + [len(r) + 1 for r in raw[:-1]])
            joined = b"\0".join(raw)
            yield joined, len(joined), starts, np.arange(first, end)
            continue
        text, at = raw[0], 0
        while at < len(text):
            gap = _GAP.search(text, at + BLOCK_BYTES)
            cut = gap.start() if gap else len(text)
            stop = _TWO_MORE.match(text, cut).end()
            yield text[at:stop], cut - at, np.zeros(1, dtype=np.int64), np.array([first])
            at = cut


def features(texts: list[str], buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """In blocks: numbers of the texts, their words in this block, and of all features the text's place and bucket."""
    for raw, counted, begins, numbers in blocks_of(texts):
        data = LOWER[np.frombuffer(raw, dtype=np.uint8)]
        starts, lengths = word_spans(data)
        place = np.searchsorted(begins, starts, side="right") - 1
        own = starts < counted
        words = np.bincount(place[own], minlength=len(numbers))
        owners, found = [], []
        for n, crcs in enumerate(run_crcs(data, starts, lengths)):
            head = place[: len(crcs)]
            whole = (head == place[n : n + len(crcs)]) & own[: len(crcs)]
            owners.append(head[whole])
            found.append(crcs[whole] % buckets)
        yield numbers, words, np.concatenate(owners), np.concatenate(found)


# --- counts and weights ------------------------------------------------------------------------------------------


def bucket_counts(docs: DataFrame, text: str, buckets: int) -> np.ndarray:
    """How many features of all texts fall into each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            texts = [t or "" for t in batch.column(0).to_pylist()]
            for _, _, _, bucket in features(texts, buckets):
                held += np.bincount(bucket, minlength=buckets)
        used = np.flatnonzero(held)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(used, pa.int32()), "n": pa.array(held[used])})

    found = docs.select(F.col(text).alias("_text")).mapInArrow(count, "bucket int, n bigint")
    counts = np.zeros(buckets, dtype=np.int64)
    for row in found.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[row["bucket"]] = row["n"]
    return counts


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A thousand times the logarithm of the smoothed ratio of target to source, rounded down, for every bucket."""
    buckets = len(source)
    all_source, all_target = float(source.sum()) + buckets, float(target.sum()) + buckets
    ratios = ((t + 1.0) * all_source / ((s + 1.0) * all_target) for s, t in zip(source.tolist(), target.tolist()))
    return np.array([floor(1000 * log(r)) for r in ratios], dtype=np.int64)


def weighted(docs: DataFrame, doc: str, text: str, gain: np.ndarray) -> DataFrame:
    """`doc`, `n_words`, `n_features` and `weight` of every row."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            words, number, weight = (np.zeros(len(texts), dtype=np.int64) for _ in range(3))
            for at, found, place, bucket in features(texts, len(gain)):
                words[at] += found
                number[at] += np.bincount(place, minlength=len(at))
                # Sums of whole numbers below 2^53 are exact in doubles.
                weight[at] += np.bincount(place, weights=gain[bucket], minlength=len(at)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(words), pa.array(number), pa.array(weight)], ["doc", "n_words", "n_features", "weight"]
            )

    kind = docs.schema[doc].dataType.simpleString()
    rows = docs.select(F.col(doc).alias("_doc"), F.col(text).alias("_text"))
    return rows.mapInArrow(weigh, f"doc {kind}, n_words bigint, n_features bigint, weight bigint")


def gumbel(doc: Column, seed: int) -> Column:
    """A seeded Gumbel variate of an id, in thousandths, rounded down."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc.cast("string"), F.lit("")))
    number = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((number + 0.5) / 4294967296.0)))


# --- selection ---------------------------------------------------------------------------------------------------


def select_kth(rows: DataFrame, names: list[str], copies: str, k: int, seed: int = 0) -> tuple[Column, int] | None:
    """The composite key (a literal struct) of the k-th row, from 1, and how many rows are before that key.

    `rows` is a stored table ordered by its null-free columns `names`; `copies` says how many rows each one stands
    for. None if there are fewer than k. Each round draws PIVOTS keys at random from the interval that holds the k-th
    one and counts exactly what lies before, at and behind each; n rows take about log(n) / log(PIVOTS) rounds.
    Pivots and their counts are all that reaches the driver.
    """
    kinds = [rows.schema[n].dataType for n in names]
    key = F.struct(*names)

    def literal(values: tuple) -> Column:
        return F.struct(*[F.lit(v).cast(t).alias(n) for n, t, v in zip(names, kinds, values)])

    inside, before, turn = rows, 0, 0
    while True:
        drawn = inside.select(*names).orderBy(F.xxhash64(F.lit(seed), F.lit(turn), *names)).limit(PIVOTS)
        pivots = sorted({tuple(r) for r in drawn.collect()})
        if not pivots:
            return None
        known = F.array(*map(literal, pivots))
        passed = F.size(F.filter(known, lambda p: p < key)).alias("passed")
        met = F.size(F.filter(known, lambda p: p == key)).alias("met")
        found = inside.groupBy(passed, met).agg(F.sum(copies).alias("n")).collect()
        counts = {(r["passed"], r["met"]): r["n"] for r in found}
        for place in range(len(pivots) + 1):
            between, same = counts.get((place, 0), 0), counts.get((place, 1), 0)
            if k <= before + between:
                break
            before += between
            if k <= before + same:
                return literal(pivots[place]), before
            before += same
        else:
            return None
        # The interval between two pivots; the bounds of the first column let the scan skip row groups.
        if place > 0:
            inside = inside.filter((key > literal(pivots[place - 1])) & (F.col(names[0]) >= F.lit(pivots[place - 1][0])))
        if place < len(pivots):
            inside = inside.filter((key < literal(pivots[place])) & (F.col(names[0]) <= F.lit(pivots[place][0])))
        turn += 1


def resample(
    docs: DataFrame, target: DataFrame, doc: str = "doc_id", text: str = "text", target_text: str = "text",
    percent: int = 5, min_words: int = 20, buckets: int = 10_000, seed: int = 42,
) -> DataFrame:
    """One row per row of `docs`: `doc`, `n_features`, `weight`, `score`, and `rank` (null if not drawn).

    Words are runs of ASCII letters and digits and of all characters beyond ASCII, with A-Z lower-cased; features are
    the runs of one to three of them. Of the rows with at least `min_words` words, `percent` in a hundred (rounded
    down) are drawn, those with the highest score, ties to the smaller id, null ids last. Null and empty texts have no
    features and weight 0. Repeated rows are rows of their own: they share a score and get ranks one after the other;
    equal rows are counted before they are sorted, so they cost one. Rows of one id with different texts go by weight,
    then by fewer features. Empty tables give no rows, an empty target is a flat one. Other columns play no part.
    """
    gain = gains(bucket_counts(docs, text, buckets), bucket_counts(target, target_text, buckets))
    rows = weighted(docs, doc, text, gain).withColumn("score", (F.col("weight") + gumbel(F.col("doc"), seed)).cast("bigint"))
    # Ascending, null-free keys: highest score first.
    rows = rows.withColumns({
        "_score": -F.col("score"), "_null": F.col("doc").isNull(), "_weight": -F.col("weight"),
        "_fits": F.col("n_words") >= min_words,
    })
    kind = docs.schema[doc].dataType
    filler = F.lit("" if kind.simpleString() == "string" else 0).cast(kind)
    rows = rows.withColumn("_doc", F.coalesce("doc", filler))
    keys = ["_score", "_null", "_doc", "_weight", "n_features"]
    stored = checkpointed(rows.groupBy("doc", "weight", "score", "_fits", *keys).agg(F.count("*").alias("_copies")))
    eligible = stored.filter("_fits")
    total = eligible.agg(F.coalesce(F.sum("_copies"), F.lit(0)).alias("n")).first()["n"]
    k = percent * total // 100
    last = select_kth(eligible, keys, "_copies", k) if k else None
    shown = ["doc", "n_features", "weight", "score"]
    every = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_copies")))
    if last is None:
        return stored.withColumn("_copy", every).select(*shown, F.lit(None).cast("bigint").alias("rank"))
    before, same = F.struct(*keys) < last[0], F.struct(*keys) == last[0]
    # Of the rows with the last key, only as many as are missing are drawn.
    drawn = F.when(F.col("_fits") & before, F.col("_copies")).when(F.col("_fits") & same, F.lit(k - last[1]))
    copies = stored.withColumn("_drawn", F.coalesce(drawn, F.lit(0)))
    winners = copies.filter("_drawn > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_drawn"))))
    ranked = numbered(winners, [F.col(c) for c in [*keys, "_copy"]], "_number")
    losers = copies.withColumn("_copies", F.col("_copies") - F.col("_drawn")).filter("_copies > 0").withColumn("_copy", every)
    return ranked.select(*shown, (F.col("_number") + 1).alias("rank")).unionByName(
        losers.select(*shown, F.lit(None).cast("bigint").alias("rank"))
    )
