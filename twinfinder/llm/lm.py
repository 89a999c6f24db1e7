"""Scoring texts with a log-bilinear language model.

The vector of a context is the sum of its words' vectors, each weighted by place; the score of a class of words is its
product with the vector of the class. Frequent words are classes of their own, all others fall into classes by their
ending. Within such a class a word has its share of the discounted counts of the training tokens, and what the discount
leaves is the probability of a word that was never seen. So probabilities add up to one over all known words, one
unknown word per ending class, and the end of the text.

Words are counted over all training texts. Vectors are fitted by noise-contrastive estimation: first on a bounded
sample, then every task passes over all training texts of its part, and the tasks' vectors are averaged by tokens after
each round. Scoring multiplies batches of contexts with all class vectors, and normalises exactly.

The counts of the most frequent words (a fixed number) are broadcast. The other words of a text are looked up by a
join, so the vocabulary may have any size.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from twinfinder.session import checkpointed

END = b"\n"  # cannot be a word
HEAD, HEAD_BYTES = 131_072, 48  # most words with broadcast counts, and the longest of them
STEPS = 16  # of a doubling of the count
INPUTS, CLASS_WORDS, ENDINGS = 4096, 192, 64
CONTEXT, DIMS = 4, 16
DISCOUNT = 0.5
# The driver starts the vectors on a sample of about so many tokens, at most WARM_ROWS texts of WARM_LONGEST tokens.
WARM_TOKENS, WARM_ROWS, WARM_LONGEST, WARM_BATCH, WARM_RATE = 500_000, 4000, 4096, 256, 0.3
ROUNDS = 1  # each round passes over all training texts
NOISE, BATCH, RATE = 64, 1024, 0.15
TOGETHER = 65_536  # tokens that are prepared together
HASHES = 1 << 20
HELD_WORDS = 200_000
SAFE = 60.0  # exponents up to here stay far within single precision
SCORED_TOGETHER = 1024  # contexts with scores for all classes at a time


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words, then the end. A-Z only are lower-cased; words are parted by ASCII white space only."""
    return [*(text or "").encode("utf-8", "surrogatepass").lower().split(), END]


def ending(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % ENDINGS


def count_words(texts: DataFrame) -> DataFrame:
    """(word, n) of the one text column of `texts`, summed in every task before they are shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def emit() -> pa.RecordBatch:
            out = {"word": pa.array(list(held), pa.binary()), "n": pa.array(list(held.values()), pa.int64())}
            held.clear()
            return pa.RecordBatch.from_pydict(out)

        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.update(words_of(text))
                if len(held) > HELD_WORDS:
                    yield emit()
        if held:
            yield emit()

    return texts.mapInArrow(count, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Vocabulary:
    """What every task knows: the head's words by count, the totals, and the sums of every ending class."""

    words: tuple[bytes, ...]
    counts: np.ndarray
    tokens: int
    types: int
    class_tokens: np.ndarray  # of the training tokens, per class
    class_types: np.ndarray

    @property
    def singles(self) -> int:
        return min(CLASS_WORDS, len(self.words))

    def class_of(self, word: bytes) -> int:
        return self.singles + ending(word)

    @cached_property
    def tables(self) -> tuple[dict[bytes, int], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the head: numbers of the words, class, input row, log10 share in the class, and base score of each.

        Made once in a worker process, which keeps the broadcast vocabulary for its tasks.
        """
        number = {w: i for i, w in enumerate(self.words)}
        single = self.singles
        classes = np.array([i if i < single else self.class_of(w) for i, w in enumerate(self.words)], dtype=np.int32)
        inputs = np.array([i if i < INPUTS else INPUTS + ending(w) for i, w in enumerate(self.words)], dtype=np.int32)
        within = np.zeros(len(self.words))
        of = classes[single:]
        within[single:] = np.log10((self.counts[single:] - DISCOUNT) / self.class_tokens[of])
        base = np.log10((self.counts + 0.5) / (self.tokens + 0.5 * (self.types + 1)))
        return number, classes, inputs, within, base


def vocabulary(counts: DataFrame) -> Vocabulary:
    """The head and the totals; only HEAD words of at most HEAD_BYTES bytes reach the driver."""
    totals = counts.agg(F.sum("n").alias("tokens"), F.count("*").alias("types")).first()
    short = counts.filter(F.octet_length("word") <= HEAD_BYTES)
    # The least count of a word of the head, by steps of a logarithmic scale: whole steps while they fit.
    step = F.floor(F.log2("n") * STEPS)
    sizes = sorted(short.groupBy(step.alias("step")).agg(F.count("*").alias("words")).collect(), reverse=True)
    least, held = None, 0
    for r in sizes:
        held += r["words"]
        if held > HEAD:
            break
        least = r["step"]
    head = [] if least is None else short.filter(step >= least).collect()
    head.sort(key=lambda r: (-r["n"], bytes(r["word"])))
    words = tuple(bytes(r["word"]) for r in head)
    singles = min(CLASS_WORDS, len(words))

    @F.arrow_udf("int")
    def ending_of(column: pa.Array) -> pa.Array:
        return pa.array([ending(w) for w in column.to_pylist()], pa.int32())

    sums = counts.select("n", ending_of("word").alias("e")).groupBy("e").agg(F.sum("n").alias("n"), F.count("*").alias("t"))
    class_tokens = np.zeros(singles + ENDINGS)
    class_types = np.zeros(singles + ENDINGS)
    for r in sums.collect():
        class_tokens[singles + r["e"]], class_types[singles + r["e"]] = r["n"], r["t"]
    for i, r in enumerate(head[:singles]):  # words that are classes of their own are taken out of their ending's
        class_tokens[i], class_types[i] = r["n"], 1
        class_tokens[singles + ending(words[i])] -= r["n"]
        class_types[singles + ending(words[i])] -= 1
    return Vocabulary(
        words, np.array([r["n"] for r in head], dtype=np.float64), totals["tokens"] or 0, totals["types"],
        class_tokens, class_types,
    )


# --- the model ---------------------------------------------------------------------------------------------------

START = INPUTS + ENDINGS  # the input row of places before the text
ROWS = START + 1


def _rows_summed(at: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers in `at`, and the sum of the rows of `values` for each."""
    at = at.astype(np.uint16)  # rows and classes are fewer than 65,536; so short numbers are sorted by their digits
    order = np.argsort(at, kind="stable")
    at = at[order]
    starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return at[starts].astype(np.int64), np.add.reduceat(values.take(order, axis=0), starts, axis=0)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    np.clip(x, -30, 30, out=x)
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


class LogBilinear:
    """Input vectors, a weight vector per context place, class vectors, and class biases."""

    def __init__(self, classes: int, noise: np.ndarray, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.inputs = rng.normal(0, 0.1, (ROWS, DIMS)).astype(np.float32)
        self.places = np.full((CONTEXT, DIMS), 0.5, dtype=np.float32)
        self.outputs = rng.normal(0, 0.1, (classes, DIMS)).astype(np.float32)
        self.bias = np.log(noise).astype(np.float32)[:, None]

    def parameters(self) -> list[np.ndarray]:
        return [self.inputs, self.places, self.outputs, self.bias]

    def predicted(self, context: np.ndarray) -> np.ndarray:
        """The vector of every context (rows of input numbers, the nearest word first)."""
        found = self.inputs.take(context[:, 0], axis=0) * self.places[0]
        for i in range(1, CONTEXT):
            found += self.inputs.take(context[:, i], axis=0) * self.places[i]
        return found

    def log_probabilities(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural logarithms of the targets' probabilities, normalised over all classes."""
        out = np.empty(len(target))
        # The bias is one more dimension, which is 1 in all contexts.
        classes = np.concatenate([self.outputs, self.bias], axis=1).T
        longest, each = float(np.sqrt((classes**2).sum(axis=0)).max()), np.ones(classes.shape[1], dtype=np.float32)
        vectors = np.ones((SCORED_TOGETHER, DIMS + 1), dtype=np.float32)
        for a in range(0, len(target), SCORED_TOGETHER):
            of = target[a : a + SCORED_TOGETHER]
            vectors[: len(of), :DIMS] = self.predicted(context[a : a + SCORED_TOGETHER])
            scores = vectors[: len(of)] @ classes
            chosen = scores[np.arange(len(of)), of]
            top = np.float32(0)
            # Scores are moved down only where their bound does not keep exponentials within single precision.
            if longest * float(np.sqrt((vectors[: len(of)] ** 2).sum(axis=1)).max()) > SAFE:
                top = scores.max(axis=1)
                scores -= top[:, None]
            np.exp(scores, out=scores)
            out[a : a + SCORED_TOGETHER] = chosen - top - np.log(scores @ each)
        return out

    def train(self, context: np.ndarray, target: np.ndarray, noise: np.ndarray, sums: list[np.ndarray], rng, rate: float = RATE) -> None:
        """One step of noise-contrastive estimation; all tokens of the batch share their noise classes."""
        total = noise.cumsum()
        drawn = np.searchsorted(total / total[-1], rng.random(NOISE), side="right")
        shift = np.log(NOISE * noise).astype(np.float32)
        vectors = self.predicted(context)
        level = self.bias[:, 0] - shift
        of_target, of_drawn = self.outputs.take(target, axis=0), self.outputs.take(drawn, axis=0)
        d_true = _sigmoid(np.einsum("ij,ij->i", vectors, of_target) + level[target]) - 1
        d_false = vectors @ of_drawn.T
        d_false += level[drawn]
        d_false = _sigmoid(d_false)
        back = d_false @ of_drawn
        of_target *= d_true[:, None]
        back += of_target
        places, outputs, bias = (np.zeros_like(p) for p in self.parameters()[1:])
        for i in range(CONTEXT):
            places[i] = np.einsum("ij,ij->j", back, self.inputs.take(context[:, i], axis=0))
        # One row for each token's class and one for each noise class, the gradient of the bias in the last column.
        true_rows = d_true[:, None] * np.concatenate([vectors, np.ones((len(target), 1), dtype=np.float32)], axis=1)
        false_rows = np.concatenate([d_false.T @ vectors, d_false.sum(axis=0)[:, None]], axis=1)
        at, summed = _rows_summed(np.concatenate([target, drawn]), np.concatenate([true_rows, false_rows]))
        outputs[at], bias[at, 0] = summed[:, :DIMS], summed[:, DIMS]
        # Most input vectors are in no context of a batch, and stay.
        rows, inputs = _rows_summed(context.T.ravel(), (back * self.places[:, None, :]).reshape(-1, DIMS))
        every = slice(None)
        for p, g, s, at in zip(self.parameters(), (inputs, places, outputs, bias), sums, (rows, every, every, every)):
            g /= len(target)
            s[at] += g * g
            p[at] -= rate * g / np.sqrt(s[at] + 1e-8)


def numbered(texts: list[list[bytes]], number: dict[bytes, int], classes: np.ndarray, inputs: np.ndarray, singles: int):
    """Of all tokens, text after text: head number (-1 for others), class and context."""
    flat = list(chain.from_iterable(texts))
    n = len(flat)
    at = np.fromiter(map(number.get, flat, repeat(-1)), dtype=np.int64, count=n)
    rare = np.flatnonzero(at < 0)
    target = classes[at] if len(classes) else np.zeros(n, dtype=np.int32)
    source = inputs[at] if len(inputs) else np.zeros(n, dtype=np.int32)
    if len(rare):
        ends = np.fromiter((ending(flat[i]) for i in rare.tolist()), dtype=np.int32, count=len(rare))
        target[rare], source[rare] = singles + ends, INPUTS + ends
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    place = np.arange(n) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    context = np.full((n, CONTEXT), START, dtype=np.int32)
    for i in range(CONTEXT):
        context[i + 1 :, i] = np.where(place[i + 1 :] > i, source[: max(0, n - i - 1)], START)
    return at, target, context


def together(texts: Iterable[str | None]) -> Iterator[list[list[bytes]]]:
    """The tokens of texts, in lists of texts with about TOGETHER tokens; a longer text is alone."""
    held, size = [], 0
    for text in texts:
        held.append(words_of(text))
        size += len(held[-1])
        if size >= TOGETHER:
            yield held
            held, size = [], 0
    if held:
        yield held


def noise_of(v: Vocabulary) -> np.ndarray:
    """Share of every class among the training tokens, never quite zero."""
    share = v.class_tokens + 0.5
    return share / share.sum()


def warm_start(texts: DataFrame, shared, text: str) -> LogBilinear:
    """A model of a bounded sample of the training texts, fitted by the driver."""
    v: Vocabulary = shared.value
    noise = noise_of(v)
    model = LogBilinear(len(noise), noise)

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v: Vocabulary = shared.value
        number, classes, inputs, _, _ = v.tables
        for batch in batches:
            found = [
                numbered([words_of(t)[-WARM_LONGEST:]], number, classes, inputs, v.singles)[1:]
                for t in batch.column(0).to_pylist()
            ]
            yield pa.RecordBatch.from_pydict(
                {"hash": batch.column(1),
                 "target": pa.array([t.astype("<i4").tobytes() for t, _ in found], pa.binary()),
                 "context": pa.array([c.astype("<i4").tobytes() for _, c in found], pa.binary())}
            )

    most = int(HASHES * min(1.0, WARM_TOKENS / max(1, v.tokens)))
    sample = texts.filter(F.col("_hash") < most).select(text, "_hash").mapInArrow(prepare, "hash bigint, target binary, context binary")
    rows = sorted((r["target"], r["context"]) for r in sample.orderBy("hash", "target", "context").limit(WARM_ROWS).collect())
    if rows:
        rng = np.random.default_rng(0)
        target = np.concatenate([np.frombuffer(t, dtype="<i4") for t, _ in rows])
        context = np.concatenate([np.frombuffer(c, dtype="<i4").reshape(-1, CONTEXT) for _, c in rows])
        order = rng.permutation(len(target))
        sums = [np.full_like(p, 1e-3) for p in model.parameters()]
        for a in range(0, len(order), WARM_BATCH):
            at = order[a : a + WARM_BATCH]
            model.train(context[at], target[at], noise, sums, rng, WARM_RATE)
    return model


def fit(texts: DataFrame, shared, text: str) -> LogBilinear:
    """A model of all training `texts` (with `_hash`, a number below HASHES, by which the sample of the start is chosen)."""
    v: Vocabulary = shared.value
    noise = noise_of(v)
    model = warm_start(texts, shared, text)
    columns = [f"w{i}" for i in range(DIMS)]
    schema = "id int, tokens double, " + ", ".join(f"{c} double" for c in columns)

    for _ in range(ROUNDS):
        known = [p.copy() for p in model.parameters()]

        def learn(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            v: Vocabulary = shared.value
            number, classes, inputs, _, _ = v.tables
            noise = noise_of(v)
            mine = LogBilinear(len(noise), noise)
            for p, k in zip(mine.parameters(), known):
                p[...] = k
            sums = [np.full_like(p, 1e-3) for p in mine.parameters()]
            rng, seen = np.random.default_rng(1), 0
            texts = (value for batch in batches for value in batch.column(0).to_pylist())
            for tokens in together(texts):
                _, target, context = numbered(tokens, number, classes, inputs, v.singles)
                for a in range(0, len(target), BATCH):
                    mine.train(context[a : a + BATCH], target[a : a + BATCH], noise, sums, rng)
                seen += len(target)
            if seen:
                rows = np.concatenate([mine.inputs, mine.places, mine.outputs, np.repeat(mine.bias, DIMS, axis=1)]).astype(float)
                out = {"id": pa.array(np.arange(len(rows)), pa.int32()), "tokens": pa.array(np.full(len(rows), float(seen)))}
                yield pa.RecordBatch.from_pydict(out | {c: pa.array(rows[:, i] * float(seen)) for i, c in enumerate(columns)})

        sums = texts.select(text).mapInArrow(learn, schema).groupBy("id").agg(F.sum("tokens").alias("tokens"), *[F.sum(c).alias(c) for c in columns])
        found = sums.toArrow().sort_by("id")  # one row per vector of the model
        if not found.num_rows:
            continue
        mean = np.stack([found[c].to_numpy() for c in columns], axis=1) / found["tokens"].to_numpy()[:, None]
        cuts = np.cumsum([ROWS, CONTEXT, len(noise)])
        model.inputs[...], model.places[...], model.outputs[...], bias = np.split(mean, cuts)
        model.bias[...] = bias[:, :1]
    return model


def score_texts(docs: DataFrame, learn: Column, text: str = "text", doc: str = "doc_id") -> DataFrame:
    """`_id`, `n_tokens`, `n_known`, `train_tokens`, `base_score`, `score` of every row of `docs`.

    The model learns from the rows where `learn` is true. Null texts count as empty, and have one token, the end. Rows
    with equal or null ids are scored each on its own. Without training texts the base is 0 and the model even.
    Other columns of `docs` play no part, so their names cannot clash.
    """
    spark = docs.sparkSession
    part = F.pmod(F.xxhash64(F.col(doc).cast("string"), F.col(text)), F.lit(HASHES)).alias("_hash")
    training = docs.filter(learn).select(F.col(text).alias("_text"), part)
    counts = checkpointed(count_words(training.select("_text")))
    v = vocabulary(counts)
    shared = spark.sparkContext.broadcast(v)
    model = fit(training, shared, "_text")
    fitted = spark.sparkContext.broadcast(model.parameters())

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v: Vocabulary = shared.value
        number, classes, inputs, within, base = v.tables
        mine = LogBilinear(len(v.class_tokens), noise_of(v))
        for p, k in zip(mine.parameters(), fitted.value):
            p[...] = k
        for batch in batches:
            out: dict[str, list] = {"n_tokens": [], "n_known": [], "base": [], "score": [], "rare": []}
            for texts in together(batch.column(1).to_pylist()):
                at, target, context = numbered(texts, number, classes, inputs, v.singles)
                sizes = np.array([len(t) for t in texts])
                starts = np.cumsum(sizes) - sizes  # every text has at least its end
                known = at >= 0
                natural = mine.log_probabilities(context, target) / np.log(10)
                head = np.where(known, at, 0)
                inside = np.where(known, within[head], 0.0) if len(within) else np.zeros(len(at))
                shares = np.where(known, base[head], 0.0) if len(base) else np.zeros(len(at))
                out["n_tokens"] += sizes.tolist()
                out["n_known"] += np.add.reduceat(known.astype(np.int64), starts).tolist()
                out["base"] += np.add.reduceat(shares, starts).tolist()
                out["score"] += np.add.reduceat(natural + inside, starts).tolist()
                rare: list[Counter[bytes]] = [Counter() for _ in texts]
                unknown = np.flatnonzero(~known)
                for i, of in zip(unknown.tolist(), (np.searchsorted(starts, unknown, side="right") - 1).tolist()):
                    rare[of][texts[of][i - starts[of]]] += 1
                out["rare"] += [[{"word": w, "n": n, "class": v.class_of(w)} for w, n in r.items()] for r in rare]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(out[n], t) for n, t in (
                    ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()),
                    ("rare", pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64()), ("class", pa.int32())]))))]],
                names=["_id", "n_tokens", "n_known", "base", "score", "rare"],
            )

    id_type = docs.schema[doc].dataType.simpleString()
    schema = f"_id {id_type}, n_tokens bigint, n_known bigint, base double, score double, rare array<struct<word: binary, n: bigint, class: int>>"
    rows = docs.select(F.col(doc).alias("_id"), F.col(text).alias("_text")).mapInArrow(score, schema)
    rows = checkpointed(rows.withColumn("_row", F.monotonically_increasing_id()))

    rare = rows.select("_row", F.explode("rare").alias("r")).select("_row", "r.word", F.col("r.n").alias("times"), "r.class")
    found = rare.join(counts, "word", "left")
    tokens, types = float(v.tokens), float(v.types)
    sizes = spark.createDataFrame(  # one row per class
        [(i, float(t), float(n)) for i, (t, n) in enumerate(zip(v.class_tokens.tolist(), v.class_types.tolist()))],
        "class int, class_tokens double, class_types double",
    )
    found = found.join(F.broadcast(sizes), "class")
    seen = F.col("n").isNotNull()
    base = F.log10((F.coalesce("n", F.lit(0)) + 0.5) / (tokens + 0.5 * (types + 1)))
    share = F.when(seen, (F.col("n") - DISCOUNT) / F.col("class_tokens"))
    share = share.when(F.col("class_tokens") > 0, DISCOUNT * F.col("class_types") / F.col("class_tokens")).otherwise(1.0)
    extra = found.groupBy("_row").agg(
        F.sum(F.when(seen, F.col("times")).otherwise(0)).alias("_known"),
        F.sum(F.col("times") * base).alias("_base"),
        F.sum(F.col("times") * F.log10(share)).alias("_score"),
    )
    zero = F.lit(0)
    return rows.drop("rare").join(extra, "_row", "left").select(
        "_id",
        "n_tokens",
        (F.col("n_known") + F.coalesce("_known", zero)).alias("n_known"),
        F.lit(v.tokens).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("_base", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("_score", F.lit(0.0))).alias("score"),
    )
