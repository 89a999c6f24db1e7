"""A quality classifier by co-training: two views of a document teach each other.

One classifier sees the text alone (how often each byte value occurs, and measures of words, case and repeated
lines), the other the metadata (language, source, length). Both start from the labelled sample. In every round each
labels the unlabelled documents it is surest about for the other. In the end both are calibrated on labelled
documents that neither has seen, and combined by a logistic model over their log-odds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

# The bounds of the training sample.
LABELLED, UNLABELLED = 4000, 3000
ROUNDS = 4
SURE = 0.97  # a pseudo-label needs at least this probability
PER_ROUND = 0.1  # share of the unlabelled documents that a view may label in a round
HELD_OUT = 4  # every so many-th labelled document is kept for calibration
SOURCE_BUCKETS = 64

LETTERS = np.zeros(256, dtype=bool)
LETTERS[65:91] = LETTERS[97:123] = LETTERS[128:] = True
UPPER = np.zeros(256, dtype=bool)
UPPER[65:91] = True


def text_view(text: str | None) -> list[float]:
    """Features of the whole text; zeros for null and empty texts."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    size = max(1, len(raw))
    shares = np.sqrt(counts / size)
    words, lines = raw.split(), raw.split(b"\n")
    letters = max(1, int(counts[LETTERS].sum()))
    filled = [line for line in lines if line.strip()]
    measures = [
        counts[UPPER].sum() / letters,
        letters / size,
        len(words) / size * 5,
        len(set(words)) / max(1, len(words)),
        1 - len(set(filled)) / max(1, len(filled)),
        np.log1p(len(words)) / 10,
        sum(w.isalpha() and w.isascii() for w in words) / max(1, len(words)),
    ]
    return [*shares.tolist(), *map(float, measures)]


def metadata_view(lang: str | None, source: str | None, n_chars: int | None) -> list[float]:
    """Features of the metadata alone; a null is a value of its own."""
    sources, langs = [0.0] * SOURCE_BUCKETS, [0.0] * 16
    sources[_bucket(source, SOURCE_BUCKETS)] = 1.0
    langs[_bucket(lang, 16)] = 1.0
    size = np.log1p(max(0, n_chars or 0))
    bands = [float(size > edge) for edge in range(3, 13)]
    return [*sources, *langs, *bands, size / 10, float(n_chars is None)]


def _bucket(value: str | None, n: int) -> int:
    if value is None:
        return 0
    h = 2166136261
    for byte in value.encode("utf-8", "surrogatepass"):
        h = (h ^ byte) * 16777619 & 0xFFFFFFFF
    return 1 + (h >> 7) % (n - 1)


@dataclass
class Logistic:
    """Logistic regression on standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip(((x - self.mean) / self.scale) @ self.weights[1:] + self.weights[0], -30, 30)


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> Logistic:
    """Newton steps with a ridge penalty. With labels of one kind only the model is that kind's prior."""
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale < 1e-6, 1.0, scale)
    z = np.hstack([np.ones((len(x), 1)), (x - mean) / scale])
    penalty = np.full(z.shape[1], ridge)
    penalty[0] = 1e-3
    weights = np.zeros(z.shape[1])
    for _ in range(12):
        p = 1 / (1 + np.exp(-np.clip(z @ weights, -30, 30)))
        slope = z.T @ (y - p) - penalty * weights
        curve = (z * (p * (1 - p) + 1e-6)[:, None]).T @ z + np.diag(penalty)
        change = np.linalg.solve(curve, slope)
        weights = weights + change * min(1.0, 5.0 / (np.abs(change).max() + 1e-12))
        if np.abs(change).max() < 1e-4:
            break
    return Logistic(mean, scale, weights)


def probability(log_odds: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-log_odds))


@dataclass
class CoTrained:
    """Both views' classifiers and the model that combines their log-odds."""

    views: list[Logistic]
    combined: Logistic
    pseudo_labels: list[int]

    def score(self, text: np.ndarray, metadata: np.ndarray) -> np.ndarray:
        odds = [m.log_odds(x) for m, x in zip(self.views, (text, metadata))]
        return probability(self.combined.log_odds(np.stack(odds, axis=1)))


def co_train(views: list[np.ndarray], labels: np.ndarray, pool: list[np.ndarray]) -> CoTrained:
    """Two feature tables of the labelled rows, their labels, and the same two tables of the unlabelled rows."""
    held = np.zeros(len(labels), dtype=bool)
    for label in (0, 1):  # both kinds in the same proportion, whatever their order
        held[np.flatnonzero(labels == label)[HELD_OUT - 1 :: HELD_OUT]] = True
    if len(set(labels[held].tolist())) < 2:
        held[:] = False
    known, y = [v[~held] for v in views], labels[~held]
    taught: list[list[np.ndarray]] = [[], []]  # rows of the pool that each view has been given, and their labels
    answers: list[list[np.ndarray]] = [[], []]
    free = [np.ones(len(pool[0]), dtype=bool), np.ones(len(pool[0]), dtype=bool)]
    most = int(PER_ROUND * len(pool[0]))

    def fitted(v: int) -> Logistic:
        rows = np.concatenate([known[v], *[pool[v][r] for r in taught[v]]])
        return fit(rows, np.concatenate([y, *answers[v]]))

    models = [fitted(0), fitted(1)]
    for _ in range(ROUNDS):
        for v, other in ((0, 1), (1, 0)):
            if not len(pool[0]):
                continue
            share = probability(models[v].log_odds(pool[v]))
            sure = np.maximum(share, 1 - share)
            order = np.argsort(-sure, kind="stable")
            chosen = order[(sure[order] >= SURE) & free[other][order]][:most]
            free[other][chosen] = False
            taught[other].append(chosen)
            answers[other].append((share[chosen] > 0.5).astype(float))
        models = [fitted(0), fitted(1)]
    check, truth = ([v[held] for v in views], labels[held]) if held.any() else (known, y)
    odds = np.stack([m.log_odds(x) for m, x in zip(models, check)], axis=1)
    return CoTrained(models, fit(odds, truth.astype(float), ridge=0.1), [sum(map(len, t)) for t in taught])


def training_sample(docs: DataFrame, labels: DataFrame, doc: str, label: str) -> tuple[DataFrame, int]:
    """Ids of at most LABELLED labelled and UNLABELLED other documents with `_label` (null for the others).

    The choice goes by a hash of the id, on narrow columns. An id with several labels counts with the lowest.
    """
    ids = docs.select(F.col(doc).alias("_doc")).filter(F.col("_doc").isNotNull()).distinct()
    known = labels.filter(F.col(label).isNotNull()).groupBy(F.col(doc).alias("_doc")).agg(F.min(label).alias("_label"))
    marked = ids.join(known, "_doc", "left").withColumn("_hash", F.xxhash64("_doc", F.lit(8)))
    parts = [(marked.filter(F.col("_label").isNotNull()), LABELLED), (marked.filter(F.col("_label").isNull()), UNLABELLED)]
    rows = [r for part, most in parts for r in part.orderBy("_hash", "_doc").limit(most).collect()]
    found = docs.sparkSession.createDataFrame(
        [(r["_doc"], None if r["_label"] is None else int(r["_label"])) for r in rows], f"_doc {dict(ids.dtypes)['_doc']}, _label int"
    )
    return found, len(rows)


def features(docs: DataFrame, extra: dict[str, Column], text: str, lang: str, source: str, n_chars: str) -> DataFrame:
    """Both views of every row as `text_view` and `metadata_view`, with the `extra` columns."""
    @F.arrow_udf("array<double>")
    def of_text(column: pa.Array) -> pa.Array:
        return pa.array([text_view(t) for t in column.to_pylist()], pa.list_(pa.float64()))

    @F.arrow_udf("array<double>")
    def of_metadata(a: pa.Array, b: pa.Array, c: pa.Array) -> pa.Array:
        rows = zip(a.to_pylist(), b.to_pylist(), c.to_pylist())
        return pa.array([metadata_view(*r) for r in rows], pa.list_(pa.float64()))

    views = [of_text(F.col(text)).alias("text_view"), _metadata(of_metadata, lang, source, n_chars).alias("metadata_view")]
    return docs.select(*views, *[c.alias(n) for n, c in extra.items()])


def _metadata(udf, lang: str, source: str, n_chars: str) -> Column:
    return udf(F.col(lang).cast("string"), F.col(source).cast("string"), F.col(n_chars).cast("bigint"))


def quality_model(
    docs: DataFrame, labels: DataFrame, doc: str = "doc_id", label: str = "quality", text: str = "text",
    lang: str = "lang", source: str = "source", n_chars: str = "n_chars",
) -> CoTrained | None:
    """Co-trained on a bounded sample; None where there is no label at all."""
    sample, count = training_sample(docs, labels, doc, label)
    rows = docs.join(F.broadcast(sample), F.col(doc) == F.col("_doc"))
    rows = features(rows, {"_label": F.col("_label"), "_doc": F.col("_doc")}, text, lang, source, n_chars)
    # A repeated id may stand for many rows; the bound on the sample holds anyway.
    found = rows.limit(2 * count + 1).toArrow().sort_by("_doc")
    known = np.array([v is not None for v in found["_label"].to_pylist()], dtype=bool)
    if not known.any():
        return None
    views = [np.array(found[n].to_pylist(), dtype=np.float64) for n in ("text_view", "metadata_view")]
    y = np.array([v for v in found["_label"].to_pylist() if v is not None], dtype=np.float64)
    return co_train([v[known] for v in views], y, [v[~known] for v in views])


def quality_of(
    model: CoTrained | None, text: str = "text", lang: str = "lang", source: str = "source", n_chars: str = "n_chars"
) -> Column:
    """Probability that a document is good, from its whole text and its metadata.

    0 for texts that are null or hold no word. 0.5 for all others if there was no label to learn from.
    """
    def score(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for texts, *meta in batches:
            values = texts.to_pylist()
            rows = list(zip(*[m.to_pylist() for m in meta]))
            found = np.full(len(values), 0.5)
            if model is not None and values:
                found = model.score(np.array([text_view(t) for t in values]), np.array([metadata_view(*r) for r in rows]))
            empty = np.array([not (t or "").strip() for t in values], dtype=bool)
            yield pa.array(np.where(empty, 0.0, found), pa.float64())

    return F.arrow_udf(score, "double")(
        F.col(text), F.col(lang).cast("string"), F.col(source).cast("string"), F.col(n_chars).cast("bigint")
    )
