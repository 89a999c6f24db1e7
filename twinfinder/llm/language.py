"""Language identification by a convolutional network over bytes, trained in numpy.

A text is cut into windows of fixed length, which cover it whole. Filters of several widths slide over the bytes of a
window; the highest response of every filter in the window is kept, and a softmax layer turns these into
probabilities. A document gets the mean of its windows, weighted by their bytes.

A filter has one weight per place and byte value. For scoring, the weights of two neighbouring places are summed into
one table by byte pair, so that a window costs a few table reads per byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

WIDTHS = (2, 3, 4)
FILTERS = 16
WINDOW = 256
OVERLAP = max(WIDTHS) - 1
# The bounds of the training sample: documents of each language, and windows of each document.
TRAIN_DOCS, TRAIN_WINDOWS = 1000, 2
EPOCHS, BATCH, RATE = 6, 64, 0.01
SCORED_TOGETHER = 128

UNKNOWN = "und"


def windows(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Windows of WINDOW + OVERLAP bytes that begin every WINDOW bytes, padded with zeros, and their weights."""
    n = max(1, -(-len(text) // WINDOW))
    padded = np.zeros(n * WINDOW + OVERLAP, dtype=np.uint8)
    padded[: len(text)] = np.frombuffer(text, dtype=np.uint8)
    cut = np.lib.stride_tricks.sliding_window_view(padded, WINDOW + OVERLAP)[::WINDOW]
    weights = np.full(n, WINDOW, dtype=np.float64)
    weights[-1] = max(1, len(text) - (n - 1) * WINDOW)
    return cut, weights


class Network:
    """Filter weights per width (place, byte, filter), biases, and the softmax layer."""

    def __init__(self, languages: list[str], seed: int = 0):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.filters = [rng.normal(0, 0.1, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(FILTERS * len(WIDTHS), dtype=np.float32)
        self.dense = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(languages))).astype(np.float32)
        self.offset = np.zeros(len(languages), dtype=np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [*self.filters, self.bias, self.dense, self.offset]

    def _pooled(self, batch: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        values, places = [], []
        for width, table in zip(WIDTHS, self.filters):
            out = sum(table[j][batch[:, j : j + WINDOW]] for j in range(width))
            at = out.argmax(axis=1)
            places.append(at)
            values.append(np.take_along_axis(out, at[:, None, :], axis=1)[:, 0])
        return np.concatenate(values, axis=1) + self.bias, places

    def gradients(self, batch: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
        """Of the mean cross-entropy."""
        pooled, places = self._pooled(batch)
        hidden = np.maximum(pooled, 0)
        share = softmax(hidden @ self.dense + self.offset)
        share[np.arange(len(labels)), labels] -= 1
        share /= len(labels)
        back = (share @ self.dense.T) * (pooled > 0)
        grads = []
        row, filt = np.arange(len(batch))[:, None], np.arange(FILTERS)
        for k, (width, table) in enumerate(zip(WIDTHS, self.filters)):
            grad = np.zeros_like(table)
            mine = back[:, k * FILTERS : (k + 1) * FILTERS]
            for j in range(width):
                np.add.at(grad[j], (batch[row, places[k] + j], filt), mine)
            grads.append(grad)
        return [*grads, back.sum(axis=0), hidden.T @ share, share.sum(axis=0)]

    def pair_table(self) -> np.ndarray:
        """By byte pair: width 2 whole, the first two places of widths 3 and 4, and the last two of width 4."""
        two, three, four = self.filters
        parts = [two[:2], three[:2], four[:2], four[2:]]
        return np.concatenate([(p[0][:, None, :] + p[1][None, :, :]).reshape(1 << 16, FILTERS) for p in parts], axis=1)

    def probabilities(self, cut: np.ndarray, pairs: np.ndarray) -> np.ndarray:
        f, third = FILTERS, self.filters[1][2]
        pooled = np.empty((len(cut), 3 * f), dtype=np.float32)
        for a in range(0, len(cut), SCORED_TOGETHER):
            part = cut[a : a + SCORED_TOGETHER]
            codes = part[:, :-1].astype(np.int32) << 8 | part[:, 1:]
            found = pairs[codes]  # windows x places x tables
            pooled[a : a + len(part), :f] = found[:, :WINDOW, :f].max(axis=1)
            pooled[a : a + len(part), f : 2 * f] = (found[:, :WINDOW, f : 2 * f] + third[part[:, 2 : WINDOW + 2]]).max(axis=1)
            pooled[a : a + len(part), 2 * f :] = (found[:, :WINDOW, 2 * f : 3 * f] + found[:, 2 : WINDOW + 2, 3 * f :]).max(axis=1)
        return softmax(np.maximum(pooled + self.bias, 0) @ self.dense + self.offset)


def softmax(scores: np.ndarray) -> np.ndarray:
    raised = np.exp(scores - scores.max(axis=1, keepdims=True))
    return raised / raised.sum(axis=1, keepdims=True)


def train(cut: np.ndarray, labels: np.ndarray, languages: list[str], seed: int = 0) -> Network:
    """Fit a network to windows with labels. Some windows are shortened on the way, so that short texts are known."""
    network, rng = Network(languages, seed), np.random.default_rng(seed)
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in network.parameters()]
    # Every language counts the same in an epoch, whatever its share of the sample.
    chance = 1.0 / np.maximum(np.bincount(labels, minlength=len(languages)), 1)[labels]
    chance /= chance.sum()
    step = 0
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        chosen = rng.choice(len(cut), len(cut), p=chance)
        for a in range(0, len(cut), BATCH):
            at = chosen[a : a + BATCH]
            batch = cut[at].copy()
            short = np.flatnonzero(rng.random(len(batch)) < 0.4)
            keep = rng.integers(8, WINDOW, len(short))
            batch[short] *= np.arange(batch.shape[1]) < keep[:, None]
            step += 1
            for p, g, (m, v) in zip(network.parameters(), network.gradients(batch, labels[at]), moments):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return network


def training_windows(docs: DataFrame, learn: Column, text: str, lang: str, doc: str) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Windows, labels and languages of a sample of at most TRAIN_DOCS documents of each language.

    Documents are chosen by a hash of their id, on narrow columns; only the chosen texts are then read. The driver
    gets TRAIN_WINDOWS windows of each, from random places of the whole text. Only ids whose hash is among the lowest share
    that surely holds TRAIN_DOCS ids of their language are sorted, so a common language is no burden to one task.
    """
    known = docs.filter(learn & F.col(lang).isNotNull() & F.col(doc).isNotNull())
    order = Window.partitionBy("_lang").orderBy("_hash", "_doc")
    narrow = known.select(F.col(doc).alias("_doc"), F.col(lang).alias("_lang"), F.xxhash64(doc, F.lit(3)).alias("_hash"))
    # One row for each class of the network.
    share = narrow.groupBy("_lang").agg((2.0 * TRAIN_DOCS / F.approx_count_distinct("_doc")).alias("_share"))
    low = (F.col("_hash") / F.lit(2.0**64) + 0.5) <= F.col("_share")
    narrow = narrow.join(F.broadcast(share), "_lang").filter(low).select("_doc", "_lang", "_hash").distinct()
    chosen = narrow.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= TRAIN_DOCS)
    ids = [r["_doc"] for r in chosen.select("_doc").distinct().collect()]
    chosen = docs.sparkSession.createDataFrame([(i,) for i in ids], narrow.select("_doc").schema)
    texts = known.select(F.col(doc).alias("_doc"), F.col(text).alias("_text"), F.col(lang).alias("_lang"))
    texts = texts.join(F.broadcast(chosen), "_doc").select("_text", "_lang")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, langs = [], []
            for value, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not value or not has_letter(value):
                    continue
                raw = value.encode("utf-8", "surrogatepass")
                rng = np.random.default_rng(len(raw))
                for at in rng.integers(0, max(1, len(raw) - WINDOW // 2), TRAIN_WINDOWS).tolist():
                    found.append(raw[at : at + WINDOW + OVERLAP])
                    langs.append(name)
            yield pa.RecordBatch.from_pydict({"window": pa.array(found, pa.binary()), "lang": pa.array(langs, pa.string())})

    # A repeated id may stand for many rows; the bound on the sample holds anyway.
    rows = texts.mapInArrow(cut, "window binary, lang string").limit(2 * TRAIN_WINDOWS * max(1, len(ids))).collect()
    rows = sorted((r["lang"], bytes(r["window"])) for r in rows)
    languages = sorted({lang for lang, _ in rows})
    data = np.zeros((len(rows), WINDOW + OVERLAP), dtype=np.uint8)
    for i, (_, raw) in enumerate(rows):
        data[i, : len(raw)] = np.frombuffer(raw, dtype=np.uint8)
    number = {lang: i for i, lang in enumerate(languages)}
    return data, np.array([number[lang] for lang, _ in rows], dtype=np.int64), languages


def outside_windows(cut: np.ndarray, count: int, seed: int = 0) -> np.ndarray:
    """`count` windows of no language: runs of characters of any script, of letters and digits, of bytes, and windows of
    `cut` with their letters exchanged. Softmax shares alone are high for such texts, whatever the languages."""
    rng, size = np.random.default_rng(seed), WINDOW + OVERLAP
    signs = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_=", dtype=np.uint8)
    out = np.zeros((count, size), dtype=np.uint8)
    for i in range(count):
        spaces = rng.random(size) < rng.choice([0.0, 0.1, 0.2])
        if i % 4 == 0:
            start, width = rng.integers(0x250, 0xC000), int(rng.choice([30, 100, 1000, 8000]))
            codes = np.where(spaces, 32, np.minimum(start + rng.integers(0, width, size), 0xD7FF))
            raw = "".join(map(chr, codes.tolist())).encode()[:size]
            out[i] = np.frombuffer(raw, dtype=np.uint8)
        elif i % 4 == 1:
            drawn = rng.choice(signs, rng.integers(12, len(signs)), replace=False)
            out[i] = np.where(spaces, 32, rng.choice(drawn, size))
        elif i % 4 == 2:
            to, letters = np.arange(256, dtype=np.uint8), rng.permutation(26).astype(np.uint8)
            to[65:91], to[97:123] = 65 + letters, 97 + letters
            out[i] = to[cut[rng.integers(len(cut))]]
        else:
            out[i] = np.where(spaces, 32, rng.integers(1, 256, size))
    return out


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


@lru_cache(maxsize=2)
def _restored(raw: bytes, languages: tuple[str, ...]) -> tuple[Network, np.ndarray]:
    """A network from its parameters, with its pair table; kept for the tasks of a worker."""
    network = Network(list(languages))
    flat, at = np.frombuffer(raw, dtype=np.float32), 0
    for p in network.parameters():
        p[...] = flat[at : at + p.size].reshape(p.shape)
        at += p.size
    return network, network.pair_table()


def predict(texts: list[str | None], network: Network, pairs: np.ndarray) -> tuple[list[str], list[float]]:
    """Language and probability of every whole text."""
    langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    if not network.languages:
        return langs, scores
    open_rows = [i for i, t in enumerate(texts) if t and has_letter(t)]

    def score(rows: list[int], cuts: list[np.ndarray], weights: list[np.ndarray]) -> None:
        share = network.probabilities(np.concatenate(cuts), pairs) * np.concatenate(weights)[:, None]
        starts = np.cumsum([0, *[len(w) for w in weights]])[:-1]
        total = np.add.reduceat(share, starts) / np.array([w.sum() for w in weights])[:, None]
        for i, best, value in zip(rows, total.argmax(axis=1).tolist(), total.max(axis=1).tolist()):
            langs[i], scores[i] = network.languages[best], min(1.0, float(value))

    held: tuple[list, list, list] = ([], [], [])
    for i in open_rows:
        cut, weight = windows(texts[i].encode("utf-8", "surrogatepass"))
        for group, item in zip(held, (i, cut, weight)):
            group.append(item)
        if sum(map(len, held[2])) > 4096:
            score(*held)
            held = ([], [], [])
    if held[0]:
        score(*held)
    return langs, scores


def language_model(
    docs: DataFrame, learn: Column, text: str = "text", lang: str = "lang", doc: str = "doc_id", outside: bool = False
) -> Network:
    """A network trained on the rows where `learn` holds; without any it knows no language.

    With `outside` it also learns from made windows what is in no language, and then may answer `und` with a score.
    """
    data, labels, languages = training_windows(docs, learn, text, lang, doc)
    if outside and languages:
        made = outside_windows(data, -(-len(data) // len(languages)))
        if UNKNOWN not in languages:
            languages = [*languages, UNKNOWN]
        data = np.concatenate([data, made])
        labels = np.concatenate([labels, np.full(len(made), languages.index(UNKNOWN))])
    return train(data, labels, languages) if languages else Network([])


def language_of(network: Network, text: Column | str) -> Column:
    """struct<lang, score> of a text column, from the text alone.

    `und` with score 0 for null texts, texts without a letter, and a network that knows no language. Texts of any
    length are scored whole.
    """
    raw = b"".join(p.astype(np.float32).tobytes() for p in network.parameters())
    names = tuple(network.languages)

    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        restored, pairs = _restored(raw, names)
        for batch in batches:
            langs, scores = predict(batch.to_pylist(), restored, pairs)
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang", "score"])

    return F.arrow_udf(score, "lang string, score double")(text)
