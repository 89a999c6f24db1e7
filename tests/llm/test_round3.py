"""Importance resampling, line dedup and ball k-means codes against brute force, and odd cases of earlier operators."""

import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from twinfinder.llm import ball_codes, bpe, chat, digest, importance, language, line_dedup, mixing, quality, url_reputation
from twinfinder.llm.queries import QUERIES
from twinfinder.llm.settings import RANKS

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
A_TO_Z = {c: c + 32 for c in range(65, 91)}


def empty(df):
    return df.filter("false")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, one id with two texts, and columns whose names operators use."""
    rng = random.Random(9)
    words = ["Straße", "the", "A1", "x" * 60, "of", "naïve", "é" * 40, "to", "END", "line"]
    texts = ["\n".join(" ".join(rng.choices(words, k=rng.randint(0, 9))) for _ in range(rng.randint(1, 150))) for _ in range(40)]
    data = [(i, t) for i, t in enumerate(texts)]
    data += [(100, None), (101, ""), (102, "   "), (None, texts[3]), (None, "a b\r\nthe same long line \n"), (103, "\n\n"),
             (104, "THE same long line\t\n no"), (105, "the same long line"), (106, "words " * 40_000)]
    data += [(107, texts[0])] * 3 + [(108, texts[1]), (108, texts[2])] + [(109, "one very common line here")] * 30
    docs = spark.createDataFrame(data, "doc_id long, text string")
    return docs.withColumn("score", F.lit("mine")).withColumn("_row", F.lit(1)).withColumn("weight", F.lit(None).cast("int"))


# --- 11


def runs(text):
    words = WORD.findall((text or "").translate(A_TO_Z))
    return words, [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def test_features_of_blocks_and_long_words(monkeypatch):
    rng = random.Random(5)
    texts = ["".join(rng.choice("aB9é .\n-\U0001f642") for _ in range(rng.randint(0, 400))) for _ in range(60)]
    texts += ["", "y" * 500 + " z", " ".join(["w" * 70] * 30), "-", "one"]
    for size in (1_000_000, 90):
        monkeypatch.setattr(importance, "BLOCK_BYTES", size)
        words, found = [0] * len(texts), [[] for _ in texts]
        for at, n, place, bucket in importance.features(texts, 997):
            for i, count in zip(at.tolist(), n.tolist()):
                words[i] += count
            for p, b in zip(place.tolist(), bucket.tolist()):
                found[at[p]].append(b)
        for text, n, buckets in zip(texts, words, found):
            plain, grams = runs(text)
            assert n == len(plain)
            assert sorted(buckets) == sorted(zlib.crc32(g.encode()) % 997 for g in grams)


def resampled(rows, target, percent=5, least=20):
    source, aim = [0] * 10000, [0] * 10000
    grams = [[zlib.crc32(g.encode()) % 10000 for g in runs(t)[1]] for _, t in rows]
    for g in grams:
        for b in g:
            source[b] += 1
    for t in target:
        for g in runs(t)[1]:
            aim[zlib.crc32(g.encode()) % 10000] += 1
    s, t = sum(source) + 10000, sum(aim) + 10000
    gain = [math.floor(1000 * math.log((a + 1) * s / ((b + 1) * t))) for a, b in zip(aim, source)]
    found = []
    for (doc, text), g in zip(rows, grams):
        h = int(hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in g)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        found.append((doc, len(g), weight, score, len(runs(text)[0])))
    fit = sorted((r for r in found if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, -r[2], r[1]))
    drawn = fit[: percent * len(fit) // 100]
    ranked = [(*r[:4], i + 1) for i, r in enumerate(drawn)]
    rest = [(*r[:4], None) for r in found if r[4] < least] + [(*r[:4], None) for r in fit[len(drawn) :]]
    return sorted(map(repr, ranked + rest))


@pytest.mark.parametrize("percent", [5, 60, 100, 0])
def test_resampling_of_odd_rows(spark, odd, percent):
    target = spark.createDataFrame([("the line of naïve",), (None,), ("",), ("END of the line",)], "text string")
    found = importance.resample(odd, target, percent=percent).select("doc", "n_features", "weight", "score", "rank")
    want = resampled([(r["doc_id"], r["text"]) for r in odd.collect()], [r["text"] for r in target.collect()], percent)
    assert sorted(repr(tuple(r)) for r in found.collect()) == want


def test_resampling_of_empty_tables(spark, odd):
    target = spark.createDataFrame([("the line",)], "text string")
    assert importance.resample(empty(odd), target).count() == 0
    assert importance.resample(odd, empty(target)).count() == odd.count()


def test_kth_key_with_repeated_rows(spark):
    rng = random.Random(3)
    data = [(rng.randint(0, 40), rng.randint(0, 5), rng.randint(1, 50)) for _ in range(900)] + [(7, 9, 100_000)]
    rows = spark.createDataFrame(data, "a long, b int, n long")
    flat = sorted((a, b) for a, b, n in data for _ in range(n))
    for k in (1, 17, 5_000, len(flat) // 2, len(flat)):
        key, before = importance.select_kth(rows, ["a", "b"], "n", k)
        found = tuple(spark.range(1).select(key.alias("k")).first()["k"])
        assert found == flat[k - 1] and before == flat.index(found)
    assert importance.select_kth(rows, ["a", "b"], "n", len(flat) + 1) is None


# --- 12


def deduplicated(rows):
    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").translate(A_TO_Z)

    order = {None: math.inf}
    first = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            first[key(line)] = min(first.get(key(line), math.inf), order.get(doc, doc))
    found = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or first[key(x)] == order.get(doc, doc)]
        found.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(map(repr, found))


@pytest.mark.parametrize("fewest", [256, 2])  # 2: nearly all repeated lines are hot
def test_line_dedup_of_odd_rows(spark, odd, monkeypatch, fewest):
    monkeypatch.setattr(line_dedup, "FEWEST", fewest)
    monkeypatch.setattr(line_dedup, "HOT_PART", 0.0 if fewest == 2 else line_dedup.HOT_PART)
    text = line_dedup.kept_text(F.col("_in.text"), F.col("keep"))
    found = line_dedup.with_bitmaps(odd).select("_in.doc_id", "n_lines", "n_dropped", text.alias("kept"))
    assert sorted(repr(tuple(r)) for r in found.collect()) == deduplicated([(r["doc_id"], r["text"]) for r in odd.collect()])


def test_line_dedup_bitmaps(spark):
    lines = [f"this is line {i}" for i in range(200)]
    docs = spark.createDataFrame([("a", "\n".join(lines[150:])), ("b", "\n".join(lines)), ("c", "own line\nof c")], "doc_id string, text string")
    found = line_dedup.keep_bitmaps(docs).collect()
    assert [(r["_doc"], r["n_dropped"]) for r in found] == [("b", 50)]
    words = {w["word"]: w["bits"] for w in found[0]["keep"]}
    assert set(words) == {2, 3}  # words 0 and 1 keep all of their lines and are left out
    assert [64 * w + b for w in words for b in range(64) if not words[w] >> b & 1] == list(range(150, 200))
    assert line_dedup.keep_bitmaps(empty(docs)).count() == 0


# --- 13


def lloyd(rows, parts, entries, rounds):
    rows = sorted(rows, key=lambda r: r[0])
    vectors = np.floor(np.array([r[2] for r in rows], dtype=float) * 4096).astype(np.int64)
    width = -(-vectors.shape[1] // parts)
    cut = np.pad(vectors, ((0, 0), (0, parts * width - vectors.shape[1]))).reshape(len(rows), parts, width)
    books = cut[:entries].transpose(1, 0, 2).copy()

    def nearest():
        distance = ((cut[:, :, None, :] - books[None]) ** 2).sum(axis=3)
        return distance.argmin(axis=2), distance.min(axis=2).sum(axis=1)

    for _ in range(rounds):
        codes, _ = nearest()
        for p in range(parts):
            for e in range(books.shape[1]):
                members = cut[codes[:, p] == e, p]
                if len(members):
                    books[p, e] = members.sum(axis=0) // len(members)
    codes, errors = nearest()
    labels = {}
    for row, error in zip(rows, errors.tolist()):
        labels[row[1]] = labels.get(row[1], 0) + error
    return books, sorted(
        repr((row[0], row[1], "".join(f"{c:02x}" for c in code), error, labels[row[1]]))
        for row, code, error in zip(rows, codes.tolist(), errors.tolist())
    )


@pytest.mark.parametrize("dims", [16, 13])
def test_codes_equal_plain_rounds(spark, monkeypatch, dims):
    monkeypatch.setattr(ball_codes, "AT_ONCE", 100)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(9, dims)) / 4
    vectors = (centres[rng.integers(0, 9, 700)] + rng.normal(size=(700, dims)) / 30).round(3)
    vectors[200:260] = vectors[0]  # repeated vectors, among them ones that start as equal entries
    vectors[5] = vectors[2]
    rows = [(i, None if i % 7 == 0 else i % 5, v.tolist()) for i, v in enumerate(vectors)]
    odd = [(-1, 1, None), (-2, 1, []), (-3, 1, [None] * dims), (-4, None, [float("nan")] * dims),
           (-5, 2, [float("inf")] * dims), (-6, 2, [1e9] * dims), (900, 2, [1.0])]
    table = spark.createDataFrame(rows + odd, "vec_id long, label int, embedding array<double>").withColumn("code", F.lit(7))
    found = ball_codes.compress(table, parts=4)
    books, want = lloyd(rows, 4, 16, 6)
    assert (found.books == books).all()
    assert sorted(repr(tuple(r)) for r in found.rows.collect()) == want
    monkeypatch.setattr(ball_codes, "BROADCAST_LABELS", 0)
    assert sorted(repr(tuple(r)) for r in ball_codes.compress(table, parts=4).rows.collect()) == want


def test_codes_of_few_and_no_vectors(spark):
    rows = [(i, i, [float(i), 0.0]) for i in range(3)]
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    found = ball_codes.compress(table, parts=2)
    assert sorted((r["vec"], r["code"], r["error"]) for r in found.rows.collect()) == [(0, "0000", 0), (1, "0100", 0), (2, "0200", 0)]
    none = ball_codes.compress(empty(table))
    assert none.rows.count() == 0 and none.books.size == 0
    assert none.rows.columns == found.rows.columns


def test_balls_skip_only_what_cannot_change():
    rng = np.random.default_rng(8)
    for _ in range(30):
        rows = rng.integers(-20, 20, (200, 3))
        book = rng.integers(-20, 20, (rng.integers(1, 12), 3))
        distance = ((rows[:, None] - book[None]) ** 2).sum(axis=2)
        own = rng.integers(0, len(book), 200)
        best, least = ball_codes.assign(rows, own, book)
        assert (best == distance.argmin(axis=1)).all() and (least == distance.min(axis=1)).all()


# --- faults of earlier operators


@pytest.mark.parametrize("size", [32_768, 32_769, 70_000, 140_000])
def test_bpe_of_long_pieces(size):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    tiktoken = pytest.importorskip("tiktoken")
    tokens = bpe.load_ranks(public_tokenizers.path(RANKS))
    reference = tiktoken.Encoding("byte", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    rng = random.Random(size)
    text = "".join(rng.choice("etaoinshrdluABCéß") for _ in range(size))
    while len(text.encode()) > size:
        text = text[:-1]
    text += "e" * (size - len(text.encode()))
    ids = np.frombuffer(bpe.Encoder(bpe.Ranks(tokens)).encode([text])[0], dtype="<u4").tolist()
    assert ids == reference.encode_ordinary(text)


def test_escape_is_linear_on_backslashes(spark):
    text = "</s>" + "\\" * 60_000 + "[INST]\\</s> [TURN " + "A" * 5_000
    turns = spark.createDataFrame([(1, 0, "user", text), (1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    start = time.time()
    read = chat.read_back(chat.format_conversations(turns)).first()
    assert read["round_trip"] and read["loss_text"] == text and read["turns"][0]["text"] == text
    assert time.time() - start < 20


def test_rows_without_conversation_are_their_own(spark):
    turns = spark.createDataFrame(
        [(None, 0, "user", "a"), (None, 0, "user", "a"), (None, 1, "assistant", "b"), (1, 1, "assistant", "d"), (1, 0, "user", "c")],
        "conv_id long, turn long, role string, text string",
    )
    found = chat.read_back(chat.format_conversations(turns)).collect()
    texts = sorted((r["conv_id"] is None, [t["text"] for t in r["turns"]]) for r in found)
    assert texts == [(False, ["c", "d"]), (True, ["a"]), (True, ["a"]), (True, ["b"])]
    assert all(r["round_trip"] for r in found)


def test_zero_weights_are_no_room(spark):
    data = [("a", "x", 1)] * 10 + [("a", "y", 1)] * 90 + [("b", "x", 1)] * 100
    docs = spark.createDataFrame([(i, *row) for i, row in enumerate(data)], "doc_id long, source string, lang string, n long")
    mixture = mixing.Mixture({"source": {}, "lang": {"y": 0.0}}, share=0.5, epochs=1)
    found = mixing.mix(docs, {"source": F.col("source"), "lang": F.col("lang")}, mixture, tokens=F.col("n"))
    assert {(r["source"], r["lang"]): r["count"] for r in found.groupBy("source", "lang").count().collect()} == {("a", "x"): 10, ("b", "x"): 90}
    nothing = mixing.Mixture({"source": {"a": 0.0, "b": 0.0}, "lang": {}}, share=0.5, epochs=1)
    assert mixing.mix(docs, {"source": F.col("source"), "lang": F.col("lang")}, nothing, tokens=F.col("n")).count() == 0


def test_names_of_hosts(spark):
    hosts = ["a.b.example.co.uk", "www.example.com:8080", "u@example.org.", "10.0.0.1", "localhost", "co.uk", "[::1]:80", ""]
    table = spark.createDataFrame([(h,) for h in hosts], "host string")
    found = table.select(url_reputation.registered_domain(F.col("host")), url_reputation.suffix(F.col("host"))).collect()
    assert [tuple(r) for r in found] == [
        ("example.co.uk", "co.uk"), ("example.com", "com"), ("example.org", "org"), ("10.0.0.1", ""),
        ("localhost", "localhost"), ("co.uk", "co.uk"), ("[::1]", ""), ("", ""),
    ]


# --- registered queries without SQL, against brute force ---------------------------------------------------------

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not __import__("os").path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def documents(spark):
    return [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]


def plain_digest(text):
    """The quartile digest, byte by byte."""
    counts, padded = [0] * digest.BUCKETS, b"\0\0" + text + b"\0\0\0"
    for i in range(len(text) + 2):
        for places, salt in digest.TRIPLETS:
            mixed = salt
            for at, factor in zip(places, digest.BYTE_FACTORS):
                mixed = (mixed ^ padded[i + at] * factor) * salt % 2**32
                mixed ^= mixed >> 15
            counts[mixed >> 24] += 1
    q1, q2, q3 = (sorted(counts)[64 * k - 1] for k in (1, 2, 3))
    codes = [(c > q1) + (c > q2) + (c > q3) for c in counts]
    length = min(255, int(math.log(len(text) + 1) / math.log(1.1)))
    ratios = 16 * int(15 * q1 / q3) + int(15 * q2 / q3) if q3 else 0
    body = bytes(a << 6 | b << 4 | c << 2 | d for a, b, c, d in zip(*[iter(codes)] * 4))
    return bytes([length, ratios]).hex() + body.hex()


def plain_likeness(a, b):
    a, b = bytes.fromhex(a), bytes.fromhex(b)
    quarters = [[x >> s & 3 for x in side[2:] for s in (6, 4, 2, 0)] for side in (a, b)]
    score = sum((0, 1, 3, 6)[abs(x - y)] for x, y in zip(*quarters)) + min(4 * abs(a[0] - b[0]), 100)
    score += sum(3 * abs((a[1] >> s & 15) - (b[1] >> s & 15)) for s in (4, 0))
    return 1 - min(score, digest.MOST) / digest.MOST


@needs_data
def test_op9_equals_the_plain_digest(spark, documents):
    found = {r["doc_id"]: r for r in QUERIES["op9_fingerprints"](spark, SF).collect()}
    assert len(found) == len(documents)
    descending = documents[::-1]
    for (doc, text), (_, after) in zip(descending, descending[1:] + descending[:1]):
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        r = found[doc]
        prints = [plain_digest(t.encode()) for t in (text, edited, after)]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert [r["fingerprint"], r["edited_fingerprint"]] == prints[:2]
        assert abs(r["near_edited"] - plain_likeness(*prints[:2])) < 1e-12 and abs(r["near_next"] - plain_likeness(prints[0], prints[2])) < 1e-12


@needs_data
def test_op10_equals_the_public_library(spark, documents):
    public_tokenizers, tiktoken = pytest.importorskip("public_tokenizers"), pytest.importorskip("tiktoken")
    tokens = bpe.load_ranks(public_tokenizers.path(RANKS))
    reference = tiktoken.Encoding("byte", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    found = {r["doc_id"]: r for r in QUERIES["op10_byte_bpe"](spark, SF).collect()}
    for doc, text in documents:
        ids = np.array(reference.encode_ordinary(text), dtype="<u4")
        assert (found[doc]["n_tokens"], found[doc]["ids_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert found[doc]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


@needs_data
@pytest.mark.parametrize("name", ["op3_language", "op5_lm_score", "op8_quality"])
def test_trained_queries_answer_for_every_document(spark, documents, name):
    found = QUERIES[name](spark, SF).collect()
    assert sorted(r["doc_id"] for r in found) == [d for d, _ in documents]
    assert all(math.isfinite(r["score"]) for r in found)
    if name == "op5_lm_score":
        counts, texts = {}, {d: [w.encode() for w in re.findall(r"[^ \t-\r]+", t.translate(A_TO_Z))] + [b"\n"] for d, t in documents}
        for r in found:
            if not r["held_out"]:
                for w in texts[r["doc_id"]]:
                    counts[w] = counts.get(w, 0) + 1
        n, v = sum(counts.values()), len(counts)
        for r in found:
            words = texts[r["doc_id"]]
            base = sum(math.log10((counts.get(w, 0) + 0.5) / (n + 0.5 * (v + 1))) for w in words)
            assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(words), sum(w in counts for w in words), n)
            assert abs(r["base_score"] - base) < 1e-6 * abs(base) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1)


@needs_data
def test_pipeline_runs_all_its_stages(spark, documents):
    found = corpus_pipeline.run(spark, SF)
    assert found.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    texts = dict(documents)
    kept = found.collect()
    assert kept and all(r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest() for r in kept)
    assert QUERIES["pipeline"] is corpus_pipeline.run
