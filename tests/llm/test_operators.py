"""Operators against brute force, round trips and held-out accuracy, and on odd rows."""

import random



import numpy as np
import pytest
from pyspark.sql import functions as F

from twinfinder.llm import bpe, chat, digest, language, lm, mixing, ngram_join, quality, topk, url_reputation

WORDS = {"en": "the of and to in that was his with they".split(), "de": "der die und zu ist nicht mit auf dem sich".split()}


def prose(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "", "er", "ing", "ung"]) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, empty and long texts, repeated rows, and a column whose name an operator uses."""
    rng = random.Random(4)
    long = prose(rng, "en", 30_000)
    data = [(1, None, "en", "src1", None), (2, "", None, None, 0), (None, "the end of it", "en", "src0", 13),
            (3, long, "en", "src0", len(long)), (4, "the cat", "en", "src0", 7), (4, "the cat", "en", "src0", 7), (5, "\U0001f642 123", "de", "x", 5)]
    data += [(i, prose(rng, "en" if i % 2 else "de", 40), "en" if i % 2 else "de", f"src{i % 3}", 200) for i in range(10, 60)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    return spark.createDataFrame(data, schema).withColumn("score", F.lit("mine")).withColumn("_n", F.lit(1))


def empty(df):
    return df.filter("false")


# --- 1


def test_top_k_is_exact(spark):
    rng = np.random.default_rng(2)
    vectors = rng.integers(-40, 40, (300, 37)).astype(float)
    vectors[50] = vectors[51] = vectors[7]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    rows += [(400, None), (500, [None] * 37), (550, [float("nan")] * 37), (600, [1.0, 2.0]), (None, [1.0] * 37)]
    found = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id % 50 = 0", 5)
    want = set()
    for q in range(0, 300, 50):
        scores = vectors @ vectors[q]
        best = sorted((i for i in range(300) if i != q), key=lambda i: (-scores[i], i))[:5]
        want |= {(q, r + 1, i, int(scores[i])) for r, i in enumerate(best)}
    assert {tuple(r) for r in found.collect()} == want


def test_top_k_beyond_doubles_and_empty(spark):
    big = [(0, [2.0**40, 1.0]), (1, [2.0**40, 3.0]), (2, [2.0**40, 2.0])]
    df = spark.createDataFrame(big, "vec_id long, embedding array<double>")
    assert [r["vec_id"] for r in topk.top_k(df, "vec_id = 0", 5).orderBy("rank").collect()] == [1, 2]
    assert topk.top_k(empty(df), "vec_id = 0", 5).count() == 0


# --- 2


def test_similar_texts_match_brute_force(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(4000)]
    data = []
    for group in range(12):
        base = [rng.choice(words) for _ in range(120)]
        for _ in range(rng.choice([1, 2, 6, 70])):
            text = list(base)
            for at in rng.sample(range(120), rng.choice([0, 1, 2, 4])):
                text[at] = rng.choice(words)
            data.append((len(data), " ".join(text)))
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = {r["_doc"]: r for r in ngram_join.similar_texts(df).collect()}
    sets = [frozenset(tuple(t.split()[i : i + 5]) for i in range(116)) for _, t in data]
    part, links = list(range(len(data))), [set() for _ in data]
    for i in range(len(data)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                if sets[i] != sets[j]:
                    links[i].add(sets[j])
                    links[j].add(sets[i])
                old, new = max(part[i], part[j]), min(part[i], part[j])
                part = [new if p == old else p for p in part]
    for i in range(len(data)):
        assert (got[i]["class_id"], got[i]["links"]) == (part[i], len(links[i]))
    assert sum(r["keep"] for r in got.values()) == len(set(part))


def test_large_cells_agree_with_small_ones(monkeypatch):
    rng = np.random.default_rng(0)
    n = 90
    rows = {"leaf": np.full(n, 5), "i": np.zeros(n, int), "j": np.zeros(n, int), "slice": np.zeros(n, int),
            "node": np.arange(n), "size": rng.integers(80, 120, n), "leaves": np.sort(rng.integers(3, 9, (n, 3)), axis=1),
            "sketch": rng.integers(0, 2, (n, ngram_join.PLACES)).astype(np.uint8)}
    large = set(zip(*[x.tolist() for x in ngram_join.new_pairs(rows, ngram_join.Fraction("0.8"))]))
    monkeypatch.setattr(ngram_join, "LARGE", 1000)
    assert large == set(zip(*[x.tolist() for x in ngram_join.new_pairs(rows, ngram_join.Fraction("0.8"))])) and large


def test_odd_rows_are_joined(odd):
    found = ngram_join.similar_texts(odd)
    assert found.count() == odd.count()
    assert found.filter("_doc = 4").select("copies").distinct().collect() == [(1,)]
    kept = ngram_join.one_of_each(odd)
    assert kept.columns == odd.columns and kept.filter("doc_id = 4").count() == 1
    assert kept.filter("doc_id in (1, 2)").count() == 2
    assert ngram_join.similar_texts(empty(odd)).count() == 0


# --- 3, 8


def test_language_is_learned(odd):
    network = language.language_model(odd, F.col("doc_id") < 40)
    found = odd.select("doc_id", "lang", "text", language.language_of(network, "text").alias("l")).collect()
    assert all(r["l"]["lang"] == "und" and r["l"]["score"] == 0 for r in found if r["doc_id"] in (1, 2, 5))
    held = [r for r in found if (r["doc_id"] or 0) >= 40]
    assert sum(r["l"]["lang"] == r["lang"] for r in held) >= 0.9 * len(held)
    nothing = language.language_model(empty(odd), F.lit(True))
    assert {r["l"]["lang"] for r in odd.select(language.language_of(nothing, "text").alias("l")).collect()} == {"und"}


def test_quality_is_learned(spark, odd):
    rng = random.Random(3)
    docs = [(i, prose(rng, "en", 30) if i % 2 else "### !! " * 30, "en", "s", 9) for i in range(200)]
    docs = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    labels = docs.filter("doc_id < 120").select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    model = quality.quality_model(docs, labels)
    assert sum(model.pseudo_labels) > 0
    scores = {r["doc_id"]: r["s"] for r in docs.select("doc_id", quality.quality_of(model).alias("s")).collect()}
    assert all((scores[i] > 0.5) == bool(i % 2) for i in range(120, 200))
    scored = odd.select("doc_id", quality.quality_of(model).alias("s")).collect()
    assert all(r["s"] == 0 for r in scored if r["doc_id"] in (1, 2)) and all(0 <= r["s"] <= 1 for r in scored)
    assert quality.quality_model(odd, empty(labels)) is None
    assert quality.quality_model(empty(odd), labels) is None


# --- 4


def test_urls(spark):
    pages = spark.createDataFrame(
        [(1, "HTTP://A.Example.NET/en/x?y"), (2, "http://net"), (3, None), (4, "no scheme"), (5, "http://a.org/fr/#z"), (6, "x://b.org/q"), (7, "x://b.org/q")],
        "page_id long, url string",
    ).withColumn("host", F.lit("old"))
    outcomes = spark.createDataFrame([("b.org", 1)] * 60 + [("c.org", 0)] * 60 + [(None, 1), ("b.org", None)], "host string, bad int")
    rules = [("block", "net/"), ("allow", "example.net/en/"), ("allow", "org/fr/")]
    found = url_reputation.judge_urls(pages, url_reputation.host_reputation(outcomes), rules, 0.3)
    assert {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in found.collect()} == {
        1: ("a.example.net", "/en/x", "example.net/en/", "allow"), 2: ("net", "", None, "allow"), 3: ("", "", None, "allow"),
        4: ("", "", None, "allow"), 5: ("a.org", "/fr/", "org/fr/", "allow"), 6: ("b.org", "/q", None, "block"), 7: ("b.org", "/q", None, "block"),
    }
    assert url_reputation.host_reputation(empty(outcomes)).count() == 0


def test_a_host_without_outcomes_has_the_bound_of_its_domain(spark):
    data = [(f"h{i}.bad.com", 1) for i in range(50) for _ in range(4)] + [(f"h{i}.good.org", 0) for i in range(50) for _ in range(4)]
    reputation = url_reputation.host_reputation(spark.createDataFrame(data, "host string, bad int"))
    assert reputation.count() == 100
    urls = {"http://h50.bad.com/": "block", "http://h7.bad.com/": "block", "http://h50.good.org/": "allow", "http://other.org/": "allow", "no host": "allow"}
    pages = spark.createDataFrame([(u,) for u in urls], "url string")
    found = {r["url"]: r for r in url_reputation.judge_urls(pages, reputation, [], 0.3).collect()}
    assert {u: r["verdict"] for u, r in found.items()} == urls
    known, unseen = found["http://h7.bad.com/"]["bound"], found["http://h50.bad.com/"]["bound"]
    assert known > unseen > 0.9 and max(found["http://other.org/"]["bound"], found["http://h50.good.org/"]["bound"]) < 0.1
    assert found["no host"]["bound"] is None


# --- 5


def test_probabilities_add_up_and_base_is_exact(odd):
    docs = odd.filter("doc_id is not null")
    found = {r["_id"]: r for r in lm.score_texts(docs, F.col("doc_id") != 12).collect()}
    tokens = [w for r in docs.filter("doc_id <> 12").collect() for w in lm.words_of(r["text"])]
    counts, n, v = {w: tokens.count(w) for w in set(tokens)}, len(tokens), len(set(tokens))
    for r in docs.collect():
        words = lm.words_of(r["text"])
        base = sum(np.log10((counts.get(w, 0) + 0.5) / (n + 0.5 * (v + 1))) for w in words)
        got = found[r["doc_id"]]
        assert (got["n_tokens"], got["n_known"], got["train_tokens"]) == (len(words), sum(w in counts for w in words), n)
        assert got["base_score"] == pytest.approx(base) and np.isfinite(got["score"]) and got["score"] < 0
    model = lm.LogBilinear(7, np.full(7, 1 / 7))
    context = np.full((7, lm.CONTEXT), 3)
    assert np.exp(model.log_probabilities(context, np.arange(7))).sum() == pytest.approx(1)
    assert lm.score_texts(empty(odd), F.lit(True)).count() == 0
    assert lm.score_texts(odd, F.lit(False)).filter("train_tokens = 0").count() == odd.count()


@pytest.mark.parametrize("rest", range(4))
def test_every_training_text_is_learned_from(spark, monkeypatch, rest):
    monkeypatch.setattr(lm, "WARM_TOKENS", 0)  # no text is in the driver's start
    texts = spark.createDataFrame([("deep blue sea " * 50,)] * 4, "_text string").withColumn("_hash", F.lit(4 + rest).cast("bigint"))
    shared = spark.sparkContext.broadcast(lm.vocabulary(lm.count_words(texts.select("_text"))))
    model, start = lm.fit(texts, shared, "_text"), lm.LogBilinear(len(shared.value.class_tokens), lm.noise_of(shared.value))
    assert all(not np.allclose(p, q) for p, q in zip(model.parameters(), start.parameters()))


def test_step_equals_one_over_all_rows():
    rng, noise = np.random.default_rng(3), np.full(9, 1 / 9)
    context, target = rng.integers(0, 30, (50, lm.CONTEXT)), rng.integers(0, 9, 50)
    model, same = lm.LogBilinear(9, noise), lm.LogBilinear(9, noise)
    model.train(context, target, noise, [np.full_like(p, 1e-3) for p in model.parameters()], np.random.default_rng(1))
    drawn, shift = np.random.default_rng(1).choice(9, lm.NOISE, p=noise), np.log(lm.NOISE * noise)
    vectors = same.predicted(context)
    true = (vectors * same.outputs[target]).sum(axis=1) + same.bias[target, 0] - shift[target]
    false = vectors @ same.outputs[drawn].T + same.bias[drawn, 0] - shift[drawn]
    back = (1 / (1 + np.exp(-true)) - 1)[:, None] * same.outputs[target] + 1 / (1 + np.exp(-false)) @ same.outputs[drawn]
    grad = np.zeros_like(same.inputs)
    for i in range(lm.CONTEXT):
        np.add.at(grad, context[:, i], back * same.places[i] / 50)
    assert np.allclose(model.inputs, same.inputs - lm.RATE * grad / np.sqrt(1e-3 + grad * grad + 1e-8), atol=1e-5)


# --- 6


def test_mixing_fills_siblings_first(odd, spark):
    leaves = spark.createDataFrame(
        [("a", "x", 100, 5), ("a", "y", 1000, 5), ("b", "x", 1000, 5)], "_domain string, _lang string, _supply long, _docs long"
    )
    budgets = mixing.leaf_budgets(leaves, mixing.Mixture({"domain": {}, "lang": {}}, share=1000 / 2100, epochs=1))
    assert {(r["_domain"], r["_lang"]): r["_allot"] for r in budgets.collect()} == {("a", "x"): 100, ("a", "y"): 400, ("b", "x"): 500}
    mixture = mixing.Mixture({"lang": {"de": 2.0}, "source": {}}, share=0.7, epochs=2, seed=1)
    levels = {"lang": F.col("lang"), "source": F.col("source")}
    odd = odd.filter("doc_id is null or doc_id <> 3")  # a text longer than its leaf's budget is never in a prefix
    chosen = mixing.mix(odd, levels, mixture)
    assert chosen.columns == [*odd.columns, "mix_epoch"]
    total = lambda df: df.agg(F.sum(mixing.count_words(F.col("text")))).first()[0]
    assert 0.3 * total(odd) < total(chosen) <= 0.7 * total(odd)
    assert mixing.mix(empty(odd), levels, mixture).count() == 0


# --- 7


def test_conversations_come_back(spark):
    rng = random.Random(5)
    parts = ["[INST]", "[/INST]", "<s>", "</s>", "\\", "\n", "[SYS]", "[TURN 61]", "[/TURN]", "a", " ", "é"]
    data = [(i, t, rng.choice(["user", "assistant", "system", "tool\n", None]), "".join(rng.choice(parts) for _ in range(rng.randint(0, 12))))
            for i in range(150) for t in range(3)]
    data += [(999, None, "assistant", None), (999, None, "assistant", None), (None, 1, "user", "x")]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    read = chat.read_back(chat.format_conversations(df))
    assert read.count() == 152 and read.filter("not round_trip").count() == 0
    said = F.array_join(F.transform(F.filter("source", lambda s: s["role"] == "assistant"), lambda s: s["text"]), "")
    assert read.filter(~F.col("loss_text").eqNullSafe(said)).count() == 0
    assert chat.format_conversations(empty(df)).count() == 0


# --- 9


def test_digests(odd):
    rng = random.Random(6)
    base, other = (prose(rng, "en", 400).encode() for _ in range(2))
    near, far = digest.likenesses([digest.digest(base)] * 2, [digest.digest(base[:-60]), digest.digest(other)])
    assert digest.likenesses([digest.digest(base)], [digest.digest(bytes(base))])[0] == 1.0 and 0 <= far < near <= 1
    assert digest.digest(b"") != digest.digest(b"a") != digest.digest(b"b")
    found = digest.with_next(odd, "doc_id", {"text": F.col("text")})
    assert found.count() == odd.count()
    ordered = [r for r in found.collect() if r["doc_id"] is not None and r["doc_id"] >= 10]
    texts = {r["doc_id"]: r["text"] for r in ordered}
    assert all(r["next_text"] == texts[r["doc_id"] - 1] for r in ordered if r["doc_id"] > 10)
    assert found.filter("doc_id is null").first()["next_text"] == texts[59]
    assert digest.with_next(empty(odd), "doc_id", {"text": F.col("text")}).count() == 0


def test_next_across_ranges(spark, monkeypatch):
    monkeypatch.setattr(digest, "RANGE_ROWS", 7)
    found = digest.with_next(spark.range(100).withColumnRenamed("id", "k"), "k", {"k": F.col("k")}).collect()
    assert sorted((r["k"], r["next_k"]) for r in found) == [(k, (k - 1) % 100) for k in range(100)]


# --- 10


def test_bpe_equals_the_library(odd, spark):
    public = pytest.importorskip("public_tokenizers")
    tiktoken = pytest.importorskip("tiktoken")
    path = public.path("byte_bpe_multi_50k.tiktoken")
    tokens = bpe.load_ranks(path)
    own = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    for r in bpe.encoded(odd.withColumn("ids", F.lit(0)), path).collect():
        text = r["text"] or ""
        assert np.frombuffer(r["ids"], dtype="<u4").tolist() == own.encode_ordinary(text)
        assert bytes(r["decoded"]).decode() == text
    rng, ranks = random.Random(7), bpe.Ranks(tokens)
    alphabet = " \n\t'sdtrvelmxyÉ1½!., 　中\U0001f642\x00\x85"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(1500)] + ["ab" * 400, " " * 999]
    assert [np.frombuffer(x, dtype="<u4").tolist() for x in bpe.Encoder(ranks).encode(texts)] == [own.encode_ordinary(t) for t in texts]


# --- the pipeline


def test_texts_in_no_language_are_dropped(spark):
    import base64

    import corpus_pipeline

    rng = random.Random(8)
    data = [(i, prose(rng, "en" if i % 2 else "de", 60), "en" if i % 2 else "de") for i in range(400)]
    data += [(1000 + i, prose(rng, lang, 6), lang) for i in range(30) for lang in WORDS]
    data += [(2000, base64.b64encode(rng.randbytes(900)).decode(), "en"), (2001, rng.randbytes(500).hex(), "de"),
             (2002, " ".join("".join(rng.choice("абвгдежзиклмнопрстуфхцчшыьэюя") for _ in range(6)) for _ in range(90)), "en"),
             (2003, "".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(300)), "de")]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    kept = {r["doc_id"] for r in corpus_pipeline.known_language(spark, docs, "").collect()}
    assert kept == {i for i, _, _ in data if i < 2000}


def test_pipeline_keeps_and_drops(spark, odd, tmp_path):
    import corpus_pipeline

    labels = odd.filter("doc_id > 9").select("doc_id", F.lit(1).alias("quality"))
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs = odd
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == odd.columns
    assert docs.filter("doc_id in (1, 2, 5)").count() == 0
    assert "n_tokens" in corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).columns
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty(odd), str(tmp_path)).count() == 0
