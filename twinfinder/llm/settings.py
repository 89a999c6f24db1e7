"""Production parameters that the queries and the pipeline share."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from twinfinder.llm import mixing

RANKS = "byte_bpe_multi_50k.tiktoken"

GOOD = 0.3  # the least probability of good quality of a document that is kept
SURE_LANGUAGE = 0.25  # the least probability of being in any learned language of a document that is kept

DOMAINS = {"d0": 1.0, "d1": 2.0, "d2": 3.0}
LANGUAGES = {"en": 2.0, "de": 1.0, "fr": 1.0, "es": 4.0}
MIXTURE = mixing.Mixture({"domain": DOMAINS, "lang": LANGUAGES, "source": {}}, share=0.6, epochs=3, seed=7)


def mix_levels() -> dict:
    """Documents have no domain: the number of their source, modulo three, stands for one."""
    number = F.regexp_extract(F.coalesce("source", F.lit("")), "([0-9]{1,9})$", 1)
    domain = F.concat(F.lit("d"), (F.when(number != "", number).otherwise("0").cast("int") % 3).cast("string"))
    return {"domain": domain, "lang": F.col("lang"), "source": F.col("source")}


def bpe_digests(docs: DataFrame) -> DataFrame:
    return docs.select(
        "doc_id",
        F.expr("octet_length(ids) div 4").cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
