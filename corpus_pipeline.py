"""A training corpus in five stages, each an operator of stepweave.llm over what the stage before it kept.

1. toxicity: documents that score 0.5 or more are rejected; all others stay.
2. near_duplicates: of each class of documents linked at Jaccard 0.8 on five-word shingles, a row with the smallest doc_id stays.
3. repeated_passages: words in 20-word windows that start earlier in the corpus are cut from their texts. Every document stays.
4. mixing: languages reach their target shares of all tokens by repeating documents; no rate is below 1, so each one stays.
5. tokens: byte-level BPE ids of each text, and digests of the ids and of the decoded bytes.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stepweave.llm import bpe, jaccard, mixing, substrings, toxicity
from stepweave.llm.shared import work_dir, written
from stepweave.session import table

#: Target shares of all tokens.
LANGUAGES = {"de": 0.18, "en": 0.55, "es": 0.11, "fr": 0.16}


def _row(docs: DataFrame, *but: str) -> Column:
    """All columns (`but` some) as one, so that none clashes with a column that a stage needs."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in but]).alias("row")


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Labels come from all labelled rows of the input; rows with null or empty texts have no sign of toxicity."""
    index = toxicity.fit(docs, table(spark, sf_dir, "labels"), "true")
    scored = toxicity.score(docs.select(_row(docs), "text"), index, keep=["row"])
    return scored.where("score < 0.5").select("row.*")


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated rows are one class too, so one of them stays. Texts without words link with nothing and all stay.

    Rows are found by doc_id and text: different texts may share a doc_id, or have none, and each class keeps a row of its own.
    Of rows that share both, the one whose columns, as text, have the smallest hash."""
    has_words = F.length(F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), r"[\x20\x09-\x0D]+", "")) > 0
    key = [F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("without")]
    keep = jaccard.one_of_each_class(docs).select(*key, F.col("text_id").alias("of_text"))
    named = docs.where(has_words).select(_row(docs), *key, jaccard.text_id("text").alias("of_text")).join(keep, ["id", "without", "of_text"], "left_semi")
    order = Window.partitionBy("id", "without", "of_text").orderBy(F.xxhash64(F.to_json("row")))
    first = named.withColumn("rank", F.row_number().over(order)).where("rank = 1").select("row.*")
    return first.union(docs.where(~has_words))


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = substrings.cut_repeats(docs.select("doc_id", "text", _row(docs, "text")))
    columns = {c: F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns}
    if "n_chars" in columns:
        columns["n_chars"] = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(columns["n_chars"]).cast(dict(docs.dtypes)["n_chars"])
    return cut.select(*[c.alias(name) for name, c in columns.items()])


def mix_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labelled = mixing.labelled_rows(docs.select("doc_id", "text", "lang"), table(spark, sf_dir, "labels").select("doc_id")).select("text", F.col("lang").alias("domain"))
    mixed = mixing.mix(docs, labelled, list(LANGUAGES), mixing.weighted_without_loss(list(LANGUAGES.values())), least=1.0)
    return mixing.resampled(docs, written(mixed, work_dir(spark, "mixed")))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", one_of_near_duplicates),
    ("repeated_passages", cut_passages),
    ("mixing", mix_languages),
    ("tokens", tokenize),
]

#: SQL expresses neither the neighbours' votes, nor the fitted rates, nor the merges; tests/llm hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, root = table(spark, sf_dir, "documents"), work_dir(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"{root}/{i}")
    return docs
