"""A training-corpus pipeline: each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept.

Rows come in and go out with the columns of documents; the last stage returns the sequences in their slots. Extra and
oddly named columns pass through untouched (they travel in one struct).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwarden.llm import decontamination, language_id, mixing, ngram_join, token_output
from spanwarden.llm.common import materialize, read


def _row(docs: DataFrame):
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or between two languages, go."""
    learned = language_id.fit_dictionaries(docs.filter(~F.coalesce(language_id.fold() == 1, F.lit(False))))
    named = language_id.classify(docs, learned, keep=[_row(docs)])
    return named.filter(~F.col("rejected")).select("__row.*")


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of linked documents the one with the smallest id stays."""
    return ngram_join.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.clean(docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents appear as often as the mix takes them, up to three times; those that it does not take go."""
    mixed = mixing.mix(docs.select("doc_id", "text", "source", _row(docs)), keep=("__row",)).filter("copies > 0")
    return mixed.select("__row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("__copy")).select("__row.*")


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per sequence in its slot."""
    return token_output.digests(docs)


STAGES = [
    ("language_id", keep_known_languages),
    ("ngram_join", keep_one_of_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_output", write_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{name}")
    return docs


#: Compression, sketches and a byte-level tokenizer have no SQL form; tests/llm holds the brute-force version.
ORACLE_SQL = None
