"""Exact dedup: group by a 128-bit content hash, compare bytes inside groups, keep one row of each.

Texts are equal when identical after deleting ASCII white space; a null text counts as empty. The row with the
most code points in its original text stays, then the smallest id; null ids come last, and rows that repeat an id
count as rows of their own. Extra columns of the input are ignored; an empty table gives an empty result.

Only fixed-width fingerprints are shuffled for all rows. Texts move for rows whose 128-bit hash repeats, and Spark's
map-side aggregation on (hash, text) collapses their copies before the shuffle, so a hot group costs one row a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE


def normalised(text: str):
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACE, "")


def _fingerprints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    norm = docs.select(F.col(id_col).alias("doc_id"), normalised(text_col).alias("_norm"), F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("_cp"))
    return norm.select("doc_id", "_cp", "_norm", F.xxhash64("_norm").alias("_h1"), F.xxhash64(F.lit(7), F.col("_norm")).alias("_h2"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    prints = _fingerprints(docs, id_col, text_col)
    best = F.max(F.struct(F.col("_cp"), F.col("doc_id").isNotNull().alias("has"), (-F.col("doc_id")).alias("neg"))).alias("_best")
    rows = prints.select("doc_id", "_cp", "_h1", "_h2", F.sha2(F.col("_norm"), 256).alias("text_sha256"))
    by_hash = rows.groupBy("_h1", "_h2").agg(F.count(F.lit(1)).alias("group_size"), best)
    again = by_hash.filter("group_size > 1").select("_h1", "_h2")
    # the bytes decide: rows of one 128-bit hash are grouped anew by their whole normalised text
    compared = (
        prints.join(again, ["_h1", "_h2"], "left_semi").groupBy("_h1", "_h2", "_norm").agg(F.count(F.lit(1)).alias("group_size"), best)
        .select("_h1", "_h2", F.sha2(F.col("_norm"), 256).alias("text_sha256"), "group_size", "_best")
    )
    out = rows.join(compared, ["_h1", "_h2", "text_sha256"], "left")
    single = F.col("group_size").isNull()
    keep = F.when(single, F.col("doc_id")).otherwise(-F.col("_best.neg"))
    return out.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce(F.col("group_size"), F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("doc_id") == keep, single, F.lit(False)).alias("kept"),
        "text_sha256",
    )
