"""Language ID by compression: one zstandard raw-content dictionary a language; the smallest encoding wins.

Dictionaries come from a bounded sample of labelled rows (``dict_bytes`` a language, taken from the rows with the
smallest hashes of their ids among at most ``sample_rows`` of each language); a rank limit in Spark keeps that sample
bounded in every task. A row gives one slice of ``slice_chars`` characters, at a place drawn by its id's hash, so that no row fills a
dictionary alone and shared openings do not fill it either. More than ``max_languages`` labels are an error, since all
dictionaries are held by every task. Every whole text is then encoded in pieces of ``piece_bytes``, so that its own content does not
drown the dictionary; letters are lower-cased on both sides. ``score`` is 1 minus the ratio of the winner's size to the runner-up's, scaled to 0..1 by
``tanh``; a text is rejected when it has no letter or its relative margin is under ``min_margin``.

Languages of one size tie by name. Bytes that are no UTF-8 are replaced. Null or letterless text: ``und``, score 0, rejected. No learned language: every row is ``und``. Null labels are not
learned. Rows that repeat are predicted each on its own; extra columns are ignored.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import modest_batches

DICT_BYTES = 100 << 10
SAMPLE_ROWS = 256
PIECE_BYTES = 1024
SLICE_CHARS = 2000
MAX_LANGUAGES = 256
LEVEL = 6
MIN_MARGIN = 0.0005
LETTER = r"\p{L}"


def fit_dictionaries(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", dict_bytes: int = DICT_BYTES, sample_rows: int = SAMPLE_ROWS, slice_chars: int = SLICE_CHARS, max_languages: int = MAX_LANGUAGES) -> dict[str, bytes]:
    """Language to raw-content dictionary. At most ``sample_rows`` rows a language are looked at (the documented bound)."""
    seeded = F.xxhash64(F.lit("language-id"), F.col(id_col))
    learn = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(text_col).rlike(LETTER))
    first = Window.partitionBy("lang").orderBy("h", "text")
    text = F.col(text_col)
    start = F.pmod(seeded, F.greatest(F.length(text) - slice_chars + 1, F.lit(1))).cast("int") + 1
    cut = learn.select(F.col(lang_col).alias("lang"), seeded.alias("h"), F.substring(text, start, F.lit(slice_chars)).alias("text"))
    languages = cut.select("lang").distinct().limit(max_languages + 1).count()
    if languages > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    sample = cut.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= sample_rows)
    taken: dict[str, list[bytes]] = {}
    for row in sorted(sample.collect(), key=lambda r: (r["lang"], r["r"])):
        taken.setdefault(row["lang"], []).append(row["text"].lower().encode("utf-8", "replace"))
    return {lang: b"\n".join(texts)[:dict_bytes] for lang, texts in taken.items()}


def classify(docs: DataFrame, dictionaries: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text", piece_bytes: int = PIECE_BYTES, min_margin: float = MIN_MARGIN, keep: list[Column] | None = None) -> DataFrame:
    """Per row: the kept columns, lang_pred, score, margin, rejected."""
    modest_batches(docs.sparkSession)
    langs = sorted(dictionaries)
    blobs = [dictionaries[x] for x in langs]
    kept = docs.select(*(keep or [F.col(id_col)]), F.col(text_col).alias("__text"), F.coalesce(F.col(text_col).rlike(LETTER), F.lit(False)).alias("__letters"))
    names = [c for c in kept.columns if c not in ("__text", "__letters")]
    schema = kept.select(*names, F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("margin"), F.lit(True).alias("rejected")).schema

    def run(batches):
        import zstandard

        encoders = [zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(b, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_checksum=False, write_content_size=False) for b in blobs]
        calls = [e.compress for e in encoders]
        for batch in batches:
            pred, score, margin, rejected = [], [], [], []
            letters = batch.column(batch.schema.get_field_index("__letters")).to_pylist()
            texts = batch.column(batch.schema.get_field_index("__text")).cast(pa.large_binary())
            for has, cell in zip(letters, texts, strict=True):
                if not has or not calls:
                    pred.append("und"), score.append(0.0), margin.append(0.0), rejected.append(True)
                    continue
                text = cell.as_py().decode("utf-8", "replace").lower().encode("utf-8")
                sizes = [0] * len(calls)
                for at in range(0, len(text), piece_bytes):
                    piece = text[at : at + piece_bytes]
                    for i, call in enumerate(calls):
                        sizes[i] += len(call(piece))
                order = sorted(range(len(calls)), key=lambda i: (sizes[i], langs[i]))
                ahead = (sizes[order[1]] - sizes[order[0]]) / sizes[order[1]] if len(order) > 1 else 1.0
                pred.append(langs[order[0]]), margin.append(ahead), score.append(math.tanh(8 * ahead)), rejected.append(ahead < min_margin)
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in names), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(margin, pa.float64()), pa.array(rejected, pa.bool_())], names=schema.names)

    return kept.mapInArrow(run, schema)


def fold(id_col: str = "doc_id", folds: int = 3) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def identify(docs: DataFrame) -> DataFrame:
    """Learn from two folds of three (never from fold 1) and predict every row: doc_id, held_out, lang_pred, score, margin, rejected."""
    held = F.coalesce(fold() == 1, F.lit(False))
    learned = fit_dictionaries(docs.filter(~held))
    return classify(docs, learned, keep=[F.col("doc_id"), held.alias("held_out")])
