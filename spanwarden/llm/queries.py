"""The registered queries of this subpackage: thin calls of the operators over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_dedup, decontamination, exact_dedup, html_extract, language_id, line_dedup, lm_score, mixing, ngram_join, spelling, substring_dedup, token_align, token_output
from .common import read


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_classes(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(read(spark, sf_dir, "pages"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(read(spark, sf_dir, "documents"))


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(read(spark, sf_dir, "documents"))


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.digests(read(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(read(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).drop("copies")


def op8_byte_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = byte_dedup.dedup_bytes(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), "kept_sha256")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_words(read(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(read(spark, sf_dir, "documents"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op13_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_align.align_corpus(read(spark, sf_dir, "documents"), keep_groups=False)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.lower(F.hex("groups")).alias("groups_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS cp, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept,
       sha256(norm) AS text_sha256
FROM d WINDOW w AS (PARTITION BY norm ORDER BY cp DESC, doc_id)
"""


OP8_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT d.doc_id, s.i, substr(d.h, 2 * s.i + 1, 200) AS win FROM d, LATERAL (SELECT unnest(range(0, length(d.h) // 2 - 99)) AS i) s),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS r FROM w) WHERE r > 1),
cut AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS new FROM hit),
run AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM cut) GROUP BY doc_id, k),
gap AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS z FROM run),
kept AS (
  SELECT d.doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, string_agg(substr(d.h, 2 * z + 1, 2 * (a - z)), '' ORDER BY a) || substr(any_value(d.h), 2 * max(b) + 1) AS h
  FROM gap JOIN d USING (doc_id) GROUP BY d.doc_id
)
SELECT d.doc_id, CAST(length(d.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(k.n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(k.h, d.h))) AS kept_sha256
FROM d LEFT JOIN kept k USING (doc_id)
"""


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
),
p AS (SELECT doc_id, unnest(range(1, len(words) + 1)) AS i, unnest(words) AS word FROM d),
w AS (
  SELECT d.doc_id, s.i, array_to_string(d.words[s.i : s.i + 12], ' ') AS win
  FROM d, LATERAL (SELECT unnest(range(1, len(d.words) - 11)) AS i) s
),
f AS (SELECT win, min(doc_id) AS first_doc FROM w GROUP BY win),
hit AS (SELECT w.doc_id, w.i FROM w JOIN f USING (win) WHERE f.first_doc < w.doc_id),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM hit, range(13) r(k)),
kept AS (
  SELECT p.doc_id, string_agg(p.word, ' ' ORDER BY p.i) AS text FROM p ANTI JOIN gone USING (doc_id, i) GROUP BY p.doc_id
),
n AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, CAST(coalesce(n.n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


OP1_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
),
s AS (
  SELECT DISTINCT d.doc_id, CASE WHEN len(d.w) < 5 THEN 'all ' || array_to_string(d.w, ' ') ELSE array_to_string(d.w[k.i : k.i + 4], ' ') END AS g
  FROM d, LATERAL (SELECT unnest(range(1, greatest(len(d.w) - 4, 1) + 1)) AS i) k WHERE len(d.w) > 0
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT p.x, p.y FROM p JOIN n nx ON nx.doc_id = p.x JOIN n ny ON ny.doc_id = p.y WHERE 100 * p.c >= 75 * (nx.n + ny.n - p.c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.y FROM r JOIN e ON r.b = e.x)
SELECT r.a AS doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(r.b) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.a GROUP BY r.a
"""


#: crc32 is made of its table of 256 values (by its rule); the key of a run is its document's id, a colon and the run.
OP11_SQL = r"""
WITH RECURSIVE t AS (
  SELECT list(c ORDER BY b) AS crc FROM (
    SELECT b, list_reduce([CAST(b AS BIGINT), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END)) AS c FROM range(256) r(b))
),
r AS (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{00C0}-\x{00FF}]+')) AS run FROM documents
  ) WHERE length(run) >= 7 GROUP BY doc_id, run
),
x AS (SELECT run, n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS k FROM r),
h AS (
  SELECT run, n, xor(4294967295, list_reduce(
    list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(0, length(k) // 2), lambda i: CAST(('0x' || substr(k, 2 * i + 1, 2)) AS BIGINT))),
    lambda c, b: xor(c >> 8, t.crc[(xor(c, b) & 255) + 1]))) AS h
  FROM x, t
),
w AS (
  SELECT word, sum(n) AS n FROM (
    SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, n FROM h
  ) WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
),
p AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w),
d AS (SELECT word, n, substr(word, 1, i - 1) || substr(word, i + 1) AS less, substr(word, 1, i - 1) || '_' || substr(word, i + 1) AS blank FROM p),
e AS (
  SELECT a.word AS x, b.word AS y FROM d a JOIN d b ON a.blank = b.blank AND a.word <> b.word
  UNION SELECT a.word, b.word FROM d a JOIN w b ON a.less = b.word
  UNION SELECT b.word, a.word FROM d a JOIN w b ON a.less = b.word
),
f AS (
  SELECT e.x AS word, count(*) AS n_near, first(e.y ORDER BY w.n DESC, e.y) AS best, max(w.n) AS best_n FROM e JOIN w ON w.word = e.y GROUP BY e.x
),
g AS (
  SELECT w.word, w.n, coalesce(f.n_near, 0) AS n_near, CASE WHEN f.best_n >= 10 * w.n THEN f.best END AS form, CASE WHEN f.best_n >= 10 * w.n THEN f.best_n END AS form_n FROM w LEFT JOIN f USING (word)
),
s(word, root) AS (SELECT word, word FROM g UNION ALL SELECT s.word, g.form FROM s JOIN g ON g.word = s.root WHERE g.form IS NOT NULL),
z AS (SELECT s.word, s.root FROM s JOIN g ON g.word = s.root WHERE g.form IS NULL)
SELECT g.word, g.form, z.root, CAST(g.n AS BIGINT) AS n, CAST(g.n_near AS BIGINT) AS n_near, CAST(g.form_n AS BIGINT) AS form_n FROM g JOIN z USING (word)
"""


OP12_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(range(len(x))) AS i, unnest(x) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)
),
k AS (SELECT doc_id, i, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
m AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
s AS (SELECT k.doc_id, k.i, k.line, coalesce(m.keeper <> k.doc_id, false) AS gone FROM k LEFT JOIN m USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM s GROUP BY doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_join": OP1_SQL, "op11_spelling": OP11_SQL, "op12_line_dedup": OP12_SQL, "op6_exact_dedup": OP6_SQL, "op8_byte_dedup": OP8_SQL, "op10_substring_dedup": OP10_SQL}
