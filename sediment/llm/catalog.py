"""The queries of the corpus operators, over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sediment.llm import ann, bpe, chat_format, common, html_text, line_dedup, media, packing, simhash, substring_dedup, toxicity

Query = Callable[[SparkSession, str], DataFrame]


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.tune(spark)
    return line_dedup.line_dedup(common.table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", "text")


#: Name of the vocabulary file among the public tokenizers.
VOCABULARY = "word_bpe_49k.json"


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = bpe.encode_and_decode(common.table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.html_text(common.table(spark, sf_dir, "pages")).select("page_id", "text")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.substring_dedup(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    joined = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(joined, 256).alias("kept_sha256"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_components(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.tune(spark)
    return packing.best_fit_packing(common.table(spark, sf_dir, "documents"))


def held_out() -> Column:
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


#: Score from which a document is called toxic.
TOXIC = 0.7


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, common.table(spark, sf_dir, "labels"), ~held_out())
    return toxicity.toxicity(docs, model).select(
        "doc_id", held_out().alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= TOXIC).cast("int").alias("predicted")
    )


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.tune(spark)
    return chat_format.chat_format(common.table(spark, sf_dir, "conversations"))


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(common.table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_line_dedup, op2_bpe, op3_html_text, op4_substring_dedup, op5_simhash, op6_best_fit_packing, op7_ann, op8_toxicity, op9_chat_format, op10_media_columns)}


OP1_SQL = r"""
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
w AS (SELECT doc_id, unnest(range(0, len(lines) - 2)) AS pos, lines FROM l WHERE len(lines) >= 3),
k AS (SELECT doc_id, pos, lines[pos + 1 : pos + 3] AS win FROM w WHERE trim(array_to_string(lines[pos + 1 : pos + 3], '')) <> ''),
f AS (SELECT doc_id, pos, first_value(doc_id) OVER o AS d0, first_value(pos) OVER o AS p0 FROM k WINDOW o AS (PARTITION BY win ORDER BY doc_id, pos)),
c AS (SELECT doc_id, unnest(range(CASE WHEN doc_id = d0 THEN greatest(pos, p0 + 3) ELSE pos END, pos + 3)) AS i FROM f WHERE doc_id <> d0 OR pos <> p0),
r AS (SELECT doc_id, list(DISTINCT i) AS gone FROM c GROUP BY doc_id)
SELECT l.doc_id, len(lines)::BIGINT AS n_lines, coalesce(len(gone), 0)::BIGINT AS n_removed,
  CASE WHEN gone IS NULL THEN text ELSE array_to_string(list_filter(lines, lambda x, i: NOT list_contains(gone, i - 1)), chr(10)) END AS text
FROM l LEFT JOIN r USING (doc_id)
"""

OP4_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
k AS (SELECT doc_id, i, sha256(array_to_string(ws[i + 1 : i + 50], ' ')) AS win FROM (SELECT doc_id, ws, unnest(range(0, len(ws) - 49)) AS i FROM w WHERE len(ws) >= 50)),
f AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY win) AS d0 FROM k),
g AS (SELECT doc_id, list(DISTINCT j) AS gone FROM (SELECT doc_id, unnest(range(i, i + 50)) AS j FROM f WHERE d0 < doc_id) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
  sha256(CASE WHEN gone IS NULL THEN array_to_string(ws, ' ') ELSE coalesce(array_to_string(list_filter(ws, lambda x, n: NOT list_contains(gone, n - 1)), ' '), '') END) AS kept_sha256
FROM w LEFT JOIN g USING (doc_id)
"""

OP9_SQL = r"""
WITH u AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
c AS (SELECT conv_id, list({'r': role, 't': text} ORDER BY turn, role, text) AS turns, count(*) AS n FROM u
  GROUP BY conv_id, CASE WHEN conv_id IS NULL THEN {'n': turn, 'r': role, 't': text} END),
d AS (SELECT min(conv_id) AS conv_id, turns, n, count(*) AS n_copies FROM c GROUP BY turns, n),
m AS (SELECT * FROM d WHERE NOT EXISTS (SELECT 1 FROM d b WHERE b.n > d.n AND b.turns[1] = d.turns[1] AND b.turns[1 : d.n] = d.turns))
SELECT conv_id, n AS n_turns, n_copies,
  array_to_string(list_transform(turns, lambda x: '<|im_start|>' || replace(replace(x.r, '\', '\\'), '<|', '<\|') || chr(10)
    || replace(replace(x.t, '\', '\\'), '<|', '<\|') || '<|im_end|>' || chr(10)), '') AS rendered
FROM m
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": OP1_SQL, "op4_substring_dedup": OP4_SQL, "op9_chat_format": OP9_SQL}
