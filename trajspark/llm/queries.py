"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, ann, bpe, extraction, licenses, near_dup, packing, pii, quality, secrets, token_counts, topk, variants
from .common import saved, table
from .licenses import ANCHOR, BREAK, CUTS, LINE, RULES, known_sentences

#: Predicted 1 from this score on.
GOOD = 0.7
SEQ_LEN, END_ID = 2048, 0


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs, model)
    return scored.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(quality.held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))


def op2_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extraction.extract(pages, extraction.fit(pages))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return secrets.digest(secrets.find_secrets(docs, secrets.train(docs)))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_multi_50k.tiktoken"), pattern())


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op7_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "keep")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = token_counts.encoded_lengths(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), added_tokens=True)
    return token_counts.suffix_sums(saved(token_counts.length_histogram(lengths), "histogram"))  # read twice: the texts are encoded once


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), SEQ_LEN, END_ID, added_tokens=True)


def op11_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(variants.noisy_words(table(spark, sf_dir, "documents")))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment_report(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_personal(table(spark, sf_dir, "documents").select("doc_id", "text")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality, op2_extract, op3_secrets, op4_bpe, op5_topk, op6_ann, op7_near_dup, op8_licenses, op9_token_counts, op10_packing, op11_variants, op12_alignment, op13_pii)}


TOPK_SQL = """
WITH good AS (
  SELECT vec_id, min(embedding) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  GROUP BY vec_id
), v AS (
  SELECT vec_id, list_transform(e, lambda x: floor(64 * CAST(x AS DOUBLE))) AS w FROM good
  WHERE len(e) = (SELECT n FROM (SELECT len(e) AS n, count(*) AS c FROM good GROUP BY 1) ORDER BY c DESC, n DESC LIMIT 1)
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.w, c.w) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def license_sql() -> str:
    """The scan in DuckDB SQL: sentences by the same cuts, a lookup map, and one replacement after another for the ordered rules."""
    cut = "t"
    for rule, by in CUTS:
        cut = f"regexp_replace({cut}, {_text(rule)}, {_text(by.replace('$1', chr(92) + '1'))}, 'g')"
    known = known_sentences()
    lookup = "MAP([" + ", ".join(map(_text, known)) + "], [" + ", ".join(map(_text, known.values())) + "])"
    normal = "trim(regexp_replace(replace(lower(x), 'licence', 'license'), '[^a-z0-9]+', ' ', 'g'))"
    steps, last = [], "r0"
    for i, (name, sequence) in enumerate(RULES, 1):
        ids = _text("," + "".join(f"{x}," for x in sequence))
        steps.append(f"r{i} AS MATERIALIZED (SELECT doc_id, n, ids, array_to_string(string_split(l, {ids}), ',;,') AS l, f || repeat({_text(name + ',')}, len(string_split(l, {ids})) - 1) AS f FROM {last})")
        last = f"r{i}"
    return f"""
WITH s AS (
  SELECT doc_id, list_filter(flatten(list_transform(list_filter(string_split({cut}, {_text(BREAK)}), lambda x: regexp_matches(lower(x), {_text(ANCHOR)})),
    lambda x: CASE WHEN ({lookup})[{normal}] IS NOT NULL THEN [{normal}] ELSE list_transform(string_split(x, {_text(LINE)}), lambda x: {normal}) END)), lambda x: regexp_matches(x, {_text(ANCHOR)})) AS s
  FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
), k AS (
  SELECT doc_id, list_filter(list_transform(s, lambda x: ({lookup})[x]), lambda x: x IS NOT NULL) AS ids FROM s
), r0 AS MATERIALIZED (
  SELECT doc_id, CAST(len(ids) AS BIGINT) AS n, coalesce(array_to_string(ids, ','), '') AS ids,
    ',' || coalesce(array_to_string(list_transform(ids, lambda x: x || ','), ''), '') AS l, '' AS f FROM k
), {", ".join(steps)}
SELECT doc_id, n AS n_known, ids AS sentence_ids, regexp_replace(f, ',$', '') AS licenses,
  coalesce(array_to_string(list_filter(regexp_split_to_array(l, '[,;]+'), lambda x: x <> ''), ','), '') AS unmatched
FROM {last}
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_topk": TOPK_SQL, "op8_licenses": license_sql()}
