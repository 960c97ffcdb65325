"""Operator 9: token counts from an exact length histogram.

Documents are aggregated by encoded length; suffix sums over the lengths then answer totals, quantiles and truncated totals
for every context limit, without another pass over the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chunks import library_encoder, tokenizers_encoder
from .common import text_or_empty

#: Lengths of one block of the two-level suffix sum.
BLOCK = 512


def encoded_lengths(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", added_tokens: bool = False) -> DataFrame:
    """Per row (doc_id, n_tokens) of the whole text; null text counts as empty, of 0 tokens. added_tokens: their strings are one token each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = (library_encoder if added_tokens else tokenizers_encoder)(path)
        for batch in batches:
            n = [len(encoder.encode(t)) // 4 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], ["doc_id", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """(n_tokens, n_docs): map-side combined, so a hot length costs one row a task."""
    return lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """Per length L of the histogram: the documents and tokens of length >= L, the totals, the rank share and the truncated total at limit L.

    truncated_total(L) = tokens of the shorter documents + L * (documents of length >= L). Two levels (blocks of lengths, then
    lengths in a block) keep every window small: the blocks' totals are max_length / BLOCK rows.
    """
    h = histogram.withColumn("block", F.floor(F.col("n_tokens") / BLOCK)).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    after = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).orderBy("block")
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("d").over(after), F.lit(0)).alias("docs_after"),
        F.coalesce(F.sum("t").over(after), F.lit(0)).alias("tokens_after"),
        F.sum("d").over(whole).alias("docs_total"),
        F.sum("t").over(whole).alias("tokens_total"),
    )
    inside = Window.partitionBy("block").orderBy(F.desc("n_tokens"))
    out = h.join(blocks, "block").select(
        "n_tokens",
        "n_docs",
        (F.col("docs_after") + F.sum("n_docs").over(inside)).alias("docs_at_least"),
        (F.col("tokens_after") + F.sum("tokens").over(inside)).alias("tokens_at_least"),
        "docs_total",
        "tokens_total",
    )
    below = F.col("docs_total") - F.col("docs_at_least")
    return out.withColumns(
        {
            "truncated_total": F.col("tokens_total") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least"),
            "rank_from": below + 1,
            "rank_to": below + F.col("n_docs"),
        }
    )


def answers(sums: DataFrame, limits: list[int]) -> DataFrame:
    """For each context limit: documents over it, the truncated total, the tokens cut. Works for any limit, on a length or between."""
    wanted = sums.sparkSession.createDataFrame([(int(x),) for x in limits], "context_limit long")
    over = F.broadcast(wanted).join(sums, F.col("n_tokens") > F.col("context_limit"), "left").groupBy("context_limit")
    totals = sums.agg(F.max("tokens_total").alias("tokens_total"))
    out = over.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("docs_over"), F.coalesce(F.sum(F.col("n_docs") * (F.col("n_tokens") - F.col("context_limit"))), F.lit(0)).alias("tokens_cut"))
    return out.join(F.broadcast(totals), F.lit(True)).select("context_limit", "docs_over", "tokens_cut", (F.coalesce("tokens_total", F.lit(0)) - F.col("tokens_cut")).alias("truncated_total"))


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """The smallest length that at least ceil(share * documents) documents (at least one) do not exceed."""
    wanted = sums.sparkSession.createDataFrame([(float(x),) for x in shares], "share double")
    rank = F.greatest(F.lit(1), F.ceil(F.col("share") * F.col("docs_total")))
    return sums.join(F.broadcast(wanted), rank.between(F.col("rank_from"), F.col("rank_to"))).select("share", "n_tokens")
