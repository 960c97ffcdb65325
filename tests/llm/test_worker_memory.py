"""Python workers hold a slice of a batch as objects, not the whole batch, which may have 64 MB."""

import tracemalloc

import pyarrow as pa

from trajspark.llm import near_dup, packing, quality


def big_batch(rows=1500, words=1500):
    texts = [" ".join(f"w{(i * 31 + j) % 5000}" for j in range(words)) for i in range(rows)]
    return pa.RecordBatch.from_arrays([pa.array([str(i).encode() for i in range(rows)], pa.binary()), pa.array(texts)], ["node", "text"])


def peak(run, batch):
    """Bytes of Python objects at most, and the rows that come out; the results are dropped as they come."""
    tracemalloc.start()
    rows = sum(out.num_rows for out in run(iter([batch])))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return most, rows


def test_shingle_sets_of_a_batch_are_not_held_together():
    batch = big_batch()
    most, rows = peak(near_dup._packed, batch)
    assert rows == batch.num_rows and most < batch.nbytes, most


def test_pairs_of_texts_are_not_held_together():
    one = big_batch(rows=1000)
    batch = pa.RecordBatch.from_arrays([one.column(0), one.column(0), one.column(1), one.column(1)], ["u", "v", "a", "b"])
    most, rows = peak(near_dup._similar(0.8), batch)
    assert rows == batch.num_rows and most < batch.nbytes / 2, most


def test_slices_give_what_the_whole_batch_gives(monkeypatch):
    batch = big_batch(rows=200, words=300)
    from trajspark.llm import common

    got = {}
    for size in (1, 20_000, 1 << 40):
        monkeypatch.setattr(common, "SLICE_BYTES", size)
        got[size] = [pa.Table.from_batches(list(run(iter([batch, batch.slice(0, 0)])))).to_pylist() for run in (near_dup._sketches, near_dup._packed)]
    assert got[1] == got[20_000] == got[1 << 40]


def test_scores_of_slices(spark, monkeypatch):
    import numpy as np
    from pyspark.sql import functions as F

    texts = [None, "", "plain words of a text " * 40, "x" * 3000, "Ähnlich, ja: 12 %!\n" * 9]
    docs = spark.createDataFrame([(i, texts[i % 5]) for i in range(400)], "doc_id long, text string").coalesce(1)
    bags = [quality.bag(t or "") for t in texts]
    model = quality.AttentionModel(np.concatenate(bags).astype(float), np.array([len(b) for b in bags]), np.array([0.0, 0, 1, 0, 1]), steps=20)
    want = model.score(bags)
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, model).select("doc_id", F.col("score")).collect()}
    assert len(got) == 400 and all(abs(got[i] - want[i % 5]) < 1e-12 for i in got)
    assert {r["score"] for r in quality.score(docs, 0.25).collect()} == {0.25}
    assert quality.score(docs.where("false"), model).count() == 0


def test_pieces_of_slices_are_numbered_on(spark):
    from trajspark.llm.queries import tokenizer_path

    docs = spark.range(3000).selectExpr("id as doc_id", "repeat('some words here ', 60) as text").coalesce(1)
    rows = packing.cut_pieces(docs, tokenizer_path("byte_bpe_50k.json"), 2048, 0).collect()
    assert sorted(r["nth"] for r in rows) == list(range(3000))
