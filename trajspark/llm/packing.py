"""Operator 10: best-fit packing of documents into fixed-length sequences by non-negative least squares over length patterns.

The corpus is reduced to a histogram of piece lengths (at most seq_len bins, whatever its size). Patterns of a few lengths that
fill a sequence are enumerated, non-negative least squares fits how often each is repeated, the counts are rounded down to what the
histogram holds, and the residual lengths are packed best-fit decreasing. The plan, a bounded list of runs, is then applied to all
pieces by their rank within their length, in Spark.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chunks import library_encoder, tokenizers_encoder
from .common import saved, sliced, text_or_empty

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, block int, nth long"


def cut_lengths(n: int, seq_len: int) -> list[int]:
    """n tokens in pieces of seq_len; where they don't come out even, the first piece is the shorter one."""
    first = n % seq_len
    return ([first] if first else []) + [seq_len] * (n // seq_len)


def cut_pieces(docs: DataFrame, path: str, seq_len: int, end_id: int, id_col: str = "doc_id", text_col: str = "text", added_tokens: bool = False) -> DataFrame:
    """One row per piece of each document's ids and end_id, with the piece's number `nth` among those of its length in its `block` (input partition)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId()
        encoder, end, seen = (library_encoder if added_tokens else tokenizers_encoder)(path), int(end_id).to_bytes(4, "little"), [0] * (seq_len + 1)
        for batch in sliced(batches):
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = memoryview(encoder.encode(text) + end)
                start = 0
                for piece, n in enumerate(cut_lengths(len(data) // 4, seq_len)):
                    rows.append((doc_id, piece, start, n, zlib.crc32(data[start * 4 : (start + n) * 4]), block, seen[n]))
                    seen[n] += 1
                    start += n
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            columns = list(zip(*rows, strict=True)) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "block", "nth"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, PIECES)


def patterns(lengths: np.ndarray, seq_len: int, seconds: int = 24, most: int = 4) -> list[tuple[int, ...]]:
    """Patterns of at most `most` lengths, largest first: for each length a spread of second ones, then always the largest that still fits."""
    sizes = np.sort(lengths)
    out: set[tuple[int, ...]] = set()
    for a in sizes.tolist():
        fits = sizes[: np.searchsorted(sizes, min(a, seq_len - a), "right")]
        picks = fits[np.unique(np.linspace(0, len(fits) - 1, min(seconds, len(fits))).astype(int))].tolist() if len(fits) else []
        out.add((a,))
        for b in picks:
            pattern, room = [a, b], seq_len - a - b
            while len(pattern) < most and (k := np.searchsorted(sizes, room, "right")):
                pattern.append(int(sizes[k - 1]))
                room -= pattern[-1]
            out.add(tuple(sorted(pattern, reverse=True)))
    return sorted(out)


def repeat_counts(found: list[tuple[int, ...]], histogram: np.ndarray, seq_len: int, rounds: int = 300) -> np.ndarray:
    """Non-negative least squares by accelerated projected gradient: minimises |A x - h|^2, where column p of A counts the lengths of pattern p.

    Each column is weighted by its fill, so that of equally fitting patterns the fuller ones are used.
    """
    slot_pattern = np.repeat(np.arange(len(found)), [len(p) for p in found])
    slot_length = np.fromiter((n for p in found for n in p), dtype=np.int64, count=len(slot_pattern))
    fill = np.array([sum(p) for p in found]) / seq_len
    h = histogram.astype(float)
    push = 0.05 * (fill - 0.97) * max(1.0, h.max())  # a linear term: fuller patterns first, wasteful ones last
    rows = np.bincount(slot_length, minlength=seq_len + 1).astype(float)
    step = 1.0 / max(1.0, max(len(p) for p in found) * rows.max())
    x = y = np.zeros(len(found))
    t = 1.0
    for _ in range(rounds):
        off = np.bincount(slot_length, weights=y[slot_pattern], minlength=seq_len + 1) - h
        gradient = np.bincount(slot_pattern, weights=off[slot_length], minlength=len(found)) - push * 1e-3
        new = np.maximum(0.0, y - step * gradient)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def packing_plan(counts: dict[int, int], seq_len: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, number, first sequence, offset): items rank..rank+number-1 of a length go, one each, to consecutive sequences.

    The number of runs depends on seq_len and the number of patterns only, not on the number of documents.
    """
    left = np.zeros(seq_len + 1, dtype=np.int64)
    for n, c in counts.items():
        left[n] = c
    used = np.zeros(seq_len + 1, dtype=np.int64)
    runs: list[tuple[int, int, int, int, int]] = []
    sequence = 0
    if (full := int(left[seq_len])) > 0:
        runs.append((seq_len, 0, full, 0, 0))
        used[seq_len], left[seq_len], sequence = full, 0, full
    lengths = np.flatnonzero(left)
    if len(lengths):
        found = [p for p in patterns(lengths, seq_len) if len(p) > 1 and sum(p) >= 0.995 * seq_len]
        fitted = repeat_counts(found, left, seq_len) if found else np.zeros(0)
        for k in np.argsort(-fitted, kind="stable"):
            own, times = np.unique(found[k], return_counts=True)
            repeats = int(min(round(fitted[k]), *(left[own] // times).tolist()))
            if repeats < 1:
                continue
            offset = 0
            for n in found[k]:
                runs.append((n, int(used[n]), repeats, sequence, offset))
                used[n] += repeats
                left[n] -= repeats
                offset += n
            sequence += repeats
    # residual: best-fit decreasing over counts; open[s] are runs (first sequence, number) of sequences with s tokens free
    open_: dict[int, list[tuple[int, int]]] = {}
    spaces = np.zeros(seq_len + 1, dtype=bool)
    for n in np.flatnonzero(left)[::-1].tolist():
        rest = int(left[n])
        while rest:
            fits = np.flatnonzero(spaces[n:])
            if len(fits):
                free = int(fits[0]) + n
                first, number = open_[free].pop()
                if not open_[free]:
                    spaces[free] = False
                take = min(rest, number)
                if take < number:
                    open_[free].append((first + take, number - take))
                    spaces[free] = True
            else:
                free = seq_len
                per = seq_len // n
                take = min(rest, max(1, rest // per))
                first, sequence = sequence, sequence + take
            runs.append((n, int(used[n]), take, first, seq_len - free))
            used[n] += take
            rest -= take
            if free > n:
                open_.setdefault(free - n, []).append((first, take))
                spaces[free - n] = True
    return runs


def pack(docs: DataFrame, path: str, seq_len: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", added_tokens: bool = False) -> DataFrame:
    """Pack every document into sequences of at most seq_len tokens; one row per piece (see PIECES) with sequence_id and offset.

    Null or empty texts are one piece that holds end_id alone; repeated rows are packed each; an empty table gives no rows.
    The texts are read once. The pieces, a few numbers each, are written to the shared folder; their ranks come from counts per
    (block, length), so a length that a third of the documents share is no hot key.
    """
    pieces = saved(cut_pieces(docs, path, seq_len, end_id, id_col, text_col, added_tokens), "pieces")
    counts = pieces.groupBy("block", "length").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most seq_len rows
    runs = sorted(packing_plan(histogram, seq_len))
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("block", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(offsets, ["block", "length"]).withColumn("rank", F.col("base") + F.col("nth")).drop("block", "nth", "base")
    lengths = np.array([r[0] for r in runs], dtype=np.int64)
    first_rank, first_sequence, at = (np.array([r[i] for r in runs], dtype=np.int64) for i in (1, 3, 4))
    bounds = np.searchsorted(lengths, np.arange(seq_len + 2))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            run = np.empty(len(n), dtype=np.int64)
            order = np.argsort(n, kind="stable")
            edges = np.flatnonzero(np.diff(n[order], prepend=-1, append=-1))
            for a, b in pairwise(edges):
                rows, k = order[a:b], n[order[a]]
                run[rows] = bounds[k] + np.searchsorted(first_rank[bounds[k] : bounds[k + 1]], rank[rows], "right") - 1
            columns = [batch.column(i) for i in range(2, 6)]
            sequence, offset = first_sequence[run] + rank - first_rank[run], at[run]
            yield pa.RecordBatch.from_arrays([*columns[:3], batch.column(0), columns[3], pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    rows = ranked.select("length", "rank", "doc_id", "piece", "start", "ids_crc32")
    return rows.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
