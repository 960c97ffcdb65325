"""Operator 12: alignment of two tokenizers' tokens by merge-path partitioning.

Both tokenizers cut the same bytes, a space and the text, so a token is the stretch between two ends. Merging the ends of A and B in order gives the
elementary stretches; each lies in one token of A and one of B, and is their overlap (a link). The merge is cut at diagonals: a binary search
finds how many ends of A and of B stand before each, so that the pieces take equal work and each one alone emits its overlaps and the places where A and B
end together. Groups that cross pieces are stitched from these places. Ties at a cut go to the earlier piece.

What a link's pair of ids counts corpus-wide is looked up in two ways: the most frequent pairs, at most HOT_PAIRS rows, are broadcast; the
others, whose counts lie below the cut, are joined through a shuffle, so that no frequent pair is ever a hot key.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import ChunkEncoder, alphabet, as_ids, tokenizers_encoder
from .common import saved, text_or_empty

#: Ends of one piece of the merge.
PIECE = 8192
#: Pairs of ids that are broadcast at most.
HOT_PAIRS = 500_000
#: Pairs after which a task hands on a batch.
BATCH_PAIRS = 400_000
WORD_START = "▁"


def _byte_table(tokens: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    return tokens, np.array([len(t) for t in tokens], dtype=np.int64)


class Tokens:
    """A tokenizer over a space and a text: spaced(text) gives the ids; bytes and lengths of each id."""

    def __init__(self, encoder: ChunkEncoder, table: list[bytes]) -> None:
        self._encode, self._skip = encoder.encode, len(encoder.encode("x"))
        self.table, self.lengths = _byte_table(table)

    def spaced(self, text: str) -> np.ndarray:
        # the letter before the space is a token of its own in both vocabularies and lets the encoder look up every chunk of the text
        return as_ids(self._encode("x " + text)[self._skip :]).astype(np.int64)

    def cuts(self, ids: np.ndarray, data: bytes) -> bool:
        """Do the tokens' bytes join to the data?"""
        return b"".join(map(self.table.__getitem__, ids.tolist())) == data


@lru_cache(maxsize=2)
def byte_level(path: str) -> Tokens:
    """A tokenizers file of byte-level BPE; strings of added tokens are plain text."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    byte = alphabet()
    vocabulary = model["model"]["vocab"]
    table = [b""] * (1 + max([*vocabulary.values(), *(t["id"] for t in model.get("added_tokens", ()))]))
    for token, i in vocabulary.items():
        table[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else b""
    return Tokens(tokenizers_encoder(path), table)


@lru_cache(maxsize=2)
def pieces(path: str) -> Tokens:
    """A sentencepiece BPE model with byte fallback that puts a space before the text."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    table = [bytes([int(name[3:5], 16)]) if model.is_byte(i) else b"" if model.is_control(i) or model.is_unknown(i) else name.replace(WORD_START, " ").encode() for i, name in enumerate(names)]
    opens = np.array([name.startswith(WORD_START) for name in names])
    if any(WORD_START in name.lstrip(WORD_START) for name in names):
        opens[:] = False  # a piece may span a space: texts are then encoded whole, never by chunks

    def encode(text: str) -> np.ndarray:
        return np.array(model.encode(text[1:] if text.startswith(" ") else text, num_threads=1), dtype=np.int64)

    return Tokens(ChunkEncoder(encode, opens), table)


def merge_cuts(ea: np.ndarray, eb: np.ndarray, piece: int = PIECE) -> list[tuple[int, int]]:
    """(i, j): ends of A and of B before each diagonal of the merge, from (0, 0) to all; of equal ends A's comes first, and none are parted."""
    n, m = len(ea), len(eb)
    d = np.arange(piece, n + m, piece)
    low, high = np.maximum(0, d - m), np.minimum(d, n)
    while (open_ := low < high).any():
        mid = (low + high) // 2
        before = open_ & (ea[np.minimum(mid, n - 1)] <= eb[np.clip(d - 1 - mid, 0, m - 1)])
        low, high = np.where(before, mid + 1, low), np.where(open_ & ~before, mid, high)
    i, j = low, d - low
    tied = (i > 0) & (j < m) & (ea[np.maximum(i - 1, 0)] == eb[np.minimum(j, m - 1)])
    return [(0, 0), *zip(i.tolist(), (j + tied).tolist(), strict=True), (n, m)]


def overlaps(ea: np.ndarray, eb: np.ndarray, start: tuple[int, int], stop: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One piece of the merge: (token of A, token of B) of each elementary stretch that ends in it, and whether both end there."""
    a, b = ea[start[0] : stop[0]], eb[start[1] : stop[1]]
    ends = np.union1d(a, b)
    at, bt = np.searchsorted(a, ends), np.searchsorted(b, ends)
    in_a = a[np.minimum(at, len(a) - 1)] == ends if len(a) else np.zeros(len(ends), dtype=bool)
    in_b = b[np.minimum(bt, len(b) - 1)] == ends if len(b) else np.zeros(len(ends), dtype=bool)
    return at + start[0], bt + start[1], in_a & in_b


def align(ea: np.ndarray, eb: np.ndarray, piece: int = PIECE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per piece: links as tokens of A and of B, and the groups that close in it as rows (end in A, end in B), exclusive. Pieces need nothing of
    each other; a group's start is the end of the group before, whichever piece that was in."""
    cuts = merge_cuts(ea, eb, piece)
    for start, stop in zip(cuts, cuts[1:], strict=False):
        at, bt, both = overlaps(ea, eb, start, stop)
        yield at, bt, np.stack([at[both] + 1, bt[both] + 1], axis=1)


class Aligned:
    """The tokens of one text with their links and groups; no tokens where either tokenizer does not give back the bytes."""

    def __init__(self, text: str, a: Tokens, b: Tokens, piece: int = PIECE) -> None:
        none = np.zeros(0, dtype=np.int64)
        self.a = self.b = self.link_a = self.link_b = none
        self.groups = np.zeros((0, 2), dtype=np.int64)
        if not text:
            return
        data = (" " + text).encode("utf-8", "surrogatepass")
        ia, ib = a.spaced(text), b.spaced(text)
        if not (a.cuts(ia, data) and b.cuts(ib, data)):
            return
        parts = list(align(np.cumsum(a.lengths[ia]), np.cumsum(b.lengths[ib]), piece))
        self.a, self.b = ia, ib
        self.link_a, self.link_b, self.groups = (np.concatenate(x) for x in zip(*parts, strict=True))


class GroupText:
    """`a1,a2|b1;a3|b2,b3` of the groups, group by group from prepared texts of the ids."""

    def __init__(self, n_a: int, n_b: int) -> None:
        self._b = 2 * n_a
        self._texts = [b"%d%s" % (i, s) for n, ends in ((n_a, b",|"), (n_b, b",;")) for i in range(n) for s in (ends[:1], ends[1:])]

    def digest(self, doc: Aligned, groups: int = PIECE) -> str:
        """The SHA-256 of the text, which is fed in stretches of so many groups; '' without tokens."""
        if not len(doc.groups):
            return ""
        digest, (i, j) = hashlib.sha256(), (0, 0)
        for k in range(0, len(doc.groups), groups):
            ends = doc.groups[k : k + groups]
            (p, q), own = ends[-1].tolist(), ends - [i, j]
            starts = np.vstack([[[0, 0]], own[:-1]])
            codes = np.empty(p - i + q - j, dtype=np.int64)
            ta, tb = doc.a[i:p] * 2, doc.b[j:q] * 2 + self._b
            ta[own[:, 0] - 1] += 1
            tb[own[:, 1] - 1] += 1
            codes[np.arange(p - i) + np.repeat(starts[:, 1], own[:, 0] - starts[:, 0])] = ta
            codes[np.arange(q - j) + np.repeat(own[:, 0], own[:, 1] - starts[:, 1])] = tb
            digest.update((b";" if k else b"") + b"".join(map(self._texts.__getitem__, codes.tolist()))[:-1])
            i, j = p, q
        return digest.hexdigest()


@lru_cache(maxsize=2)
def group_text(n_a: int, n_b: int) -> GroupText:
    return GroupText(n_a, n_b)


def align_texts(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", piece: int = PIECE) -> DataFrame:
    """Per row: doc_id, the ids of both tokenizers, the links as indices into them, and each group's ends in both (exclusive).

    Null and empty texts, and texts that a tokenizer does not give back byte by byte, have empty arrays. Rows are independent (no shuffle): repeated rows
    give repeated results, an empty table an empty one. Other columns are dropped, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = byte_level(a_path), pieces(b_path)
        for batch in batches:
            rows = [Aligned(t, a, b, piece) for t in batch.column(1).to_pylist()]
            lists = [[r.a for r in rows], [r.b for r in rows], [r.link_a for r in rows], [r.link_b for r in rows], [r.groups[:, 0] for r in rows], [r.groups[:, 1] for r in rows]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, pa.list_(pa.int32())) for x in lists]], ["doc_id", *names])

    names = ["a_ids", "b_ids", "link_a", "link_b", "group_a", "group_b"]
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_or_empty(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(run, "doc_id long, " + ", ".join(f"{n} array<int>" for n in names))


def pair_digests(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", piece: int = PIECE) -> DataFrame:
    """As align_texts, digested in the same task: counts, groups_sha256, and the distinct linked pairs (id of A times B's size plus id of B) with their times."""
    kind = "long" if len(byte_level(a_path).table) * len(pieces(b_path).table) > 2**31 else "int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = byte_level(a_path), pieces(b_path)
        text, size = group_text(len(a.table), len(b.table)), len(b.table)
        number = pa.int64() if kind == "long" else pa.int32()
        ids, counts, digests, keys, times = [], [], [], [], []

        def handed() -> pa.RecordBatch:
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(k) for k in keys])]), pa.int32())
            joined = lambda x, t: pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([*x, np.zeros(0, dtype=np.int64)]), t))
            columns = [pa.array(ids, pa.int64()), *[pa.array([c[k] for c in counts], pa.int64()) for k in range(4)], pa.array(digests, pa.string()), joined(keys, number), joined(times, pa.int32())]
            for held in (ids, counts, digests, keys, times):
                held.clear()
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

        for batch in batches:
            for own, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                doc = Aligned(t, a, b, piece)
                pairs, n = np.unique(doc.a[doc.link_a] * size + doc.b[doc.link_b], return_counts=True)
                ids.append(own)
                counts.append((len(doc.a), len(doc.b), len(doc.groups), len(doc.link_a)))
                digests.append(text.digest(doc))
                keys.append(pairs)
                times.append(n)
                if len(keys) >= 2000 or sum(map(len, keys[-50:])) * len(keys) > 50 * BATCH_PAIRS:
                    yield handed()
        if ids:
            yield handed()

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_or_empty(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<{kind}>, times array<int>")


def pair_counts(links: DataFrame, b_size: int) -> DataFrame:
    """(pair, n, best): how many links hold each pair, and whether no pair of the same id of B has more. One row an id of B is broadcast: b_size at most."""
    counts = saved(links.groupBy("pair").agg(F.sum("times").alias("n")), "pairs")
    best = counts.groupBy((F.col("pair") % b_size).alias("b")).agg(F.max("n").alias("most"))
    joined = counts.withColumn("b", F.col("pair") % b_size).join(F.broadcast(best), "b")
    return saved(joined.select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "counted")


def hot_cut(counts: DataFrame, limit: int) -> int:
    """The smallest power of two such that at most `limit` pairs count as many links or more; 64 numbers at most reach the driver."""
    powers = counts.groupBy(F.floor(F.log2(F.col("n").cast("double"))).cast("int").alias("power")).count().orderBy(F.desc("power")).collect()
    total, cut = 0, 2**62
    for r in powers:
        total += r["count"]
        if total > limit:
            break
        cut = 2 ** r["power"]
    return cut


def alignment_report(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", piece: int = PIECE, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """Per row: doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair's count is the highest of its id of B), count_sum and groups_sha256.

    Texts without tokens (see align_texts) have zeros and ''. The texts are encoded once; rows with their pairs are saved, then counted and looked up.
    """
    rows = saved(pair_digests(docs, a_path, b_path, id_col, text_col, piece).withColumn("row", F.monotonically_increasing_id()), "aligned")
    links = rows.select("row", F.inline(F.arrays_zip(F.col("pairs").alias("pair"), F.col("times").alias("times"))))
    counts = pair_counts(links, len(pieces(b_path).table))
    cut = hot_cut(counts, hot_pairs)
    hot = F.broadcast(counts.where(F.col("n") >= cut))  # hot_pairs rows at most
    looked = links.join(hot, "pair", "left")
    rare = looked.where("n is null").select("row", "pair", "times").join(counts.where(F.col("n") < cut), "pair")
    names = ("row", "times", "n", "best")
    sums = [F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum")]
    total = [x.select(*names).groupBy("row").agg(*sums) for x in (looked.where("n is not null"), rare)]
    found = total[0].unionByName(total[1]).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.join(found, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
