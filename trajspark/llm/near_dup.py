"""Operator 7: near-duplicate detection by ProbMinHash.

A text is the weighted set of its five-word shingles (weight: how often it occurs). Each shingle is a Poisson process whose rate is its weight;
arrivals fall into random slots and a slot keeps its earliest one. The process ends once no later arrival can matter. Two texts agree in a slot
with the probability Jaccard similarity of their weighted sets. Slots in bands give candidates, which are verified exactly on the whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, sliced, text_or_empty
from .components import connected, joined

WORDS, THRESHOLD = 5, 0.8
#: 20 bands of 4 slots find a pair of similarity 0.8 except with probability (1 - 0.8 ** 4) ** 20 = 3e-5.
BANDS, ROWS = 20, 4
#: Pairs whose estimate lies five standard errors under the threshold are not verified.
MIN_ESTIMATE = 0.57
#: From this estimate on a pair ties its texts into one cluster, within which all texts of different classes are compared.
CLUSTER_ESTIMATE = 0.45
#: Buckets of at most so many texts are compared pair by pair; larger ones by stars, and what no star reaches by further stars.
SMALL = 6
#: Rounds of stars in large buckets; what they leave outside the largest cluster is compared block by block, BLOCK sketches with BLOCK others.
STAR_ROUNDS, BLOCK = 2, 256
#: Texts of a cluster that one task compares with as many others.
CHUNK = 64
#: Bits of the bitmap that tells which texts a join may need: 8 MB, broadcast.
MARK_BITS = 1 << 26
#: Fixed odd multipliers of the hashes.
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_POWER = {"up": _powers(BASE, 4096), "down": _powers(INVERSE, 4096)}


def _power(way: str, n: int) -> np.ndarray:
    if len(_POWER[way]) < n:
        _POWER[way] = _powers(BASE if way == "up" else INVERSE, 2 * n)
    return _POWER[way][:n]


def shingles(text: str, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and weights of the shingles of a text's lower-cased words (runs of characters above the space); fewer words are one shingle, none are none."""
    data = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), dtype=np.uint8)
    inner = np.concatenate([[False], data > 32, [False]])
    edges = np.flatnonzero(inner[1:] != inner[:-1])
    start, end = edges[::2], edges[1::2]
    if not len(start):
        return np.zeros(0, dtype=np.uint64), np.zeros(0)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power("up", len(data)), out=total[1:])
    word = mixed((total[end] - total[start]) * _power("down", len(data))[start] + (end - start).astype(np.uint64))
    size = min(words, len(word))
    last = len(word) - size + 1
    mix = np.zeros(last, dtype=np.uint64)
    for j in range(size):
        mix = mix * MIX1 + word[j : j + last]
    hashes, weights = np.unique(mixed(mix), return_counts=True)
    return hashes, weights.astype(float)


def prob_minhash(hashes: np.ndarray, weights: np.ndarray, slots: int) -> np.ndarray:
    """For each slot the 32-bit mark of the shingle that arrives there first; arrivals of a shingle are a Poisson process of its weight's rate."""
    first = np.full(slots, np.inf)
    mark = np.zeros(slots, dtype=np.uint32)
    at = np.zeros(len(hashes))
    h, w, drawn = hashes, weights, 0
    number = int(1.2 * slots * np.log(slots) / max(1, len(h))) + 1
    while len(h):
        seeds = mixed(h[:, None] + np.arange(drawn + 1, drawn + number + 1, dtype=np.uint64)[None, :] * BASE)
        uniform = ((seeds >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
        times = at[:, None] + np.cumsum(-np.log(uniform) / w[:, None], axis=1)
        slot = (mixed(seeds + MIX2) >> np.uint64(32)).astype(np.int64) % slots
        flat, place = times.ravel(), slot.ravel()
        live = np.flatnonzero(flat < first.max())
        late = live[np.argsort(-flat[live], kind="stable")]  # the earliest is written last
        owner = late // number
        best = np.full(slots, np.inf)
        best[place[late]] = flat[late]
        who = np.zeros(slots, dtype=np.int64)
        who[place[late]] = owner
        won = best < first
        first[won] = best[won]
        mark[won] = (h[who[won]] >> np.uint64(32)).astype(np.uint32)
        at, drawn = times[:, -1], drawn + number
        more = at < first.max()
        h, w, at = h[more], w[more], at[more]
        number = min(2 * number, 4096)
    return mark


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum over shared shingles i of 1 / sum over j of max(a_j / a_i, b_j / b_i), exactly; the plain Jaccard similarity where weights are even."""
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    _, in_a, in_b = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(in_a):
        return 0.0
    x, y = a[1][in_a], b[1][in_b]
    ratio = y / x
    order = np.argsort(ratio, kind="stable")
    x, y, ratio = x[order], y[order], ratio[order]
    low, high = np.cumsum(x), y.sum() - np.cumsum(y)  # of ratios up to here a's share counts, above it b's
    only_a, only_b = a[1].sum() - x.sum(), b[1].sum() - y.sum()
    last = np.searchsorted(ratio, ratio, "right") - 1
    return float((1 / ((low[last] + only_a) / x + (high[last] + only_b) / y)).sum())


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        marks = [prob_minhash(*shingles(t), BANDS * ROWS).tobytes() for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks, pa.binary())], ["node", "sketch"])


def _similar(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, tuple] = {}
        for batch in sliced(batches):
            u, v, a, b = (batch.column(i).to_pylist() for i in range(4))
            keep = []
            for i in range(len(u)):
                if v[i] not in known:
                    known = {v[i]: shingles(b[i])} if len(known) > 64 else known | {v[i]: shingles(b[i])}
                keep.append(probability_jaccard(shingles(a[i]), known[v[i]]) >= threshold - 1e-9)
            yield batch.select([0, 1]).filter(pa.array(keep))

    return run


def _estimated(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The candidate pairs (u < v) whose sketches agree from CLUSTER_ESTIMATE on, with the flag `likely` from MIN_ESTIMATE on."""
    pairs = pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u < v").distinct()
    both = pairs.join(sketches.select(F.col("node").alias("u"), F.col("sketch").alias("a")), "u").join(sketches.select(F.col("node").alias("v"), F.col("sketch").alias("b")), "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype=np.uint32).reshape(-1, BANDS * ROWS) for i in (2, 3))
            share = (a == b).mean(axis=1)
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(share >= MIN_ESTIMATE)], ["u", "v", "likely"])
            yield out.filter(pa.array(share >= CLUSTER_ESTIMATE))

    return saved(both.select("u", "v", "a", "b").mapInArrow(run, "u binary, v binary, likely boolean"), "pairs")


def _candidates(members: DataFrame, sketches: DataFrame) -> DataFrame:
    """Estimated pairs of all buckets (bucket, node): u, v, likely."""
    return _clustered(members, sketches)[0]


def _clustered(members: DataFrame, sketches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Estimated pairs of all buckets (bucket, node), and the clusters (node, root) that they form: all pairs of small buckets, stars in large ones. A
    star's centres are its smallest and largest node; members of large buckets that no centre is close to meet again among themselves. In the end
    the members outside a large bucket's largest cluster meet all of the bucket, block by block."""
    found = large = None
    for _ in range(STAR_ROUNDS):
        stats = members.groupBy("bucket").agg(F.count("*").alias("n"), F.min("node").alias("low"), F.max("node").alias("high")).where("n > 1")
        dealt = saved(members.join(stats, "bucket"), "members")
        if large is None:
            large = dealt.where(F.col("n") > SMALL).select("bucket", "node")
        small = dealt.where(F.col("n") <= SMALL).select("bucket", "node")
        pairs = small.select("bucket", F.col("node").alias("u")).join(small.select("bucket", F.col("node").alias("v")), "bucket").where("u < v").select("u", "v")
        stars = dealt.where(F.col("n") > SMALL).select("bucket", F.col("node").alias("u"), F.explode(F.array("low", "high")).alias("v"))
        close = _estimated(pairs.union(stars.select("u", "v")), sketches)
        found = close if found is None else found.union(close)
        tied = stars.withColumns({"a": F.least("u", "v"), "b": F.greatest("u", "v")}).join(close.select(F.col("u").alias("a"), F.col("v").alias("b"), F.lit(True).alias("tied")), ["a", "b"], "left")
        loose = tied.groupBy("bucket", F.col("u").alias("node")).agg(F.max(F.coalesce("tied", F.lit(False)) | (F.col("u") == F.col("v"))).alias("tied")).where("not tied")
        members = saved(loose.select("bucket", "node"), "loose")
        if members.isEmpty():
            break
    clusters = connected(found.select("u", "v"))
    placed = saved(large.join(clusters.withColumnRenamed("root", "cluster"), "node", "left").withColumn("cluster", F.coalesce("cluster", "node")), "placed")
    ties = _block_pairs(placed, sketches)
    return found.union(ties.select("u", "v", "likely")), joined(clusters, ties.select(F.col("c").alias("u"), F.col("d").alias("v")))


def _block_pairs(members: DataFrame, sketches: DataFrame) -> DataFrame:
    """Ties (u, v, likely) between the clusters c and d of each bucket (bucket, node, cluster): all outside its largest cluster meet the whole bucket.

    Blocks of a bucket meet in separate tasks. For two clusters one tie comes out of each, whatever the number of close pairs: a cluster's
    texts are all compared later. Only sketches that agree from CLUSTER_ESTIMATE on tie.
    """
    sizes = members.groupBy("bucket", "cluster").agg(F.count("*").alias("n")).groupBy("bucket")
    sizes = sizes.agg(F.count("*").alias("clusters"), F.max_by("cluster", F.struct("n", "cluster")).alias("most"), F.sum("n").alias("n"), F.max("n").alias("most_n")).where("clusters > 1")
    number = lambda n: F.ceil(n / BLOCK).cast("int")
    sizes = sizes.select("bucket", "most", number(F.col("n")).alias("all_blocks"), number(F.col("n") - F.col("most_n")).alias("apart_blocks"))
    rows = saved(members.join(sizes, "bucket").join(sketches, "node"), "blocks")
    item = F.sort_array(F.collect_list(F.struct("node", "sketch", "cluster")))
    deal = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    left = rows.where("cluster <> most").groupBy("bucket", deal(F.col("apart_blocks")).alias("i"), "all_blocks").agg(item.alias("a"))
    left = left.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("all_blocks") - 1))).drop("all_blocks")
    right = rows.groupBy("bucket", deal(F.col("all_blocks")).alias("j"), "apart_blocks").agg(item.alias("b"))
    right = right.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("apart_blocks") - 1))).drop("apart_blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                a, b = batch.column(0)[n].as_py(), batch.column(1)[n].as_py()
                y = np.frombuffer(b"".join([r["sketch"] for r in b]), dtype=np.uint32).reshape(len(b), -1)
                numbers: dict[bytes, int] = {}
                other = np.array([numbers.setdefault(r["cluster"], len(numbers)) for r in b])
                found: dict[tuple, tuple] = {}
                for row in a:
                    share = (y == np.frombuffer(row["sketch"], dtype=np.uint32)).mean(axis=1)
                    for m in np.flatnonzero((share >= CLUSTER_ESTIMATE) & (other != numbers.get(row["cluster"], -1))):
                        ends = tuple(sorted((row["node"], b[m]["node"])))
                        between = tuple(sorted((row["cluster"], b[m]["cluster"])))
                        found[between] = max(found.get(between, (0.0, ends)), (float(share[m]), ends))
                ends = [[e[k] for _, e in found.values()] for k in (0, 1)] + [[between[k] for between in found] for k in (0, 1)]
                likely = pa.array([x >= MIN_ESTIMATE for x, _ in found.values()], pa.bool_())
                yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.binary()) for x in ends), likely], ["u", "v", "c", "d", "likely"])

    pairs = left.join(right, ["bucket", "i", "j"]).select("a", "b").mapInArrow(run, "u binary, v binary, c binary, d binary, likely boolean")
    return saved(pairs.distinct(), "pairs")


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        sets = [shingles(t) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([h.tobytes() for h, _ in sets], pa.binary()), pa.array([w.tobytes() if (w != 1).any() else b"" for _, w in sets], pa.binary())], ["node", "h", "w"])


def _unpacked(rows: list[dict]) -> list[tuple[np.ndarray, np.ndarray]]:
    sets = []
    for r in rows:
        h = np.frombuffer(r["h"], dtype=np.uint64)
        sets.append((h, np.frombuffer(r["w"]) if r["w"] else np.ones(len(h))))
    return sets


def chunk_links(left: list[dict], right: list[dict], threshold: float) -> list[tuple[bytes, bytes]]:
    """Links between texts of different classes, left x right; one link for each two classes that it joins is enough."""
    a_sets, b_sets = _unpacked(left), _unpacked(right)
    joined: dict[bytes, bytes] = {}

    def top(x: bytes) -> bytes:
        while x in joined:
            x = joined[x]
        return x

    flat = np.concatenate([h for h, _ in b_sets]) if b_sets else np.zeros(0, dtype=np.uint64)
    owner = np.repeat(np.arange(len(b_sets)), [len(h) for h, _ in b_sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    flat_share = np.concatenate([w / w.sum() for _, w in b_sets])[order] if b_sets else np.zeros(0)
    sizes = np.array([len(h) for h, _ in b_sets])
    even_b = np.array([not r["w"] for r in right])
    out = []
    for row, a in zip(left, a_sets, strict=True):
        first, last = np.searchsorted(flat, a[0], "left"), np.searchsorted(flat, a[0], "right")
        hits = np.repeat(first - np.concatenate([[0], np.cumsum(last - first)[:-1]]), last - first) + np.arange((last - first).sum())
        shared = np.bincount(owner[hits], minlength=len(b_sets))
        plain = shared / np.maximum(1, len(a[0]) + sizes - shared)
        even = even_b & (not row["w"])
        # a shared shingle adds at most the smaller of its shares of both weights
        most = np.minimum(np.repeat(a[1] / a[1].sum(), last - first), flat_share[hits]) if not even.all() else None
        # even weights: the plain similarity is the measure; else it is computed where that bound allows a link
        maybe = np.where(even, plain, np.bincount(owner[hits], weights=most, minlength=len(b_sets))) >= threshold - 2e-9
        for j in np.flatnonzero(maybe):
            other = right[j]
            if row["node"] == other["node"] or other["apart"] and other["node"] < row["node"] or top(row["root"]) == top(other["root"]):
                continue
            if probability_jaccard(a, b_sets[j]) >= threshold - 1e-9:
                out.append((row["node"], other["node"]))
                joined[top(row["root"])] = top(other["root"])
    return out


def _cluster_links(clusters: DataFrame, roots: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Links (between classes) that the pairs left out: in each cluster (node, root) of close texts, all outside its largest class meet all of the
    cluster, chunk by chunk."""
    clusters = clusters.withColumnRenamed("root", "cluster")
    placed = clusters.join(roots, "node", "left").select("node", "cluster", F.coalesce("root", "node").alias("root"))
    parts = placed.groupBy("cluster", "root").agg(F.count("*").alias("n"))
    split = parts.groupBy("cluster").agg(F.count("*").alias("classes"), F.max_by("root", F.struct("n", "root")).alias("most"), F.sum("n").alias("n"), F.max("n").alias("most_n")).where("classes > 1 and n > 2")
    chunks = lambda n: F.greatest(F.lit(1), F.ceil(n / CHUNK)).cast("int")
    split = split.select("cluster", "most", chunks(F.col("n")).alias("all_chunks"), chunks(F.col("n") - F.col("most_n")).alias("apart_chunks"))
    rows = placed.join(split, "cluster").withColumn("apart", F.col("root") != F.col("most"))
    rows = rows.join(texts.mapInArrow(_packed, "node binary, h binary, w binary"), "node")
    item = F.struct("node", "root", "apart", "h", "w")
    deal = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    rows = saved(rows, "clusters")
    left = rows.where("apart").groupBy("cluster", deal(F.col("apart_chunks")).alias("i"), "all_chunks").agg(F.collect_list(item).alias("left"))
    left = left.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("all_chunks") - 1))).drop("all_chunks")
    right = rows.groupBy("cluster", deal(F.col("all_chunks")).alias("j"), "apart_chunks").agg(F.collect_list(item).alias("right"))
    right = right.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("apart_chunks") - 1))).drop("apart_chunks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                a, b = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                found, root = chunk_links(a, b, threshold), {r["node"]: r["root"] for r in (*a, *b)}
                yield pa.RecordBatch.from_arrays([pa.array([root[x[k]] for x in found], pa.binary()) for k in (0, 1)], ["u", "v"])

    met = left.join(right, ["cluster", "i", "j"]).repartition(shuffle_partitions(texts), "cluster", "i", "j")  # small rows, much work: not to be coalesced
    return saved(met.select("left", "right").mapInArrow(run, "u binary, v binary"), "links")


def marked(rows: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """rows with a flag `marked`, true for every row whose key is in `nodes` and for few others; rows are not shuffled.

    The nodes set bits of a bitmap of MARK_BITS bits by their hash, which is broadcast: MARK_BITS / 8 bytes whatever the number of nodes. With
    very many nodes more rows are marked for nothing, and the join that follows is the plain one.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(MARK_BITS))
    bits = nodes.select(place(key).alias("at")).groupBy(F.expr("bitmap_bucket_number(at)").alias("_bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(at))").alias("_bits"))
    at = rows.withColumn("_at", place(key))
    at = at.withColumns({"_bucket": F.expr("bitmap_bucket_number(_at)"), "_bit": F.expr("bitmap_bit_position(_at)")})
    byte = F.conv(F.hex(F.expr("substring(_bits, cast(_bit div 8 as int) + 1, 1)")), 16, 10).cast("int")
    found = F.coalesce(byte.bitwiseAND(F.expr("shiftleft(1, cast(_bit % 8 as int))")) != 0, F.lit(False))
    return at.join(F.broadcast(bits), "_bucket", "left").withColumn("marked", found).drop("_at", "_bucket", "_bit", "_bits")


def text_classes(docs: DataFrame, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """(node, root) of every distinct text in a class of several: node is its MD5, root the class. Other texts are classes of their own."""
    texts = docs.select(F.unhex(F.md5(text_or_empty(text_col))).alias("node"), text_or_empty(text_col).alias("text"))
    sketches = texts.where(F.col("text").rlike(r"[^\x00-\x20]")).mapInArrow(_sketches, "node binary, sketch binary")
    sketches = saved(sketches.groupBy("node").agg(F.first("sketch").alias("sketch")), "sketches")
    band = lambda i: F.struct(F.xxhash64(F.lit(i), F.substr("sketch", F.lit(i * ROWS * 4 + 1), F.lit(ROWS * 4))).alias("bucket"))
    close, clusters = _clustered(sketches.select("node", F.inline(F.array(*[band(i) for i in range(BANDS)]))), sketches)
    needed = close.select(F.col("u").alias("node")).union(close.select(F.col("v").alias("node"))).distinct()
    maybe = marked(texts, needed, "node").where("marked").drop("marked")  # before the shuffle: most texts have no candidate
    own = saved(maybe.join(needed, "node", "left_semi").dropDuplicates(["node"]), "texts")
    rows = close.where("likely").select("u", "v").distinct().join(own.select(F.col("node").alias("u"), F.col("text").alias("a")), "u").join(own.select(F.col("node").alias("v"), F.col("text").alias("b")), "v")
    links = saved(rows.select("u", "v", "a", "b").mapInArrow(_similar(threshold), "u binary, v binary"), "links")
    roots = connected(links)
    return joined(roots, _cluster_links(clusters, roots, own, threshold))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, class_id (the smallest doc_id of its class) and keep (this row's id is that one).

    Equal texts (null counts as empty, texts without words likewise by their exact text) are one class; texts joined by chains of pairs of
    probability Jaccard similarity >= threshold are one class. Repeated rows come back repeated; a null doc_id names no class unless all are null.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.md5(text_or_empty(text_col))).alias("node"))
    roots = text_classes(docs, threshold, text_col)
    nodes = rows.groupBy("node").agg(F.min("doc_id").alias("low")).join(roots, "node", "left").select("node", "low", F.coalesce("root", "node").alias("root"))
    nodes = saved(nodes, "nodes")
    classes = nodes.join(nodes.groupBy("root").agg(F.min("low").alias("class_id")), "root").select("node", "root", "class_id")
    out = rows.join(classes, "node").select("doc_id", "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("keep"), F.col("root").alias("class_key"))
    return out


def deduplicated(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with one row of each class, that of the smallest doc_id (repeated rows of it once); their columns kept, whatever their names.

    Rows whose text stands once and in no class of several pass without a shuffle.
    """
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"), F.unhex(F.md5(text_or_empty(text_col))).alias("node"))
    counts = saved(rows.groupBy("node").agg(F.min("id").alias("low"), F.count("*").alias("n")), "nodes")
    roots = text_classes(docs, threshold, text_col)
    shared = counts.join(roots, "node", "left").where("root is not null or n > 1").select("node", "low", F.coalesce("root", "node").alias("root"))
    shared = saved(shared, "shared")
    # one text of each class: the one that holds its smallest doc_id (ids that are all null: the smallest text)
    best = shared.groupBy("root").agg(F.min(F.struct(F.col("low").isNull(), "low", "node")).alias("best")).select("best.node", "best.low")
    dealt = marked(rows, shared.select("node"), "node")
    alone = dealt.where("not marked").select("row")
    others = dealt.where("marked").drop("marked").join(shared.select("node", F.lit(True).alias("in_class")), "node", "left")
    kept = others.where("in_class").join(best, "node").where(F.col("id").eqNullSafe(F.col("low"))).dropDuplicates(["node"]).select("row")
    return alone.union(others.where("in_class is null").select("row")).union(kept).select("row.*")
