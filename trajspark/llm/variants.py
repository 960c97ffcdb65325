"""Operator 11: spelling variants by a dictionary of pairs of trie nodes.

Every prefix of a word is a node of the forward trie, every suffix one of the reversed trie, and nodes are numbered: a node of at most PACKED known letters
by its path read as a number, deeper ones by a table of the distinct paths. A word of L letters then stands under the pairs (prefix node, suffix
node) around each of its letters (that position skipped) and at each of its L + 1 gaps (a position inserted). Two words differ by one replaced letter
exactly if they share a pair with a position skipped in both, by one inserted letter exactly if the shorter one's gap is the longer one's skipped
position. Of a run of equal letters only the first one's skip counts for insertions, so each two neighbours meet under one pair and are
counted once. Under a pair stand at most one word for each letter of the alphabet and one more.

Words of more than LONG letters would have too long paths: their nodes are numbered by fingerprints instead, and the words that meet are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, text_or_empty

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = r"[a-zÀ-ÿ]+"
#: One run in so many, by its hash, loses a letter.
NOISE = 97
MIN_LETTERS, MIN_OCCURRENCES = 5, 3
#: Letters whose path is its node's number: BASE ** PACKED fits into 63 bits.
PACKED, BASE = 9, 91
#: Words of more letters go by fingerprints.
LONG = 64
#: A near word that is so many times as frequent is a word's form.
TIMES = 2
PRIME, RADIX = (1 << 61) - 1, 1_000_003


def noisy_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_letters: int = MIN_LETTERS, min_occurrences: int = MIN_OCCURRENCES) -> DataFrame:
    """(word, n): the maximal runs of letters of the whole texts, A to Z lower-cased, that have enough letters and occurrences.

    A run whose crc32 of `<id>:<run>` is divisible by NOISE loses the letter at that number modulo its length. Null texts hold none, a null id is
    written as nothing; repeated rows count each. Counts are combined before the shuffle, so a frequent word is no hot key.
    """
    text = F.translate(text_or_empty(f"`{text_col}`"), UPPER, LOWER)
    rows = docs.select(F.concat(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")), F.lit(":")).alias("id"), F.explode(F.regexp_extract_all(text, F.lit(RUN), F.lit(0))).alias("run"))
    rows = rows.withColumn("h", F.crc32(F.concat("id", "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    words = rows.select(F.when(F.col("h") % NOISE == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= min_letters).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_occurrences)


def _letter(c: Column) -> Column:
    """1 to 90 for a to z and U+00C0 to U+00FF, null for others."""
    point = F.ascii(c)
    return F.when(point.between(97, 122), point - 96).when(point.between(0xC0, 0xFF), point - (0xC0 - 27))


def _path_numbers(codes: Column, length: Column) -> Column:
    """The numbers of the paths of 0, 1, ... letters, as far as they are packed; null from an unknown letter on."""
    zero = F.lit(0).cast("long")
    return F.transform(F.sequence(F.lit(0), F.least(length, F.lit(PACKED))), lambda k: F.aggregate(F.slice(codes, F.lit(1), k), zero, lambda x, c: x * BASE + c))


def numbered(words: DataFrame) -> DataFrame:
    """words (word, n) with `ahead` and `behind`: the number of the node of each prefix and of each suffix, by its letters from 0 on."""
    chars, length = F.split("word", ""), F.length("word")
    codes = F.transform(chars, _letter)
    w = words.select("word", "n", length.alias("length"), _path_numbers(codes, length).alias("a"), _path_numbers(F.reverse(codes), length).alias("b"))
    packed = lambda side, k: F.get(F.col(side), k)
    path = lambda side, k: F.substr("word", F.lit(1), k) if side == "a" else F.substr("word", F.col("length") - k + 1, k)
    row = lambda side: F.transform(F.filter(F.sequence(F.lit(1), F.col("length")), lambda k: packed(side, k).isNull()), lambda k: F.struct(F.lit(side).alias("side"), k.alias("k"), path(side, k).alias("path")))
    deep = w.where((F.col("length") > PACKED) | F.exists("a", lambda x: x.isNull())).select("word", F.inline(F.concat(row("a"), row("b"))))
    nodes = saved(deep.select("side", "path").distinct().withColumn("id", -1 - F.monotonically_increasing_id()), "nodes")
    own = deep.join(nodes, ["side", "path"]).groupBy("word", "side").agg(F.map_from_entries(F.collect_list(F.struct("k", "id"))).alias("ids"))  # LONG entries at most
    own = own.groupBy("word").agg(*[F.first(F.when(F.col("side") == s, F.col("ids")), ignorenulls=True).alias(f"deep_{s}") for s in ("a", "b")])
    number = lambda side: F.transform(F.sequence(F.lit(0), F.col("length")), lambda k: F.coalesce(packed(side, k), F.try_element_at(f"deep_{side}", k)))
    return w.join(own, "word", "left").select("word", "n", number("a").alias("ahead"), number("b").alias("behind"))


def _under_pairs(w: DataFrame) -> DataFrame:
    """(p, s, skip, first, n, word): a row for each skipped letter and each gap; first: the letter before is another one."""
    length, chars = F.length("word"), F.split("word", "")
    pair = lambda i, rest, skip, first: F.struct(F.get("ahead", i).alias("p"), F.get("behind", rest).alias("s"), F.lit(skip).alias("skip"), first.alias("first"))
    skips = F.transform(F.sequence(F.lit(0), length - 1), lambda i: pair(i, length - 1 - i, True, (i == 0) | (F.get(chars, i) != F.coalesce(F.get(chars, i - 1), F.lit("")))))
    gaps = F.transform(F.sequence(F.lit(0), length), lambda i: pair(i, length - i, False, F.lit(False)))
    return w.select("word", "n", F.inline(F.concat(skips, gaps)))


def _met(rows: DataFrame) -> DataFrame:
    """(word, near, best): what each word meets under each pair: how many others, and the most frequent one as (-n, word)."""
    member = F.struct((-F.col("n")).alias("less"), "word", "skip", "first")
    g = rows.groupBy("p", "s").agg(F.array_sort(F.collect_list(member)).alias("m")).where("size(m) > 1")
    as_best = lambda x: F.when(x.isNotNull(), F.struct(x["less"].alias("less"), x["word"].alias("word")))
    skips = F.filter("m", lambda x: x["skip"])
    firsts = F.filter("m", lambda x: x["skip"] & x["first"])
    g = g.select("m", F.size(skips).alias("skips"), F.size(firsts).alias("firsts"), as_best(F.get(skips, F.lit(0))).alias("top"), as_best(F.get(skips, F.lit(1))).alias("second"), as_best(F.get(firsts, F.lit(0))).alias("top_first"), as_best(F.get(F.filter("m", lambda x: ~x["skip"]), F.lit(0))).alias("gap"))
    met = g.select("skips", "firsts", "top", "second", "top_first", "gap", F.inline("m"))
    other = F.when(F.col("word") == F.col("top.word"), F.col("second")).otherwise(F.col("top"))
    with_gap = F.col("first") & F.col("gap").isNotNull()
    near = F.when(~F.col("skip"), F.col("firsts")).otherwise(F.col("skips") - 1 + with_gap.cast("int"))
    best = F.when(~F.col("skip"), F.col("top_first")).when(with_gap, F.least(F.coalesce(other, "gap"), F.col("gap"))).otherwise(other)
    return met.select("word", near.cast("long").alias("near"), best.alias("best")).where("near > 0")


def _long_rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of _under_pairs by fingerprints of prefixes and suffixes modulo a prime, word by word; `own` stands for the word."""
    for part in parts:
        for own, word in zip(part["own"], part["word"], strict=True):
            points, n = [ord(c) for c in word], len(word)
            ahead, behind = [0], [0]
            for out, order in ((ahead, points), (behind, reversed(points))):
                for c in order:
                    out.append((out[-1] * RADIX + c) % PRIME)
            first = [i == 0 or points[i] != points[i - 1] for i in range(n)]
            for a in range(0, n, 50_000):
                i = range(a, min(n, a + 50_000))
                yield pd.DataFrame({"own": own, "letters": n - 1, "p": [ahead[x] for x in i], "s": [behind[n - 1 - x] for x in i], "skip": True, "first": [first[x] for x in i]})
            for a in range(0, n + 1, 50_000):
                i = range(a, min(n + 1, a + 50_000))
                yield pd.DataFrame({"own": own, "letters": n, "p": [ahead[x] for x in i], "s": [behind[n - x] for x in i], "skip": False, "first": False})


def _long_met(words: DataFrame, long: int) -> DataFrame:
    """As _met, a row for each two neighbours of which one has more than `long` letters: words are told by numbers until the two are compared."""
    w = saved(words.where(F.length("word") >= long).withColumn("own", F.monotonically_increasing_id()), "long")
    rows = w.select("own", "word").mapInPandas(_long_rows, "own long, letters int, p long, s long, skip boolean, first boolean")
    g = rows.groupBy("letters", "p", "s").agg(F.collect_list(F.struct("own", "skip", "first")).alias("m")).where("size(m) > 1")
    pairs = g.select(F.explode("m").alias("x"), "m").select("x", F.explode("m").alias("y")).where("x.own <> y.own and (x.skip and y.skip or x.skip and x.first and not y.skip or y.skip and y.first and not x.skip)")
    side = lambda k: w.select(F.col("own").alias(k), F.col("word").alias(f"{k}_word"), F.col("n").alias(f"{k}_n"))
    both = pairs.select("x.own", "y.own").toDF("x", "y").distinct().join(side("x"), "x").join(side("y"), "y")
    both = both.where((F.greatest(F.length("x_word"), F.length("y_word")) > long) & (F.levenshtein("x_word", "y_word", 1) == 1))
    return both.select(F.col("x_word").alias("word"), F.lit(1).cast("long").alias("near"), F.struct((-F.col("y_n")).alias("less"), F.col("y_word").alias("word")).alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): from word, forms are followed to the last one; a word without a form is its own root.

    Forms must not lead back. Each round follows twice as far, so a chain of k forms takes about log2 k rounds; only whether any word moved reaches the driver.
    """
    at = saved(forms.select("word", F.coalesce("form", "word").alias("top")), "roots")
    while True:
        to = at.select(F.col("word").alias("top"), F.col("top").alias("next"))
        moved = saved(at.join(to, "top").select("word", F.col("next").alias("top"), (F.col("next") != F.col("top")).alias("moved")), "roots")
        if moved.where("moved").isEmpty():
            return moved.select("word", F.col("top").alias("root"))
        at = moved.drop("moved")


def spelling_variants(words: DataFrame, word_col: str = "word", n_col: str = "n", times: int = TIMES, long: int = LONG) -> DataFrame:
    """Per word: word, form, root, n, n_near and form_n.

    Near words differ by exactly one inserted, deleted or replaced code point; n_near counts them. form is the near word of largest n (of equal ones the
    smallest in code-point order) if that is at least `times` (2 or more) times the word's n, else null; form_n is its n. root: see roots. Rows with a null or
    empty word take no part, the n of repeated words are added up, an empty table gives no rows; other columns are not read, whatever their names.
    """
    if times < 2:
        raise ValueError("times must be 2 or more, so that forms cannot lead back")
    usable = F.col(f"`{word_col}`").isNotNull() & (F.length(f"`{word_col}`") > 0)
    words = saved(words.where(usable).groupBy(F.col(f"`{word_col}`").alias("word")).agg(F.sum(F.col(f"`{n_col}`").cast("long")).alias("n")), "words")
    met = _met(_under_pairs(numbered(words.where(F.length("word") <= long))))
    if not words.where(F.length("word") > long).isEmpty():
        met = met.unionByName(_long_met(words, long))
    near = met.groupBy("word").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))
    has = F.coalesce(-F.col("best.less") >= times * F.col("n"), F.lit(False))
    out = words.join(near, "word", "left").select("word", F.when(has, F.col("best.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, -F.col("best.less")).alias("form_n"))
    out = saved(out, "forms")
    return out.join(roots(out), "word").select("word", "form", "root", "n", "n_near", "form_n")
