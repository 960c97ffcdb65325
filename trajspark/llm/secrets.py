"""Operator 3: secret scans with Spark expressions only.

Base rules find assignments, access keys and long hex strings. Character Markov models add more: a bigram model of random strings and one of
ordinary identifiers, both trained from labelled samples, are compared by their log-likelihood ratio on every long token.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, text_or_empty

KINDS = ("assign", "access", "hex", "markov")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
#: Tokens that the Markov models judge, and those they learn from.
LONG_TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
ANY_TOKEN = r"[A-Za-z0-9+/_=-]{4,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Documents of the training sample (smallest hashes of doc_id), and generated random strings of each of three spellings.
SAMPLE_DOCS, RANDOM_STRINGS = 2000, 2000
#: A token is a secret from this log-likelihood ratio on, in thousandths of a nat.
MIN_LLR = 12_000
#: Share of each character's successors that count as the character itself in the ordinary model: rules of dashes, padding and the like are no secrets.
REPEATED = 0.5
#: Tokens of this form are identifiers and are not judged.
UUID = "^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"
SPAN = "struct<start:int,kind:int,end:int,value:string>"
#: Items of one part of a gathered array.
PART = 128


def _bigrams(tokens: DataFrame) -> DataFrame:
    """(token, random, n) -> (random, a, b, n): how often character b follows a."""
    chars = F.split("token", "")
    pairs = F.zip_with(F.slice(chars, 1, F.length("token") - 1), F.slice(chars, 2, F.length("token") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    rows = tokens.where(F.length("token") > 1).select("random", F.inline(pairs), "n")
    known = lambda c: F.col(c).rlike("^[A-Za-z0-9+/_=-]$")
    return rows.where(known("a") & known("b")).groupBy("random", "a", "b").agg(F.sum("n").alias("n"))


def labelled_samples(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, random_strings: int = RANDOM_STRINGS) -> DataFrame:
    """(token, random, n): values of base rules and generated strings as random ones, all other tokens of the sampled documents as ordinary ones.

    The sample holds the doc_ids of the sample_docs smallest hashes; of repeated ids the smallest text.
    """
    spark = docs.sparkSession
    key = F.xxhash64("doc_id")
    last = docs.select(key.alias("h")).distinct().orderBy("h").limit(sample_docs).agg(F.max("h")).collect()[0][0]
    sample = saved(docs.where(key <= F.lit(last)).groupBy("doc_id").agg(F.min("text").alias("text")), "sample")
    secret = F.concat(F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(2)), F.regexp_extract_all("text", F.lit(HEX), F.lit(0)), F.regexp_extract_all("text", F.lit(ACCESS), F.lit(0)))
    found = sample.select(F.explode(F.filter(secret, lambda x: F.length(x) >= 16)).alias("token"), F.lit(True).alias("random"))
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", ASSIGN, " "), HEX, " "), ACCESS, " ")
    ordinary = sample.select(F.explode(F.regexp_extract_all(rest, F.lit(ANY_TOKEN), F.lit(0))).alias("token"), F.lit(False).alias("random"))
    digest = F.sha2(F.col("id").cast("string"), 256)
    spelled = F.array(F.substring(digest, 1, 40), F.base64(F.unhex(digest)), F.upper(F.substring(F.conv(F.substring(digest, 1, 15), 16, 36), 1, 20)))
    made = spark.range(random_strings).select(F.explode(spelled).alias("token"), F.lit(True).alias("random"))
    return found.union(ordinary).union(made).groupBy("token", "random").agg(F.count("*").alias("n"))


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, random_strings: int = RANDOM_STRINGS) -> list[int]:
    """Table of 128 * 128 log ratios, log P(b | a, random) - log P(b | a, ordinary), in thousandths of a nat, at 128 * code(a) + code(b).

    Only the counts of character pairs, at most len(ALPHABET) ** 2 for each model, reach the driver.
    """
    tokens = labelled_samples(docs.select("doc_id", text_or_empty().alias("text")), sample_docs, random_strings)
    counts: dict[bool, dict] = {True: {}, False: {}}
    for r in _bigrams(tokens).collect():
        counts[r["random"]][r["a"], r["b"]] = r["n"]
    table = [0] * (128 * 128)
    sums = {kind: {a: sum(counts[kind].get((a, b), 0) for b in ALPHABET) for a in ALPHABET} for kind in counts}
    for a in ALPHABET:  # repeated characters are ordinary, whether or not the sample holds any
        more = max(0.0, REPEATED * max(sums[False][a], 1) - counts[False].get((a, a), 0)) / (1 - REPEATED)
        counts[False][a, a] = counts[False].get((a, a), 0) + more
        sums[False][a] += more
    for a in ALPHABET:
        for b in ALPHABET:
            p, q = ((counts[kind].get((a, b), 0) + 0.5) / (sums[kind][a] + 0.5 * len(ALPHABET)) for kind in (True, False))
            table[ord(a) * 128 + ord(b)] = round(1000 * math.log(p / q))
    return table


def llr(token: Column, table: Column) -> Column:
    """The log-likelihood ratio of a token of ALPHABET, in thousandths of a nat; the token is cut into characters once."""
    chars = F.split(token, "")
    steps = F.zip_with(chars, F.slice(chars, F.lit(2), F.length(token)), lambda a, b: F.element_at(table, F.ascii(a) * 128 + F.ascii(b) + 1))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda total, x: total + F.coalesce(x.cast("long"), F.lit(0).cast("long")))


def _collected(rows: Column, zero: Column, item: str, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """Fold rows with step(state, row) -> (state, item), gathering the items that are not null.

    Items go to parts of PART ones, so that a row of n items costs n * PART and not n * n copies.
    """
    none = F.lit([]).cast(f"array<{item}>")
    start = F.struct(zero.alias("state"), F.lit([]).cast(f"array<array<{item}>>").alias("parts"), none.alias("part"))

    def merge(at: Column, row: Column) -> Column:
        state, found = step(at["state"], row)
        own = F.when(found.isNull(), none).otherwise(F.array(found))
        full = F.size(at["part"]) >= PART
        parts = F.when(full, F.concat(at["parts"], F.array(at["part"]))).otherwise(at["parts"])
        return F.struct(state.alias("state"), parts.alias("parts"), F.when(full, own).otherwise(F.concat(at["part"], own)).alias("part"))

    return F.aggregate(rows, start, merge, lambda at: F.flatten(F.concat(at["parts"], F.array(at["part"]))))


def _span(start: Column, end: Column, kind: Column, value: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), kind.cast("int").alias("kind"), end.cast("int").alias("end"), value.alias("value"))


def _spans(text: Column, pattern: str, kind: int, group: int = 0, keep=None) -> Column:
    """The leftmost non-overlapping matches as spans, in code points: the texts between matches give their places."""
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    rows = F.arrays_zip(gaps.alias("gap"), found.alias("match"), value.alias("value"))

    def step(at: Column, row: Column) -> tuple[Column, Column]:
        a = at + F.length(row["gap"])
        b = a + F.length(row["match"])
        return F.coalesce(b, a).cast("int"), F.when(row["match"].isNotNull(), _span(a, b, F.lit(kind), row["value"]))

    spans = _collected(rows, F.lit(0), SPAN, step)
    return F.filter(spans, keep) if keep else spans


def _clear(tokens: Column, base: Column) -> Column:
    """The tokens that overlap no base span: one pass forwards (the furthest end so far) and one backwards (the next start) over all, by start."""
    rows = F.array_sort(F.concat(base, tokens))  # by start, then kind: base spans come before a token of the same start
    is_token = lambda s: s["kind"] == len(KINDS) - 1
    ahead = _collected(rows, F.lit(0), SPAN, lambda end, s: (F.when(is_token(s), end).otherwise(F.greatest(end, s["end"])), F.when(~is_token(s) | (end <= s["start"]), s)))
    back = _collected(F.reverse(ahead), F.lit(2**31 - 1), SPAN, lambda start, s: (F.when(is_token(s), start).otherwise(s["start"]), F.when(is_token(s) & (s["end"] <= start), s)))
    return F.when(F.size(base) > 0, back).otherwise(tokens)


def _listed(spans: Column) -> Column:
    name = lambda s: F.element_at(F.lit(list(KINDS)), s["kind"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _found(docs: DataFrame, table: list[int], text_col: str, min_llr: int) -> DataFrame:
    """(row, text, base, found): the rows of docs whole in one column, so that none of their names matters."""
    model = F.from_json(F.lit(json.dumps(table)), "array<int>")
    none = F.lit([]).cast(f"array<{SPAN}>")
    rows = docs.select(F.struct(*docs.columns).alias("row"), text_or_empty(text_col).alias("text"))
    assigned = F.when(F.contains("text", F.lit(":")) | F.contains("text", F.lit("=")), _spans(F.col("text"), ASSIGN, 0, 2, lambda s: F.length(s["value"]) >= 8)).otherwise(none)
    access = F.when(F.contains("text", F.lit("AKIA")), _spans(F.col("text"), ACCESS, 1)).otherwise(none)
    hexes = F.when(F.col("text").rlike("[0-9a-f]{32}"), _spans(F.col("text"), HEX, 2)).otherwise(none)
    tokens = F.when(F.col("text").rlike("[A-Za-z0-9+/_=-]{20}"), _spans(F.col("text"), LONG_TOKEN, 3)).otherwise(none)
    rows = rows.withColumns({"assigned": assigned, "access": access, "hexes": hexes, "tokens": tokens})
    rows = rows.select("row", "text", "tokens", F.array_sort(F.concat("assigned", "access", "hexes")).alias("base"))
    likely = F.filter("tokens", lambda s: (llr(s["value"], model) >= min_llr) & ~s["value"].rlike(UUID))
    rows = rows.withColumn("tokens", F.when(F.size("tokens") > 0, likely).otherwise(none))
    rows = rows.withColumn("tokens", F.when(F.size("tokens") > 0, _clear(F.col("tokens"), F.col("base"))).otherwise(none))
    return rows.select("row", "text", "base", F.when(F.size("tokens") > 0, F.array_sort(F.concat("base", "tokens"))).otherwise(F.col("base")).alias("found"))


def find_secrets(docs: DataFrame, table: list[int], text_col: str = "text", min_llr: int = MIN_LLR) -> DataFrame:
    """Adds `base` and `found`, arrays of struct(start, kind, end, value) by start, then kind; kind numbers KINDS, ends are exclusive.

    Base spans all stay; a Markov span is added for each token from min_llr on that overlaps none of them. Null and empty texts have
    no spans. One projection, no shuffle: repeated rows and hot keys cost nothing extra, and each text is scanned whole, in time
    in proportion to it. Input columns named base or found give way to the new ones.
    """
    return _found(docs, table, text_col, min_llr).select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns if c.lower() not in ("base", "found")], "base", "found")


def redact(docs: DataFrame, table: list[int], text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The documents with every found span replaced by `mark` (overlapping spans by one), their columns kept, whatever their names.

    n_chars, where it exists, follows. Texts without spans, null ones too, stay as they are. A text is cut by its UTF-32 bytes, where places are
    multiples of four, so that a piece costs its own length.
    """
    rows = _found(docs, table, text_col, MIN_LLR)
    piece = "struct<start:int,size:int>"
    pieces = _collected(F.col("found"), F.lit(0), piece, lambda at, s: (F.greatest(at, s["end"]), F.when(s["start"] >= at, F.struct(at.alias("start"), (s["start"] - at).alias("size")))))
    last = F.array_max(F.transform("found", lambda s: s["end"]))
    whole = F.array(F.struct(F.encode("text", "UTF-32").alias("bytes"), pieces.alias("pieces"), last.alias("last")))
    cut = lambda z, start, size: F.decode(F.substr(z["bytes"], start * 4 + 1, size * 4), "UTF-32")
    joined = lambda z: F.concat(F.array_join(F.transform(z["pieces"], lambda p: F.concat(cut(z, p["start"], p["size"]), F.lit(mark))), ""), cut(z, z["last"], F.length("text")))
    clean = F.when(F.size("found") > 0, F.get(F.transform(whole, joined), F.lit(0)))
    rows = rows.select("row", clean.alias("clean"))

    def column(c: str) -> Column:
        old = F.col(f"row.`{c}`")
        if c == text_col:
            return F.coalesce("clean", old).alias(c)
        return (F.when(F.col("clean").isNotNull(), F.length("clean").cast(docs.schema[c].dataType)).otherwise(old) if c == "n_chars" else old).alias(c)

    return rows.select(*[column(c) for c in docs.columns])


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts by base kind, the digest of the base spans and the listing of all spans, of what find_secrets returns."""
    number = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        F.col(id_col).cast("long").alias("doc_id"),
        number(0).alias("n_assign"),
        number(1).alias("n_access"),
        number(2).alias("n_hex"),
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
        _listed(F.col("found")).alias("spans"),
    )
